"""Parsers, verdicts, audits."""

import pytest
from pyspark.sql import functions as F

from benchloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "plain", "marks", "lines"),
    [("82\nminor localized issue", 82, 82, 82), ("5 severe issues", 5, 5, 5), ("82%", 50, 50, 82), ("", 50, 50, 50), ("score 300 then 70", 70, 70, 70), ("   ", 50, 50, 50), ("Fine.\nI say 33;", 50, 33, 33), (None, 50, 50, 50)],
)
def test_scores(spark, text, plain, marks, lines):
    c = F.lit(text).cast("string")
    assert (one(spark, T.parse_score_plain(c)), one(spark, T.parse_score_marks(c)), one(spark, T.parse_score_lines(c))) == (plain, marks, lines)


@pytest.mark.parametrize(("text", "want"), [("Yes.", "yes"), (" NO way", "no"), ("maybe", None), ("", None), (None, None)])
def test_verdict(spark, text, want):
    assert one(spark, T.verdict(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("expected", "answer", "question", "reasoning", "want"),
    [("yes", "Yes", "", "", "correct"), ("no", "yes", "Is there any warping?", "no warping; geometry is preserved", "superlative"), ("no", "yes", "Is there any warping?", "", "wrong"), ("no", "yes", "Is it red?", "structurally sound", "wrong"), ("", "", "", "", "wrong"), ("no", "yes it remains intact", "Any drift?", "", "superlative")],
)
def test_answers(spark, expected, answer, question, reasoning, want):
    assert one(spark, T.answer_outcome(*map(F.lit, (expected, answer, question, reasoning)))) == want


@pytest.mark.parametrize(("line", "want"), [('1. {"answer": "Yes", "chain_of_thought": "x"}', "yes"), ('{"answer": "n"}', "no"), ("2. no", "no"), ("well, yes", "yes"), ("perhaps", None)])
def test_judge_lines(spark, line, want):
    assert one(spark, T.cot_answer(F.lit(line))) == want


def test_closing_rule(spark):
    assert [one(spark, T.no_zoom(F.lit(x))) for x in ("a No zoom.", "a No zoom", "a")] == ["a No zoom.", "a No zoom.", "a No zoom."]


def test_units_are_completed(spark):
    say = lambda n, m: one(spark, T.complete_unit(F.lit(f"Camera: x; target motion value {n}. Y"), F.lit(m)))
    assert "value 1.5x." in say("1.5", "dolly") and "value 45°." in say("45.0", "orbit") and "value 45°." in say("45°", "orbit")


def test_audit(spark):
    def audit(motion, clause, subject="", target="45"):
        i, s = T.motion_audit(F.lit(motion), F.lit(clause), F.lit(subject), F.lit(target))
        return one(spark, i), one(spark, s)

    assert audit("static", "hold") == ([], "none")
    assert audit("orbit", "orbit by 45° and keep the boom in view") == ([], "low")
    assert audit("orbit", "circle the subject")[1] == "high"
    assert "subject_names_crane" in audit("orbit", "orbit by 45° in view", "a tower crane")[0]
    assert audit("orbit", "orbit the subject")[1] == "medium"


PROMPT = (
    "Task objective: one hoist, no cuts. Core scenario: slew ring turns  a\tcrate. Reference subject: Tower crane; unit 7. Motion requirement / viewpoint motion fidelity: "
    "perform a controlled orbit around the jib; target motion value 45.0. Industrial logic and fact alignment check: keep the causal chain. Execution constraints: none."
)


@pytest.mark.parametrize(
    ("prompt", "clause", "subject", "scenario"),
    [
        (PROMPT, "perform a controlled orbit around the jib; target motion value 45.0", "Tower crane; unit 7", "slew ring turns a crate."),
        ("MOTION REQUIREMENT / VIEWPOINT MOTION FIDELITY:\n pan by 1.5\nto the left .\n no zoom. reference subject: a\nb.", "pan by 1.5\nto the left", "a\nb", ""),
        ("Motion requirement: pan. No zoom.", "", "", ""),
        ("Motion requirement / viewpoint motion fidelity: pan. Then stop.", "", "", ""),
        ("Reference subject: .5 m arm. Core scenario: x\ny", "", "", ""),
        ("Core scenario: last words", "", "", "last words"),
        ("", "", "", ""),
        (None, None, None, None),
    ],
)
def test_sections(spark, prompt, clause, subject, scenario):
    c = F.lit(prompt).cast("string")
    assert (one(spark, T.motion_clause(c)), one(spark, T.reference_subject(c)), one(spark, T.core_scenario(c))) == (clause, subject, scenario)


def test_audit_of_a_prompt(spark):
    c = F.lit(PROMPT)
    issues, severity = T.motion_audit(F.lit("orbit"), T.motion_clause(c), T.reference_subject(c), F.lit("45.0"))
    assert one(spark, issues) == ["subject_names_crane", "no_unit", "buried_verb"] and one(spark, severity) == "high"


def test_terms_are_whole_words(spark):
    assert one(spark, T.any_term(F.lit("a leak here"), ("leak",))) and not one(spark, T.any_term(F.lit("leakage"), ("leak",)))


def test_context_lines(spark):
    assert one(spark, T.context_lines({"a": F.lit("x"), "b": F.lit(None).cast("string")}, F.array(F.lit("p"), F.lit("q")))) == "a: x\nhard_constraints: p; q"
