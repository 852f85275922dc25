"""Text rules as Column expressions: verdicts, score parsers, sections, audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import registry as R


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs anywhere; one alternation, no loop over rows."""
    return F.coalesce(F.lower(text).rlike("|".join(map(_literal, words))), F.lit(False))


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of the terms occurs as whole words."""
    return F.coalesce(text.rlike(r"(?<![a-z0-9])(?:" + "|".join(map(_literal, terms)) + r")(?![a-z0-9])"), F.lit(False))


def _literal(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _°" else "\\" + c for c in word)


def verdict(text: Column) -> Column:
    """yes or no by the first letter of the first word; else null."""
    word = F.get(F.split(F.trim(F.lower(text)), r"\s+"), F.lit(0))
    return F.when(word.startswith("y"), "yes").when(word.startswith("n"), "no")


def answer_outcome(expected: Column, answer: Column, question: Column, reasoning: Column) -> Column:
    """correct, superlative or wrong.

    A yes where no was expected is superlative if the question names a failure and the reasoning
    (or the answer) confirms a sound structure.
    """
    want, got = verdict(expected), verdict(answer)
    evidence = F.coalesce(F.nullif(reasoning, F.lit("")), answer)
    better = (want == "no") & (got == "yes") & any_of(question, R.FAILURE_WORDS) & any_of(evidence, R.CORRECTNESS_PHRASES)
    return F.when(want == got, "correct").when(better, "superlative").otherwise("wrong")


def parse_score(text: Column, strip: str = "", first_line: bool = False) -> Column:
    """The first whole number of 0..100 among the words, with ``strip`` cut off their ends; 50 if none."""

    def scan(t: Column) -> Column:
        words = F.transform(F.split(F.trim(t), r"\s+"), lambda w: F.rtrim(w, F.lit(strip)) if strip else w)
        return F.get(F.filter(F.transform(words, lambda w: F.when(w.rlike("^[0-9]{1,9}$"), w.try_cast("int"))), lambda n: n.between(0, 100)), F.lit(0))

    whole = F.trim(text, F.lit(" \t\r\n"))
    found = scan(whole)
    if first_line:
        found = F.coalesce(scan(F.get(F.split(whole, r"\r\n|\r|\n"), F.lit(0))), found)
    return F.coalesce(found, F.lit(50))


def parse_score_plain(text: Column) -> Column:
    return parse_score(text)


def parse_score_marks(text: Column) -> Column:
    return parse_score(text, ".,;:)")


def parse_score_lines(text: Column) -> Column:
    return parse_score(text, ".,;:)%", first_line=True)


def cot_answer(line: Column) -> Column:
    """yes or no of one judge line ('3. {"chain_of_thought": ..., "answer": ...}'), else null."""
    t = F.trim(line, F.lit(" \t\r\n"))
    at = F.instr(t, ". {")
    t = F.when(at > 0, t.substr(at + 2, F.length(t))).when(t.rlike("^[0-9]"), F.regexp_replace(t, "^[0-9. ]+", "")).otherwise(t)
    said = F.lower(F.trim(F.get_json_object(t, "$.answer")))
    low = F.lower(t)
    return F.when(said.startswith("y"), "yes").when(said.startswith("n"), "no").when(low.contains("yes"), "yes").when(low.contains("no"), "no")


# The headings of a prompt's sections and what ends the motion section.
MOTION_SECTION = r"(?is)Motion requirement / viewpoint motion fidelity:\s*(.*?)(?:\.\s*Industrial logic|\.\s*No zoom\.)"
SUBJECT_SECTION = r"(?i)Reference subject:\s*([^.]+)\."
SCENARIO_SECTION = r"(?d)Core scenario:\s*(.*?)(?=\s+Reference subject:|$)"
# End of fixed values.
BLANKS = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def motion_clause(prompt: Column) -> Column:
    """What a prompt says between the motion heading and the next; empty where either is missing."""
    return stripped(F.regexp_extract(prompt, MOTION_SECTION, 1))


def reference_subject(prompt: Column) -> Column:
    """The reference subject, up to the first full stop; empty without one."""
    return stripped(F.regexp_extract(prompt, SUBJECT_SECTION, 1))


def core_scenario(prompt: Column) -> Column:
    """The scenario up to the reference subject or the end of its line, blanks made single."""
    return stripped(F.regexp_replace(F.regexp_extract(prompt, SCENARIO_SECTION, 1), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three or more letters or digits, without stop words."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*R.STOP_TOKENS)))


def has_unit(clause: Column, motion: Column, target: Column) -> Column:
    low = F.lower(clause)
    dolly = (motion == "dolly") & low.rlike(r"\b\d+(\.\d+)?x\b")
    angle = motion.isin("orbit", "pan") & low.rlike(r"\b\d+(\.\d+)?\s*(°|deg|degree)")
    return any_of(clause, R.UNIT_MARKERS) | F.coalesce(dolly | angle, F.lit(False)) | any_of(target, R.UNIT_MARKERS)


def motion_audit(motion: Column, clause: Column, subject: Column, target: Column) -> tuple[Column, Column]:
    """Issues of a prompt's motion clause, and their severity; static ones are none."""
    low = F.lower(F.coalesce(clause, F.lit("")))
    m = F.coalesce(motion, F.lit(""))
    says = low.contains(m)
    moving = m.isin("orbit", "pan", "dolly")
    unexpected = ~m.isin(*R.CLEAR_VERBS)
    rules = [
        (unexpected, "unexpected_motion_type", 3),
        (~unexpected & ~says, "motion_type_not_in_clause", 3),
        ((m == "crane") & ~low.contains("crane"), "crane_without_crane_verb", 3),
        (moving & says & F.lower(F.coalesce(subject, F.lit(""))).contains("crane"), "subject_names_crane", 3),
        (moving & ~has_unit(low, m, target), "no_unit", 2),
        (moving & ~any_of(low, R.STRUCTURE_MARKERS), "no_structure", 2),
        (moving & low.startswith("perform a controlled"), "buried_verb", 1),
        ((m == "pan") & low.contains("follows the evolving leak"), "pan_tied_to_leak", 1),
    ]
    static = m == "static"
    issues = F.when(static, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n, _ in rules))))
    rank = F.greatest(*(F.when(c, F.lit(r)).otherwise(1) for c, _, r in rules))
    return issues, F.when(static, "none").otherwise(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank))


def no_zoom(prompt: Column) -> Column:
    """Ends with "No zoom." """
    return F.when(prompt.endswith("No zoom."), prompt).when(prompt.endswith("No zoom"), F.concat(prompt, F.lit("."))).otherwise(F.concat(prompt, F.lit(" No zoom.")))


def complete_unit(prompt: Column, motion: Column) -> Column:
    """``target motion value 1.5`` as 1.5x or 45.0 as 45 degrees, by motion, else by size."""
    number = F.regexp_extract(prompt, r"target motion value (\d+(?:\.\d+)?)(?![\d.]*[\dx°])", 1)
    value = number.try_cast("double")
    bare = F.regexp_replace(number, r"\.0+$", "")
    ratio = (motion == "dolly") | (~F.coalesce(motion.isin("orbit", "pan"), F.lit(False)) & (value < 10))
    written = F.concat(F.lit("target motion value "), F.when(ratio, F.concat(number, F.lit("x"))).otherwise(F.concat(bare, F.lit("°"))))
    return F.when(number != "", F.replace(prompt, F.concat(F.lit("target motion value "), number), written)).otherwise(prompt)


def visibility(motion: Column, clause: Column) -> Column:
    """pass, weak or fail by what a clause says of visible structure."""
    return F.when(any_of(clause, R.STRUCTURE_MARKERS), "pass_motion").when(F.coalesce(motion, F.lit("")) == "static", "fail_motion").otherwise("weak_motion")


def stem(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def context_lines(fields: dict[str, Column], constraints: Column) -> Column:
    """``key: value`` lines of what is known, and up to eight constraints."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items()]
    hard = F.when(F.size(constraints) > 0, F.concat(F.lit("hard_constraints: "), F.array_join(F.slice(constraints, 1, 8), "; ")))
    return F.concat_ws("\n", *lines, hard)


def question_lines(questions: Column) -> Column:
    """``1. text [target: W2]`` lines."""
    line = lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q["text"], F.coalesce(F.concat(F.lit(" [target: "), q["weakness_target"], F.lit("]")), F.lit("")))
    return F.array_join(F.transform(questions, line), "\n")
