"""Questions, answers and judge lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.functions import text as T


def questions(samples: DataFrame) -> DataFrame:
    """One row a question: row_id, pos (from 1), qid, question, expected, tag."""
    rows = samples.select("row_id", "task_id", F.posexplode("industrial_logic_questions").alias("pos", "q"))
    return rows.select("row_id", "task_id", (F.col("pos") + 1).alias("pos"), F.col("q.id").alias("qid"), F.col("q.text").alias("question"), F.col("q.answer").alias("expected"), F.coalesce(F.nullif(F.col("q.weakness_target"), F.lit("")), F.lit("untagged")).alias("tag"))


def evaluate(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question with its answer ("" where none) and the outcome; equi-join on (row, position)."""
    rows = asked.join(answers, ["row_id", "pos"], "left").withColumns({"answer": F.coalesce("answer", F.lit("")), "reasoning": F.coalesce("reasoning", F.lit(""))})
    return rows.withColumn("outcome", T.answer_outcome(F.col("expected"), F.col("answer"), F.col("question"), F.col("reasoning")))


def question_scores(outcomes: DataFrame) -> DataFrame:
    good = F.col("outcome") != "wrong"
    return outcomes.groupBy("row_id").agg(F.count("*").alias("total"), F.count_if(good).alias("correct"), F.count_if(F.col("outcome") == "superlative").alias("superlative"), F.avg(good.cast("int").cast("double")).alias("accuracy"))


def weakness_accuracy(outcomes: DataFrame) -> DataFrame:
    good = F.col("outcome") != "wrong"
    return outcomes.groupBy("tag").agg(F.count("*").alias("total"), F.count_if(good).alias("correct"), F.avg(good.cast("int").cast("double")).alias("accuracy"))


def superlative_log(outcomes: DataFrame) -> DataFrame:
    """What an append log of superlative passes would hold; write it with mode append."""
    return outcomes.where("outcome = 'superlative'").select("row_id", "qid", "question", "expected", "answer")


def answers_of_lines(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """Line i of a judge's response answers question i; missing or unreadable lines are "no"."""
    lines = responses.select("row_id", F.posexplode(F.split(F.trim("raw_response"), "\n")).alias("at", "line"))
    lines = lines.select("row_id", (F.col("at") + 1).alias("pos"), T.cot_answer(F.col("line")).alias("answer"), F.coalesce(F.get_json_object(F.regexp_replace("line", r"^\s*\d+\.\s*(?=\{)", ""), "$.chain_of_thought"), F.lit("")).alias("reasoning"))
    return asked.select("row_id", "pos").join(lines, ["row_id", "pos"], "left").withColumns({"answer": F.coalesce("answer", F.lit("no")), "reasoning": F.coalesce("reasoning", F.lit(""))})


def first_source(rows: DataFrame, *, judged: str, measured: str) -> DataFrame:
    """A judge's score where there is one, else the measured one, and which it was."""
    source = F.when(F.col(judged).isNotNull(), "judge").when(F.col(measured).isNotNull(), "measured").otherwise("absent")
    return rows.withColumn("score", F.coalesce(judged, measured)).withColumn("source", source)
