"""Writers. Tables go out distributed; only reports of bounded size are rendered as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in every leaf, so that JSON has no text in place of numbers."""

    def fix(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fix(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: fix(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(fix(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(fix(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def results(df: DataFrame, path: str, mode: str = "append") -> None:
    """A fact table of per-sample results, partitioned by model."""
    df.write.mode(mode).partitionBy("model").parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, cleaned."""
    clean(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def prompts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prompt lines in order of task_id, by range partitioning: files in name order are the order."""
    df.repartitionByRange("task_id").sortWithinPartitions("task_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def documents(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """JSON documents (column ``document``) as text, in one folder for each value of ``by``."""
    df.select(*by, F.col("document").alias("value")).write.mode(mode).partitionBy(*by).text(path) if by else df.select(F.col("document").alias("value")).write.mode(mode).text(path)


def lines(df: DataFrame, path: str, *order: str, mode: str = "overwrite") -> None:
    """Lines of a report (column ``line``) in order, by range partitioning: files in name order are the order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.mode(mode).text(path)


def superlative_log(df: DataFrame, path: str) -> None:
    """Appends what would be logged of superlative passes."""
    df.write.mode("append").json(path)


def markdown_table(df: DataFrame, limit: int = 10_000) -> str:
    """A small report (``limit`` rows at most, else an error) as one markdown text."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    cell = lambda x: "-" if x is None else f"{x:.1f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def exit_status(violations: DataFrame) -> int:
    """0 if a table of violations is empty, else 1."""
    return 1 if violations.limit(1).count() else 0
