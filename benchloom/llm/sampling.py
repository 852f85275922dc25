"""A sample that matches target proportions, with minimum counts (problem 3).

Each category numbers its tasks in random order (hash of the id); task number r of a
category with target t has priority (r - 0.5) / t, the divisor method of Sainte-Lague.  The
first ``min_count`` of each category are taken first, then the smallest priorities over all
categories until the plan is full.  A category that runs out leaves its seats to the others.

Nothing is sorted over a whole category: tasks are counted by hash bucket, running sums of
the counts give the number at which each bucket begins, and only buckets that begin below
what a category can use are numbered, each on its own, so a category with a third of all rows
spreads over its buckets.  As priorities grow with r, the smallest ones are fixed by how far
the cells' numbers reach; ``seats`` finds the cut by bisection on the table of cells, whose
size is that of the plans, and says which cells run out before their minimum or their share.

Defined results.  Null and repeated task_ids count never and once; a task counts for every cell
that any of its rows meets, but is drawn once a plan at most: for the cell that has the fewest tasks for
what it needs, then the least cell_id.  Null in a plan's domain, category, axis or difficulty asks for
nothing.  A null or missing value meets no cell that asks for it.  Null shares and counts are 0.  Ties of
hashes are ordered by task_id.  Empty samples leave every cell with a requirement short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm.categories import canonical, key_of, names
from benchloom.session import cut, join_dimension

#: Bits of the hash that number a category's buckets.
BUCKET_BITS = 10
ANY = "*"


def cells(plans: DataFrame, aliases: DataFrame) -> DataFrame:
    """The cells with a key: what they ask for of domain, category, axis and difficulty."""
    for field, column in (("domain", "domain"), ("task_category", "task_category"), ("axis", "difficulty_axis")):
        plans = canonical(plans, aliases, field, column, f"k_{field}")
    ask = lambda c: F.coalesce(key_of(F.col(c)), F.lit(ANY))
    level = ask("difficulty")
    axis = F.when(level == ANY, F.lit(ANY)).otherwise(ask("k_axis"))
    rows = plans.withColumn("shape", F.concat(*(F.when(x == ANY, "0").otherwise("1") for x in (ask("k_domain"), ask("k_task_category"), axis, level))))
    return rows.select(
        "plan_id",
        "cell_id",
        F.coalesce("plan_size", F.lit(0)).cast("bigint").alias("plan_size"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("min_count", F.lit(0)).cast("bigint").alias("min_count"),
        "shape",
        F.concat_ws("|", ask("k_domain"), ask("k_task_category"), axis, level).alias("key"),
    )


def members(samples: DataFrame, wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(plan_id, task_id, cells): the cells of a plan that each task can be drawn for."""
    shapes = {r["shape"] for r in wanted.select("shape").distinct().collect()}  # 16 at most
    rows = samples.select("task_id", "domain", "task_category", "difficulty_profile").where(F.col("task_id").isNotNull())
    for field in ("domain", "task_category"):
        rows = canonical(rows, aliases, field, field, f"k_{field}")
    rows = rows.select("task_id", key_of(F.col("k_domain")).alias("d"), key_of(F.col("k_task_category")).alias("c"), "difficulty_profile")
    part = lambda c, on: F.col(c) if on == "1" else F.lit(ANY)
    plain = [F.concat(part("d", s[0]), F.lit("|"), part("c", s[1]), F.lit("|*|*")) for s in sorted(shapes) if s[3] == "0"]
    found = None
    if plain:
        found = rows.select("task_id", F.explode(F.array(*plain)).alias("key"))
    if deep := [s for s in sorted(shapes) if s[3] == "1"]:
        known = names(aliases, "axis").select(F.col("key").alias("axis"), key_of(F.col("canonical")).alias("axis_name"))
        levels = rows.select("task_id", "d", "c", F.explode("difficulty_profile").alias("axis", "level"))
        levels = join_dimension(levels.withColumn("axis", key_of(F.col("axis"))), known, ["axis"]).withColumn("a", F.coalesce("axis_name", "axis")).withColumn("v", key_of(F.col("level")))
        keys = [F.concat(part("d", s[0]), F.lit("|"), part("c", s[1]), F.lit("|"), part("a", s[2]), F.lit("|"), F.col("v")) for s in deep]
        more = levels.select("task_id", F.explode(F.array(*keys)).alias("key"))
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = wanted.select(F.lit("").alias("task_id"), "key").limit(0)
    found = join_dimension(found.where(F.col("key").isNotNull()), wanted.select("key", "plan_id", "cell_id"), ["key"], "inner")
    return found.groupBy("plan_id", "task_id").agg(F.array_sort(F.collect_set("cell_id")).alias("cells"))


def each_cell(held: DataFrame) -> DataFrame:
    """(plan_id, cell_id, task_id) of all that each cell can draw on."""
    return held.select("plan_id", F.explode("cells").alias("cell_id"), "task_id")


def one_cell(held: DataFrame, available: DataFrame) -> DataFrame:
    """(plan_id, cell_id, task_id), each task of a plan once: in its scarcest cell."""
    scarce = F.struct((F.col("available") / F.greatest(F.col("needed"), F.lit(1e-9))).alias("per_need"), "cell_id")
    order = available.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(scarce)), lambda x: x["cell_id"]).alias("order"))
    return join_dimension(held, order, ["plan_id"], "inner").select("plan_id", F.get(F.array_intersect("order", "cells"), F.lit(0)).alias("cell_id"), "task_id")


def with_need(wanted: DataFrame) -> DataFrame:
    return wanted.withColumn("needed", F.greatest(F.col("min_count").cast("double"), F.round(F.col("target_share") * F.col("plan_size"), 6)))


def seats_of(size: int, target: np.ndarray, floor: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Seats of each category: minimum counts first, then the smallest (r - 0.5) / target.

    Ties of priorities go to the earlier category.
    """
    floor = np.minimum(floor, have)
    if floor.sum() >= size:
        floor, have = np.zeros_like(floor), floor
    size = int(min(size, np.where(target > 0, have, floor).sum()))
    taken = lambda x: np.clip(np.floor(x * target + 0.5).astype(np.int64), floor, np.where(target > 0, have, floor))
    low, high = 0.0, 1.0
    while taken(high).sum() < size:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if taken(mid).sum() <= size:
            low = mid
        else:
            high = mid
    seats = taken(low)
    while seats.sum() < size:
        open_ = (seats < have) & (target > 0)
        best = np.where(open_, (seats + 0.5) / np.where(target > 0, target, 1), np.inf)
        seats[int(np.argmin(best))] += 1
    return seats


def seats(reached: DataFrame) -> DataFrame:
    """(plan_id, cell_id, seats, short), out of how far the numbers of each cell reach; a group is the cells of a plan.

    ``own`` is how many tasks a cell has to itself.  A cell is short if its numbers (``available``) end
    before the last one that its minimum, or its share of the plan, lays claim to.
    """

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        size, target, floor = int(pdf["plan_size"].max()), pdf["target_share"].to_numpy(float), pdf["min_count"].to_numpy(np.int64)
        got = seats_of(size, target, floor, pdf["own"].to_numpy(np.int64))
        have = pdf["available"].to_numpy(np.int64)
        return pdf[["plan_id", "cell_id"]].assign(seats=got, short=(have < floor) | (have < np.round(target * size, 6)))

    types = {f.name: f.dataType.simpleString() for f in reached.schema}
    return reached.groupBy("plan_id").applyInPandas(share, f"plan_id {types['plan_id']}, cell_id {types['cell_id']}, seats bigint, short boolean")


def reach(numbered: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The cells with the last number that each of them reaches, 0 where it has none."""
    last = numbered.groupBy("plan_id", "cell_id").agg(F.max("rank").alias(name))
    return wanted.join(last, ["plan_id", "cell_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def draw(drawn_on: DataFrame, shares: DataFrame, seed: int = 3, bits: int = BUCKET_BITS) -> DataFrame:
    """plan_id, cell_id, task_id, rank: each cell's tasks in random order, as many as its ``seats``."""
    cell = ["plan_id", "cell_id"]
    rows = drawn_on.withColumn("place", F.xxhash64("task_id", F.lit(seed))).withColumn("bucket", F.expr(f"shiftrightunsigned(place, {64 - bits})"))
    counts = rows.groupBy(*cell, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begins = cut(join_dimension(begins, shares, cell, "inner").where(F.col("begin") < F.col("seats")).select(*cell, "bucket", "begin", "seats"))
    rows = join_dimension(rows, begins, [*cell, "bucket"], "inner")
    rank = F.col("begin") + F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("place", "task_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("seats")).select(*cell, "task_id", "rank")


def allotted(samples: DataFrame, plans: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells with needed, available, own, seats and short; and the tasks by the one cell they may be drawn for.

    No cell can use more numbers than the plan has seats or its own need asks for, so numbering stops there.
    """
    wanted = cut(with_need(cells(plans, aliases)))
    held = cut(members(samples, wanted, aliases))
    most = wanted.select("plan_id", "cell_id", F.greatest(F.col("plan_size"), F.ceil("needed")).cast("bigint").alias("seats"))
    available = cut(reach(draw(each_cell(held), most), wanted, "available"))
    own = one_cell(held, available)
    counts = own.groupBy("plan_id", "cell_id").agg(F.count("*").alias("own"))
    reached = available.join(counts, ["plan_id", "cell_id"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return cut(reached.join(seats(reached), ["plan_id", "cell_id"])), own


def sample(samples: DataFrame, plans: DataFrame, aliases: DataFrame) -> DataFrame:
    """The sample of every plan: plan_id, cell_id, task_id, rank, priority, by_minimum."""
    got, own = allotted(samples, plans, aliases)
    rows = join_dimension(draw(own, got.select("plan_id", "cell_id", "seats")), got.select("plan_id", "cell_id", "target_share", "min_count"), ["plan_id", "cell_id"], "inner")
    priority = F.expr("try_divide(rank - 0.5D, target_share)")
    return rows.select("plan_id", "cell_id", "task_id", "rank", priority.alias("priority"), (F.col("rank") <= F.col("min_count")).alias("by_minimum"))


def cell_report(samples: DataFrame, plans: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every cell: tasks needed, within reach, seats given, share reached, and whether it falls short.

    ``available`` stops at what the cell could use at all: the plan's size, or its need if that is more.
    """
    got, _ = allotted(samples, plans, aliases)
    share = F.expr("try_divide(cast(seats as double), sum(seats) over (partition by plan_id))")
    return got.select("plan_id", "cell_id", "target_share", "min_count", "needed", "available", "seats", share.alias("share_reached"), "short")


def found(samples: DataFrame, plans: DataFrame, aliases: DataFrame) -> DataFrame:
    """plan_id, cell_id: cells that cannot be met, out of the report on their seats."""
    return cell_report(samples, plans, aliases).where("short").select("plan_id", "cell_id")
