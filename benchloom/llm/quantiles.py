"""Percentiles of very large numeric columns from summaries that add up (problem 2).

A value becomes an integer code of ``bits`` bits.  Three quarters of the codes part the expected range [lo, hi]
evenly; the rest part all doubles below and above it by their leading bits, in steps that are a fixed
share of the value (1.6 % at most with 20 bits), so every double has a code and none is clamped.
For each binary resolution there is one
summary of how many values lie in each of its intervals: plain counters where the intervals
are no more than ``width``, else a signed Count-Sketch of ``depth`` rows of ``width``
counters.  Summaries are arrays of integers: those of separate days, files or partitions are
merged by addition, and values are deleted by subtraction.  A rank is inverted by descending
the resolutions, for groups of every size.

A worker holds the codes it has met, in all at most ``MAX_CODES``, and then passes on one
summary for each group and day, so its memory is bounded whatever the distribution.  A summary
of fewer values than a quarter of the counters travels as its list of codes, which is
shorter and stands for the same counters; it is made counters before anything is read off.  Summaries are
merged as a tree of at most ``FAN`` at a time, so a group with most rows costs its number of summaries, not rows.

Error.  A sketched interval's count has variance of at most F2 / width (F2: sum of squared
counts of its resolution, read off the sketch).  ``rank_error`` is three standard
deviations of the sum over the sketched resolutions; ``low`` and ``high`` are the values at the
ranks that far away, widened to the ends of their codes.

Defined results.  Null, NaN, infinite and -1 scores are not measured and never count; a run
delivered again (equal model_id, task_id and run_at) counts once, with its latest measured
delivery; runs that lack one of the three count each.  Null names form a group of their own.
Groups without values do not appear; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.categories import canonical
from benchloom.session import cut

PERCENTS = (5, 10, 25, 50, 75, 90, 95, 99)
#: Codes a worker holds before it passes summaries on, and summaries that are merged at a time.
MAX_CODES, FAN = 4_000_000, 32
SUMMARY = "domain string, task_category string, day date, n bigint, least double, most double, counts binary"


@dataclass(frozen=True)
class Layout:
    """Encoding and size of a summary; summaries add up only if theirs are equal."""

    lo: float = 0.0
    hi: float = 100.0
    bits: int = 20
    width: int = 2048
    depth: int = 5
    seed: int = 20

    @property
    def plain(self) -> int:
        """The finest resolution with plain counters."""
        return min(self.bits, self.width.bit_length() - 1)

    @property
    def size(self) -> int:
        return (2 << self.plain) - 2 + (self.bits - self.plain) * self.depth * self.width

    def start(self, level: int) -> int:
        """Where the counters of a resolution begin."""
        if level <= self.plain:
            return (1 << level) - 2
        return (2 << self.plain) - 2 + (level - self.plain - 1) * self.depth * self.width

    @property
    def tail(self) -> int:
        """Codes on either side of the expected range."""
        return 1 << (self.bits - 3)

    @property
    def core(self) -> int:
        return (1 << self.bits) - 2 * self.tail

    def steps(self) -> tuple[int, int]:
        """Bits that codes below and above the range leave out."""
        below, above = ordered(self.lo) - ordered(-np.inf), ordered(np.inf) - ordered(self.hi)
        return (max(0, int(x).bit_length() - self.bits + 3) for x in (below, above))

    def encode(self, values: np.ndarray) -> np.ndarray:
        down, up = (np.uint64(x) for x in self.steps())
        place = ordered(values)
        with np.errstate(over="ignore", invalid="ignore"):
            inside = self.tail + np.clip(np.floor((np.clip(values, self.lo, self.hi) - self.lo) * (self.core / (self.hi - self.lo))), 0, self.core - 1).astype(np.int64)
            below = self.tail - 1 - ((ordered(self.lo) - np.uint64(1) - place) >> down).astype(np.int64)
            above = self.tail + self.core + ((place - ordered(self.hi) - np.uint64(1)) >> up).astype(np.int64)
        return np.where(values < self.lo, below, np.where(values > self.hi, above, inside))

    def decode(self, code: int, part: float = 0.5) -> float:
        """The least value of a code (0), the greatest (1), or one between."""
        down, up = self.steps()
        k = code - self.tail
        if 0 <= k < self.core:
            return self.lo + (k + part) * (self.hi - self.lo) / self.core
        if k < 0:
            most = int(ordered(self.lo)) - 1 - ((-k - 1) << down)
            least = most - (1 << down) + 1
        else:
            least = int(ordered(self.hi)) + 1 + ((k - self.core) << up)
            most = least + (1 << up) - 1
        return value_at(least) * (1 - part) + value_at(most) * part

    def cells(self, level: int, nodes: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Counter and sign of intervals in one row of a sketch."""
        a, b = factors(self.seed, level, row)
        h = nodes.astype(np.uint64) * a
        h = (h ^ (h >> np.uint64(31))) * b
        counter = (h >> np.uint64(64 - self.plain)).astype(np.int64)
        sign = 1 - 2 * ((h >> np.uint64(63 - self.plain)) & np.uint64(1)).astype(np.int64)
        return self.start(level) + row * self.width + counter, sign

    def counters(self, codes: np.ndarray) -> np.ndarray:
        """The counters of a list of codes."""
        out = np.zeros(self.size, np.int64)
        for level in range(1, self.bits + 1):
            nodes = codes >> (self.bits - level)
            if level <= self.plain:
                out[self.start(level) : self.start(level) + (1 << level)] = np.bincount(nodes, minlength=1 << level)
            else:
                for row in range(self.depth):
                    cell, sign = self.cells(level, nodes, row)
                    at = self.start(level) + row * self.width
                    out[at : at + self.width] = np.bincount(cell - at, weights=sign, minlength=self.width).astype(np.int64)
        return out

    def count(self, summary: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        """How many values lie in some intervals, by the median of the rows where they are sketched."""
        if level <= self.plain:
            return summary[self.start(level) + nodes].astype(float)
        rows = (self.cells(level, nodes, row) for row in range(self.depth))
        return np.median([summary[cell] * sign for cell, sign in rows], axis=0)

    def invert(self, summary: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The codes of the values at some ranks (1 is the least)."""
        nodes, before = np.zeros(len(ranks), np.int64), np.zeros(len(ranks))
        for level in range(1, self.bits + 1):
            nodes = nodes * 2
            left = np.maximum(0.0, self.count(summary, level, nodes))
            right = before + left < ranks
            before += np.where(right, left, 0.0)
            nodes += right
        return nodes

    def rank_error(self, summary: np.ndarray) -> float:
        total = 0.0
        for level in range(self.plain + 1, self.bits + 1):
            rows = summary[self.start(level) : self.start(level) + self.depth * self.width].reshape(self.depth, self.width)
            total += float(np.median((rows.astype(np.float64) ** 2).sum(axis=1))) / self.width
        return 3.0 * total**0.5


@lru_cache(4096)
def factors(seed: int, level: int, row: int) -> tuple[np.uint64, np.uint64]:
    """The odd multipliers of one row of a resolution's sketch."""
    rng = np.random.RandomState((seed * 64 + level) * 64 + row)
    a, b = (rng.randint(0, 1 << 32, 2, dtype=np.uint64) << np.uint64(32)) | rng.randint(0, 1 << 32, 2, dtype=np.uint64) | np.uint64(1)
    return a, b


def ordered(values: np.ndarray | float) -> np.ndarray:
    """The bits of doubles as integers in the order of the values; -0 as 0."""
    raw = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))


def value_at(place: int) -> float:
    """The double at a place of that order, within the finite ones."""
    place = min(max(place, int(ordered(-np.finfo(float).max))), int(ordered(np.finfo(float).max)))
    return float(np.array(place ^ (1 << 63) if place >> 63 else place ^ ((1 << 64) - 1), np.uint64).view(np.float64))


def pack(numbers: np.ndarray, kind: int) -> bytes:
    """Counters (kind 0) or codes (kind 1) in 2, 4 or 8 bytes each, after a byte that says which."""
    top = int(np.abs(numbers).max(initial=0))
    n = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([n | kind << 4]) + numbers.astype(f"<i{n}").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, int]:
    return np.frombuffer(data, dtype=f"<i{data[0] & 15}", offset=1).astype(np.int64), data[0] >> 4


def summary_of(codes: np.ndarray, layout: Layout) -> bytes:
    """Codes as such while they are few, else counters."""
    return pack(np.sort(codes), 1) if len(codes) <= layout.size // 4 else pack(layout.counters(codes), 0)


def dense(data: bytes, layout: Layout) -> np.ndarray:
    numbers, kind = unpack(data)
    return layout.counters(numbers) if kind else numbers


def runs(results: DataFrame, aliases: DataFrame) -> DataFrame:
    """domain, task_category, day, value: each measured run once.

    One shuffle: deliveries of a run meet by (day, salt), which its key implies.
    """
    score = F.col("scored.weighted_score")
    rows = results.select("result_id", "model_id", "task_id", "run_at", "ingested_at", "domain", "task_category", score.alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") != -1.0))
    lone = F.when(F.col("model_id").isNull() | F.col("task_id").isNull() | F.col("run_at").isNull(), F.col("result_id"))
    rows = rows.withColumn("lone", lone).withColumn("day", F.to_date("run_at"))
    last = F.max_by(F.struct("domain", "task_category", "value"), F.struct("ingested_at", "result_id"))
    salts = max(16, int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("model_id", "task_id", "lone"), F.lit(salts)).cast("int")
    rows = rows.withColumn("salt", salt).repartition("day", "salt")
    rows = rows.groupBy("day", "salt", "model_id", "task_id", "run_at", "lone").agg(last.alias("r")).select("day", "r.*")
    for field in ("domain", "task_category"):
        rows = canonical(rows, aliases, field, field, f"c_{field}")
    return rows.select(F.col("c_domain").alias("domain"), F.col("c_task_category").alias("task_category"), "day", "value")


def summaries(values: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Partial summaries by domain, task_category and day; those of one key add up."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = ["domain", "task_category", "day"]

        def emit() -> pd.DataFrame:
            group, codes, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(group, kind="stable")
            codes, value, begins = codes[order], value[order], np.cumsum(np.bincount(group)) - np.bincount(group)
            least, most = np.minimum.reduceat(value, begins), np.maximum.reduceat(value, begins)
            parts = np.split(codes, begins[1:])
            rows = [(*key, len(parts[k]), least[k], most[k], summary_of(parts[k], layout)) for key, k in ids.items()]
            ids.clear()
            held.clear()
            return pd.DataFrame(rows, columns=[*names, "n", "least", "most", "counts"])

        for pdf in batches:
            if pdf.empty:
                continue
            which = pdf.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            firsts = pdf[names].iloc[np.unique(which, return_index=True)[1]].astype(object)
            keys = list(firsts.where(firsts.notna(), None).itertuples(index=False, name=None))
            own = np.array([ids.setdefault(key, len(ids)) for key in keys])
            value = pdf["value"].to_numpy(np.float64)
            held.append((own[which], layout.encode(value), value))
            if sum(len(h[1]) for h in held) >= MAX_CODES:
                yield emit()
        if held:
            yield emit()

    return values.mapInPandas(fill, SUMMARY)


def merge(parts: DataFrame, keys: list[str], layout: Layout = Layout(), sign: str | None = None) -> DataFrame:
    """One summary a group: counters are added, or subtracted where ``sign`` is -1.

    The least and greatest value of a group from which values were deleted may be those of deleted values.
    """
    parts = parts.select(*keys, "n", "least", "most", "counts", (F.col(sign) if sign else F.lit(1)).alias("sign"), F.xxhash64(F.monotonically_increasing_id()).alias("part"))
    parts = cut(parts)
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        parts = cut(added(parts.withColumn("part", F.pmod("part", F.lit(most))), [*keys, "part"], layout).withColumns({"sign": F.lit(1), "part": F.xxhash64("part")}))
    return added(parts.drop("part"), keys, layout)


def added(parts: DataFrame, keys: list[str], layout: Layout) -> DataFrame:
    """The sum of the summaries of each key, which are few."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n, lists, total = int((pdf["n"] * pdf["sign"]).sum()), [], np.zeros(layout.size, np.int64)
        few = n <= layout.size // 4 and (pdf["sign"] == 1).all()
        for data, sign in zip(pdf["counts"], pdf["sign"]):
            numbers, kind = unpack(data)
            if kind and sign == 1:
                lists.append(numbers)
            else:
                few = False
                total += sign * dense(data, layout)
        codes = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        counts = pack(np.sort(codes), 1) if few else pack(total + layout.counters(codes), 0)
        row = {c: [pdf[c].iloc[0]] for c in keys} | {"n": [n], "least": [pdf["least"].min()], "most": [pdf["most"].max()], "counts": [counts]}
        return pd.DataFrame(row)

    types = {f.name: f.dataType.simpleString() for f in parts.schema}
    return parts.groupBy(*keys).applyInPandas(add, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", n bigint, least double, most double, counts binary")


def read_off(merged: DataFrame, keys: list[str], layout: Layout = Layout(), percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """percent, value, low, high and the bound of each group; the value at rank ceil(p * n)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                summary, n = dense(rec["counts"], layout), int(rec["n"])
                if n <= 0:
                    continue
                error = layout.rank_error(summary)
                ranks = np.maximum(1.0, np.ceil(np.array(percents) * n / 100))
                codes = layout.invert(summary, np.concatenate([ranks, np.maximum(1.0, ranks - error), np.minimum(float(n), ranks + error)])).reshape(3, -1).tolist()
                clip = lambda v, rec=rec: min(max(v, rec["least"]), rec["most"])
                for p, *at in zip(percents, *codes):
                    out.append((*(rec[k] for k in keys), n, p, clip(layout.decode(at[0])), clip(layout.decode(at[1], 0)), clip(layout.decode(at[2], 1)), error, error / n))
            yield pd.DataFrame(out, columns=[*keys, "n", "percent", "value", "low", "high", "rank_error", "rank_error_share"])

    types = {f.name: f.dataType.simpleString() for f in merged.schema}
    return merged.mapInPandas(read, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, percent int, value double, low double, high double, rank_error double, rank_error_share double")


def daily(results: DataFrame, aliases: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """One summary for each domain, task_category and day."""
    return merge(summaries(runs(results, aliases), layout), ["domain", "task_category", "day"], layout)


def totals(results: DataFrame, aliases: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """How many values each domain and task_category has, and the least and greatest of them, off the merged summaries."""
    return merge(summaries(runs(results, aliases), layout), ["domain", "task_category"], layout).drop("counts")


def percentiles(results: DataFrame, aliases: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Percentiles for every domain and task_category, from the summaries of days."""
    keys = ["domain", "task_category"]
    return read_off(merge(summaries(runs(results, aliases), layout), keys, layout), keys, layout)
