"""Near-duplicate records by a chosen-path join (problem 4).

Two texts are near if their sets of distinct words share at least ``threshold`` of the words
found in either.  Sets are never compared all with all:

1. Texts with one set of words become one record (an order-free 128-bit hash of the set); the
   same pass counts words in a histogram of fixed size.
2. Each run samples ``picks`` words of every record by exponential clocks that all records
   share, so that near records sample much the same words.  In every other run rarer words
   have faster clocks (but those in fewer than ``level`` of the records weigh alike); in the others all
   words weigh alike, which finds groups whose shared words are more common than those that edits brought in.  From the
   sampled words each record branches into paths: a path takes one more word until the
   product of its words' frequencies falls below ``bucket / records`` (or ``depth`` words).
   Records that chose the same path form a bucket of a few records in expectation.
3. Buckets that turn out larger than ``cap`` are split again, ``levels`` times: each record goes on
   to ``branch`` further words, drawn anew for every bucket.  A pair at the threshold of 0.7 stays together in
   one child at least with a probability of 0.97, one that shares less than a third soon parts.
4. Buckets are compared within, first by odd sketches: the bits in which two sketches differ
   never exceed the words in which the sets differ, so this filter loses nothing.  Buckets still
   above ``cap`` consist of records much alike; they are cut into blocks and every pair of blocks is
   compared once, each as a task of its own: no pair in them is left out.
5. Candidates are verified on the sets themselves.
6. Runs repeat until the recall asked for.  How many near pairs are still unseen is estimated from
   how many were found by one run only and by two (``unseen``, Chao's estimate), so the data
   themselves say how hard their pairs are.

Defined results.  Null texts and those under ``min_chars`` code points never count; texts
without words have no partner.  Repeated deliveries count: all rows of one record are pairs of
each other.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.session import cut, join_dimension

#: Counters of the word histogram: 2 MB when broadcast, whatever the vocabulary.
HISTOGRAM_BITS = 18
#: Records up to which their ids, and pairs up to which they are broadcast.
ID_ROWS, PAIR_ROWS = 1_000_000, 200_000
M = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Plan:
    """Parameters of the join."""

    threshold: float = 0.7
    min_chars: int = 50
    recall: float = 0.999
    runs: int = 3  # to begin with
    more: int = 2  # at a time, while the recall is not reached
    picks: int = 5
    depth: int = 4
    bucket: int = 32
    cap: int = 1024
    levels: int = 2
    branch: int = 3
    power: float = 3.0
    level: float = 0.02


def unseen(once: int, twice: int, runs: int) -> float:
    """How many pairs no run has found, from those that one and that two of the ``runs`` have."""
    return (runs - 1) / runs * once * (once - 1) / (2 * (twice + 1))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(rows: DataFrame, fields: tuple[str, ...], min_chars: int) -> DataFrame:
    """(row_id, field, text): each text that counts, in lower case."""
    texts = [F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)]
    rows = rows.select("row_id", F.explode(F.array(*texts)).alias("t")).select("row_id", "t.*").where(F.char_length("text") >= min_chars)
    return rows.withColumn("text", F.lower("text")).where(F.col("text").rlike("[a-z0-9]"))


def word_sets(rows: DataFrame, fields: tuple[str, ...], min_chars: int) -> DataFrame:
    """(row_id, field, words): hashes of the distinct words of each text that counts."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)))
    return texts_of(rows, fields, min_chars).select("row_id", "field", F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
#: Bytes of text that are hashed at once, and texts of one batch.
STRETCH, BATCH = 1 << 22, 1 << 15


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the distinct words of up to ``BATCH`` lower-case texts, sorted within each, and where each text begins.

    A word's hash is a polynomial in its bytes, read off running sums over all bytes: no loop over words.
    """
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = LETTER[data]
    # An edge lies where letters begin or end, and wherever a text begins.
    before = np.r_[False, letter[:-1]]
    begins = at[:-1][at[:-1] < len(data)]
    before[begins] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.r_[letter[1:], False]
    last = at[1:-1] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(letter & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + STRETCH, "right")))
        lo, hi = int(starts[k]), int(ends[m - 1])
        part = np.where(letter[lo:hi], data[lo:hi], 0).astype(np.uint64)
        power = np.full(len(part), BASE, np.uint64)
        power[0] = 1
        total = np.r_[np.uint64(0), np.cumsum(part * np.multiply.accumulate(power))]
        power[1:] = INVERSE
        back = np.multiply.accumulate(power)
        s, e = starts[k:m] - lo, ends[k:m] - lo
        hashes[k:m] = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)
        k = m
    text = (np.searchsorted(at, starts, "right") - 1).astype(np.uint64)
    both = np.sort(text << np.uint64(48) | mix(hashes, 23) >> np.uint64(16))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both & np.uint64((1 << 48) - 1), np.searchsorted(both >> np.uint64(48), np.arange(len(texts) + 1)).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of at most ``BATCH`` texts with their words and offsets."""
    for whole in batches:
        for first in range(0, whole.num_rows, BATCH):
            b = whole.slice(first, BATCH)
            yield b, *distinct_words(b.column("text"))


def survey(texts: DataFrame) -> DataFrame:
    """One pass: (0, field, hi, lo, row_id) for each text and (1, -, bucket, count, -) of the histogram of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(1 << HISTOGRAM_BITS, np.int64)

        def out(kind: int, field: np.ndarray, hi: np.ndarray, lo: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), kind, np.int8)), pa.array(field, pa.int8()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(row, pa.int64())], names=["kind", "field", "hi", "lo", "row_id"])

        for b, words, offsets in pieces(batches):
            histogram += np.bincount(bucket_of(words), minlength=1 << HISTOGRAM_BITS)
            hi, lo = np.add.reduceat(mix(words, 2), offsets[:-1]).view(np.int64), np.add.reduceat(mix(words, 3), offsets[:-1]).view(np.int64)
            yield out(0, b.column("field").to_numpy(), hi, lo, b.column("row_id").to_numpy())
        used = np.flatnonzero(histogram)
        yield out(1, np.zeros(len(used), np.int8), used, histogram[used], np.zeros(len(used), np.int64))

    return texts.mapInArrow(scan, "kind tinyint, field tinyint, hi bigint, lo bigint, row_id bigint")


def bucket_of(words: np.ndarray) -> np.ndarray:
    """The counters of words in the histogram."""
    return (mix(words, 1) >> np.uint64(64 - HISTOGRAM_BITS)).astype(np.int64)


def shares_of(words: np.ndarray, shares: np.ndarray, records: int) -> np.ndarray:
    """The frequency of each word, by the histogram's ``shares``."""
    return np.maximum(shares[bucket_of(words)].astype(np.float64), 1.0 / max(records, 1))


#: The run in which a path was chosen is kept in the last bits of its hash.
RUN_BITS = 8


def marked(path: np.ndarray, run: int | np.ndarray) -> np.ndarray:
    """A path's hash with the run in its last bits."""
    return path >> np.uint64(RUN_BITS) << np.uint64(RUN_BITS) | np.asarray(run).astype(np.uint64) & np.uint64((1 << RUN_BITS) - 1)


def paths_of(words: np.ndarray, offsets: np.ndarray, share: np.ndarray, records: int, plan: Plan, runs: range) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) of all paths that a batch chose in some runs; ``share`` is the frequency of each word."""
    limit = plan.bucket / max(records, 1)
    rare = np.maximum(-np.log(np.clip(share, plan.level, 0.999)), 0.05) ** plan.power
    alone = share * records < 1.5  # a word of one text alone cannot be shared
    rates = [np.where(alone, 1e-6, rare), np.where(alone, 1e-6, 1.0)]
    sizes = np.diff(offsets)
    who, where = [], []
    for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)):
        rows = np.flatnonzero((sizes <= width) & (sizes > width // 2))
        for first in range(0, len(rows), max(1, 2_000_000 // int(width))):
            some = rows[first : first + max(1, 2_000_000 // int(width))]
            at = offsets[some][:, None] + np.arange(width)
            there = np.arange(width) < sizes[some][:, None]
            at = np.where(there, at, 0)
            token, p = words[at], share[at]
            k = min(plan.picks, int(width))
            for run in runs:
                rate = rates[run % 2][at]
                u = (mix(token, 11 + run) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
                clock = np.where(there, -np.log(u) / rate, np.inf)
                pick = np.argpartition(clock, k - 1, axis=1)[:, :k]
                ok, q = np.take_along_axis(there, pick, 1), np.take_along_axis(p, pick, 1)
                h = mix(np.take_along_axis(token, pick, 1), 101 + run)
                open_: dict[tuple[int, ...], np.ndarray] = {(): np.ones(len(some), bool)}
                for d in range(1, min(plan.depth, k) + 1):
                    still: dict[tuple[int, ...], np.ndarray] = {}
                    for c in combinations(range(k), d):
                        # A path goes on from paths that are all still open.
                        mine = ok[:, list(c)].all(axis=1)
                        for left in combinations(c, d - 1):
                            mine = mine & open_.get(left, np.zeros(len(some), bool))
                        if not mine.any():
                            continue
                        full = q[:, list(c)].prod(axis=1) > limit
                        last = d == min(plan.depth, k)
                        end = mine & (~full | last | (ok.sum(axis=1) == d))
                        if end.any():
                            who.append(some[end])
                            where.append(marked(mix(h[end][:, list(c)].sum(axis=1, dtype=np.uint64), run * 8 + d), run))
                        still[c] = mine & full
                    open_ = still
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(where)


def odd_sketches(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: the parity of how many of its words fall on each."""
    h = mix(words, 7) >> np.uint64(57)
    bit = np.left_shift(np.uint64(1), h & np.uint64(63))
    low = h < 64
    return np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), offsets[:-1]), np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), offsets[:-1])


ENTRY = "path bigint, rec bigint, s1 bigint, s2 bigint, n int, side tinyint"


def entry(path: np.ndarray, rec: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [path.view(np.int64), rec, s1.view(np.int64), s2.view(np.int64), n.astype(np.int32), np.full(len(path), BOTH, np.int8)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["path", "rec", "s1", "s2", "n", "side"])


def entries(texts: DataFrame, histogram: np.ndarray, records: int, plan: Plan, runs: range) -> DataFrame:
    """A row for each path that a record chose. A record is 2 * row_id + field, for up to 2 fields."""
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(1.0, histogram / max(records, 1)).astype(np.float32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, offsets in pieces(batches):
            who, path = paths_of(words, offsets, shares_of(words, shared.value, records), records, plan, runs)
            s1, s2 = odd_sketches(words, offsets)
            field = b.column("field").to_numpy().astype(np.int64)
            path = marked(mix(path + field[who].astype(np.uint64), 5), path)
            yield entry(path, (b.column("row_id").to_numpy() * 2 + field)[who], s1[who], s2[who], np.diff(offsets)[who])

    return texts.mapInArrow(choose, ENTRY)


def children(texts: DataFrame, over: DataFrame, plan: Plan) -> DataFrame:
    """The entries of large buckets again, each in ``branch`` smaller buckets, by one more word drawn for its bucket."""
    owned = over.groupBy("rec").agg(F.collect_list("path").alias("paths"))
    named = texts.withColumn("rec", F.col("row_id") * 2 + F.col("field"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, offsets in pieces(batches):
            s1, s2 = odd_sketches(words, offsets)
            who, where = [], []
            for i, paths in enumerate(b.column("paths").to_pylist()):
                path = np.repeat(np.array(paths, np.int64).view(np.uint64), plan.branch)
                seed = mix(path + np.tile(np.arange(plan.branch, dtype=np.uint64), len(paths)), 31)
                clock = mix(words[offsets[i] : offsets[i + 1]][None, :] ^ seed[:, None], 37)
                where.append(marked(mix(seed ^ clock.min(axis=1), 41), path))
                who.append(np.full(len(path), i))
            who, path = np.concatenate(who), np.concatenate(where)
            yield entry(path, b.column("rec").to_numpy()[who], s1[who], s2[who], np.diff(offsets)[who])

    return named.join(owned, "rec").select("rec", "text", "paths").mapInArrow(choose, ENTRY)


def near(i: np.ndarray, j: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may be near: by size, then by the bits in which their sketches differ."""
    a, b = n[i].astype(np.float64), n[j].astype(np.float64)
    differ = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
    return (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (a + b) + 1e-9)


OUT = "kind tinyint, a bigint, b bigint, s1 bigint, s2 bigint, n int"
#: Sides of a bucket: records of different sides are compared, and those of this one with each other.
BOTH = 2


def compare(rows: DataFrame, plan: Plan, cap: int | None) -> DataFrame:
    """Rows sorted by path within partitions -> (0, a, b, run) candidates, (1, rec, path, ...) of buckets above ``cap``.

    A bucket is a run of equal paths; runs are compared by offsets 1, 2, ... all at once.
    """
    width = cap or 1 << 62

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 6
        big: int | None = None  # the path of a bucket that is being passed on

        def out(kind: int, a: np.ndarray, b: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
            arrays = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), pa.array(rest[2].astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "a", "b", "s1", "s2", "n"])

        def pairs(path: np.ndarray, rec: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
            u1, u2, at, d = s1.view(np.uint64), s2.view(np.uint64), np.arange(len(path)), 1
            got: list[np.ndarray] = []
            while len(at):
                at = at[at + d < len(path)]
                at = at[path[at] == path[at + d]]
                ok = at[near(at, at + d, u1, u2, n, plan.threshold) & (rec[at] != rec[at + d]) & ((side[at] != side[at + d]) | (side[at] == BOTH))]
                if len(ok):
                    got.append(np.stack([np.minimum(rec[ok], rec[ok + d]), np.maximum(rec[ok], rec[ok + d]), path[ok] & ((1 << RUN_BITS) - 1)], 1))
                d += 1
                if sum(map(len, got)) > 1_000_000:
                    yield from told(got)
                    got = []
            yield from told(got)

        def told(got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if got:
                found = np.unique(np.concatenate(got), axis=0)
                none = np.zeros(len(found), np.int64)
                yield out(0, found[:, 0], found[:, 1], found[:, 2], none, none)

        for b in batches:
            new = [b.column(c).to_numpy() for c in ("path", "rec", "s1", "s2", "n", "side")]
            held = [np.concatenate([x, y]) for x, y in zip(held, new)]
            path = held[0]
            if not len(path):
                continue
            begins = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            lengths = np.diff(np.r_[begins, len(path)])
            large = lengths > width
            if big is not None and path[0] == big:
                large[0] = True
            last = begins[-1]
            pass_on = np.repeat(large, lengths)
            if not large[-1]:
                pass_on[last:] = False
            if pass_on.any():
                yield out(1, held[1][pass_on], path[pass_on], held[2][pass_on], held[3][pass_on], held[4][pass_on])
            done = ~pass_on
            if large[-1]:
                big = int(path[-1])
                keep = np.zeros(len(path), bool)
            else:
                keep = np.zeros(len(path), bool)
                keep[last:] = True
            done &= ~keep
            if done.any():
                yield from pairs(*(x[done] for x in held))
            held = [x[keep] for x in held]
        if len(held[0]):
            yield from pairs(*held)

    return rows.mapInArrow(scan, OUT)


def buckets_of(out: DataFrame) -> DataFrame:
    """The entries of buckets that were passed on."""
    return out.where("kind = 1").select(F.col("b").alias("path"), F.col("a").alias("rec"), "s1", "s2", "n", F.lit(BOTH).cast("tinyint").alias("side"))


def by_path(rows: DataFrame) -> DataFrame:
    return rows.repartition("path").sortWithinPartitions("path")


def block_pairs(over: DataFrame, plan: Plan) -> DataFrame:
    """All pairs of large buckets: every two blocks of about ``cap`` records are compared once, and each block within itself."""
    counts = over.groupBy("path").agg(F.ceil(F.count("*") / plan.cap).cast("int").alias("blocks"))
    rows = join_dimension(over, counts, ["path"]).withColumn("own", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    key = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    run = F.col("path").bitwiseAND((1 << RUN_BITS) - 1)
    side = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), 0).otherwise(1)
    key = F.shiftleft(F.shiftright(key, RUN_BITS), RUN_BITS).bitwiseOR(run)
    return compare(by_path(rows.select(key.alias("path"), "rec", "s1", "s2", "n", side.cast("tinyint").alias("side"))), plan, None)


def candidates(texts: DataFrame, histogram: np.ndarray, records: int, plan: Plan, runs: range) -> DataFrame:
    """(a, b, times): pairs that met in a bucket of some runs, and in how many."""
    out = cut(compare(by_path(entries(texts, histogram, records, plan, runs)), plan, plan.cap))
    pairs, over = out.where("kind = 0"), buckets_of(out)
    for level in range(plan.levels + 1):
        if not over.limit(1).count():
            break
        if level == plan.levels:
            pairs = pairs.unionByName(block_pairs(over, plan))
        else:
            out = cut(compare(by_path(children(texts, over, plan)), plan, plan.cap))
            pairs, over = pairs.unionByName(out.where("kind = 0")), buckets_of(out)
    # The run of a candidate is in s1.
    return pairs.groupBy("a", "b").agg(F.expr("cast(bit_count(bit_or(shiftleft(1L, cast(s1 % 64 as int)))) as bigint)").alias("times"))


def records(rows: DataFrame, fields: tuple[str, ...], plan: Plan) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """Texts; (rec, row_id, field, copies) of all rows; the word histogram; how many texts there are."""
    texts = texts_of(rows, fields, plan.min_chars)
    seen = cut(survey(texts))
    counts = seen.where("kind = 1").groupBy("hi").agg(F.sum("lo").alias("n")).toPandas()
    histogram = np.zeros(1 << HISTOGRAM_BITS, np.int64)
    histogram[counts["hi"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    seen = seen.where("kind = 0")
    groups = seen.groupBy("field", "hi", "lo").agg(F.min("row_id").alias("first"), F.count("*").alias("copies"))
    members = cut(seen.join(groups, ["field", "hi", "lo"]).select((F.col("first") * 2 + F.col("field")).alias("rec"), "row_id", "field", "copies"))
    return texts, members, histogram, members.count()


def verified(rows: DataFrame, pairs: DataFrame, fields: tuple[str, ...], plan: Plan) -> DataFrame:
    """The pairs of records that are near, by their words."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct().select(F.expr("shiftright(rec, 1)").alias("row_id"))
    texts = join_dimension(rows, ends.distinct(), ["row_id"], "left_semi", PAIR_ROWS)
    words = word_sets(texts, fields, plan.min_chars).select((F.col("row_id") * 2 + F.col("field")).alias("rec"), "words")
    few = pairs.limit(PAIR_ROWS + 1).count() <= PAIR_ROWS
    side = lambda c: words.select(F.col("rec").alias(c), F.col("words").alias(f"w_{c}")).join(F.broadcast(pairs) if few else pairs, c)
    both = side("a").join(side("b").drop("times"), ["a", "b"])
    common = F.size(F.array_intersect("w_a", "w_b"))
    union = F.size("w_a") + F.size("w_b") - common
    return both.where(common * 1000 >= union * round(plan.threshold * 1000)).select("a", "b", "times")


def record_pairs(rows: DataFrame, fields: tuple[str, ...], plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """(a, b) of near records, verified; and the members of all records."""
    if len(fields) > 2:
        raise ValueError("at most two fields at once")
    texts, members, histogram, total = records(rows, fields, plan)
    firsts = members.where(F.col("rec") == F.col("row_id") * 2 + F.col("field")).select("row_id", "field")
    alone = join_dimension(texts, firsts, ["row_id", "field"], "left_semi", ID_ROWS)
    pairs, done, batch = None, 0, plan.runs
    while True:
        met = cut(candidates(alone, histogram, total, plan, range(done, done + batch)))
        if pairs is None:
            pairs = cut(verified(rows, met, fields, plan))
        else:
            new = cut(verified(rows, met.join(pairs, ["a", "b"], "left_anti"), fields, plan))
            again = pairs.join(met.withColumnRenamed("times", "more"), ["a", "b"], "left").select("a", "b", (F.col("times") + F.coalesce("more", F.lit(0))).alias("times"))
            pairs = cut(again.unionByName(new))
        done += batch
        batch = plan.more
        n, once, twice = pairs.agg(F.count("*"), F.count_if(F.col("times") == 1), F.count_if(F.col("times") == 2)).first()
        if unseen(once, twice, done) <= (1 - plan.recall) * n:
            return pairs.select("a", "b"), members


def found(rows: DataFrame, fields: tuple[str, ...] = ("prompt", "video_generation_prompt"), plan: Plan = Plan()) -> DataFrame:
    """(row_a, row_b, field_name), row_a < row_b: all near pairs of rows, copies included."""
    pairs, members = record_pairs(rows, fields, plan)
    m = lambda rec, row: members.select(F.col("rec").alias(rec), F.col("row_id").alias(row))
    across = pairs.join(m("a", "x"), "a").join(m("b", "y"), "b").select(F.expr("a % 2").alias("field"), "x", "y")
    # Copies meet by blocks, so that no task has all pairs of a text that many rows hold.
    blocks = F.ceil(F.col("copies") / plan.cap).cast("int")
    copies = members.where("copies > 1").withColumn("blocks", blocks)
    left = copies.select("rec", "field", F.col("row_id").alias("x"), F.pmod(F.xxhash64("row_id"), "blocks").cast("int").alias("block"))
    right = copies.select("rec", F.col("row_id").alias("y"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    within = left.join(right, ["rec", "block"]).where("x < y").select("field", "x", "y")
    named = F.element_at(F.array(*map(F.lit, fields)), (F.col("field") + 1).cast("int"))
    return across.unionByName(within).select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"), named.alias("field_name"))


def components(edges: DataFrame) -> DataFrame:
    """(a, label): the least record linked to each record of ``edges``, which hold every pair both ways.

    Each round every record goes to the least of itself and its neighbours in an order drawn anew,
    and from there once more; what went to one place is one record of the next round.  Half of the
    records are left in expectation, whatever the links look like, and the one last in the order
    never is, so the rounds end by themselves, after about the logarithm of the longest chain.
    """
    labels, rest, turn = cut(edges.select("a").distinct().withColumn("label", F.col("a"))), edges, 0
    while rest.limit(1).count():
        order = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("place"), F.col(c).alias("to"))
        step = rest.groupBy("a").agg(F.min(order("b")).alias("least")).select("a", F.least(order("a"), "least")["to"].alias("to"))
        step = cut(step)
        step = cut(step.join(step.select(F.col("a").alias("to"), F.col("to").alias("further")), "to").select("a", F.col("further").alias("to")))
        labels = cut(labels.join(step.select(F.col("a").alias("label"), "to"), "label", "left").select("a", F.coalesce("to", "label").alias("label")))
        ends = rest.join(step.select("a", F.col("to").alias("x")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        rest, turn = cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()), turn + 1
    least = labels.groupBy("label").agg(F.min("a").alias("least"))
    return labels.join(least, "label").select("a", F.col("least").alias("label"))


def groups(rows: DataFrame, fields: tuple[str, ...] = ("prompt", "video_generation_prompt"), plan: Plan = Plan()) -> DataFrame:
    """(row_id, field_name, class_id, links): one row a text; its class is the least row of all linked to it.

    ``links`` counts near records with other words and other copies.
    """
    pairs, members = record_pairs(rows, fields, plan)
    edges = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = components(edges)
    degree = edges.groupBy("a").agg(F.count("*").alias("near"))
    out = members.join(labels.join(degree, "a").withColumnRenamed("a", "rec"), "rec", "left")
    named = F.element_at(F.array(*map(F.lit, fields)), (F.col("field") + 1).cast("int"))
    return out.select("row_id", named.alias("field_name"), F.expr("shiftright(coalesce(label, rec), 1)").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
