"""The llm operators against brute force, exact encodings and planted cases."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benchloom.llm import mixing, nearpairs, quantiles, sampling, sentences, tokens
from benchloom.session import cut, table

D = "/root/testdata/sf0.001"


# -- 6: encoding ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def mine():
    e = tokens.TrieEncoder(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    return lambda s: next(e.encode_batch(iter([s])))


@pytest.mark.parametrize("text", ["", " ", "\n\n \t", "Hello world's  end", "<|endoftext|>", "a" * 3000, "ab" * 2000, "日本語のテキスト、です。", "ไทย ๑๒", "𝒳🙂‍↔️\x00​", "x\r\n\r\n  y", "'S 'S'T ½²"])
def test_encoding_equals_the_library(mine, reference, text):
    assert mine(text) == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(mine, reference, text):
    assert mine(text) == reference(text)


def test_encoding_of_the_table(spark, reference):
    docs = table(spark, D, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokens.encode(docs.withColumn("ids", F.lit("clash"))).collect():
        assert r["ids"] == (reference(texts[r["doc_id"]]) if texts[r["doc_id"]] else [])
    assert tokens.encode(docs.limit(0)).count() == 0


def test_a_full_trie_starts_anew(monkeypatch, reference):
    e = tokens.TrieEncoder(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    monkeypatch.setattr(tokens, "MAX_WORDS", 3)
    for s in ("one two three four five", "six one", "seven two"):
        assert next(e.encode_batch(iter([s]))) == reference(s)


def test_what_a_worker_keeps_is_bounded(monkeypatch, reference):
    e = tokens.TrieEncoder(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    monkeypatch.setattr(tokens, "MAX_PAIRS", 50)
    rng = np.random.default_rng(0)
    long = "".join(rng.choice([*"abcdefgh"], 30_000)) + " " + "é" * 2000 + " one two"
    assert list(e.encode_batch([long])) == [reference(long)]
    assert len(e.last) < 100 and len(e.words) == 2 and len(e.stable) <= 50
    assert list(e.count_batch(iter([long, None, "one two"]))) == [len(reference(long)), 0, 2]


# -- 7: mixing --------------------------------------------------------------------------------


def test_mixing(spark):
    docs, mixes = table(spark, D, "documents"), table(spark, D, "mix_targets")
    sizes = {r["doc_id"]: (r["source"], len(r["ids"])) for r in docs.select("doc_id", "source", tokens.token_ids(F.col("text")).alias("ids")).collect()}
    total = sum(n for _, n in sizes.values())
    held = {}
    for s, n in sizes.values():
        held[s] = held.get(s, 0) + n
    short = {(m["mix_id"], m["source"]) for m in mixes.collect() if held.get(m["source"], 0) * m["max_repeats"] < m["weight"] * m["size_ratio"] * total}
    assert {tuple(r) for r in mixing.found(docs, mixes).collect()} == short
    report = {(r["mix_id"], r["source"]): r for r in mixing.report(docs, mixes).collect()}
    drawn: dict = {}
    for r in mixing.selection(docs, mixes).collect():
        assert sizes[r["doc_id"]] == (r["source"], r["tokens"]) and r["copies"] <= report[r["mix_id"], r["source"]]["max_repeats"]
        key = (r["mix_id"], r["source"])
        drawn[key] = drawn.get(key, 0) + r["copies"] * r["tokens"]
    largest = {s: max(n for t, n in sizes.values() if t == s) for s in held}
    for key, r in report.items():
        assert drawn.get(key, 0) == r["reached"]
        if not r["short"]:
            assert abs(r["reached"] - r["target"]) <= largest[key[1]]


def test_mixing_dirt(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "word " * 10, None), (4, "x y", "b"), (4, "x y", "b")], "doc_id bigint, text string, source string")
    mixes = spark.createDataFrame([(1, "a", 0.5, 3, 1.0), (1, "none", 0.1, 3, 1.0), (1, "b", None, 1, 1.0), (1, "b", 0.1, None, 1.0)], "mix_id int, source string, weight double, max_repeats int, size_ratio double")
    assert {tuple(r) for r in mixing.found(docs, mixes).collect()} == {(1, "a"), (1, "none"), (1, "b")}
    assert mixing.found(docs.limit(0), mixes).count() == 0 and mixing.report(docs.limit(0), mixes).count() == 4


# -- 2: percentiles ---------------------------------------------------------------------------

RESULT = "result_id bigint, model_id bigint, task_id string, run_at timestamp_ntz, ingested_at timestamp_ntz, domain string, task_category string, scored struct<weighted_score double, num_axes int>, day string"


def result(i, value, model=1, task=None, day=0, domain="robotics", late=0):
    t = datetime(2026, 1, 1) + timedelta(days=day)
    return (i, model, f"t{i}" if task is None else task, t, t + timedelta(hours=late), domain, "Camera Motion-Inspection", (value, 1), "clash")


def test_percentiles_within_their_bounds(spark):
    rng = np.random.default_rng(1)
    values = np.r_[rng.uniform(0, 100, 15000), np.full(5000, 33.0)]
    df = spark.createDataFrame([result(i, float(v), day=i % 20) for i, v in enumerate(values)], RESULT)
    aliases = table(spark, D, "category_aliases")
    got = quantiles.percentiles(df, aliases).collect()
    exact = np.sort(values)
    assert {(r["domain"], r["task_category"]) for r in got} == {("embodied_robotics", "spatial_exploration_and_viewpoint")}
    for r in got:
        want = exact[int(np.ceil(r["percent"] * r["n"] / 100)) - 1]
        assert r["n"] == 20000 and r["low"] - 1e-9 <= want <= r["high"] + 1e-9
        at = np.searchsorted(exact, [r["value"] - 0.005, r["value"] + 0.005]) / 20000
        assert at[0] - r["rank_error_share"] <= r["percent"] / 100 <= at[1] + r["rank_error_share"] and r["rank_error_share"] < 0.06


def test_any_double_has_a_code():
    layout = quantiles.Layout()
    values = np.array([-np.finfo(float).max, -1e300, -7.5, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.5, 1.0, 33.0, 100.0, 1e6, 1e300, np.finfo(float).max])
    codes = layout.encode(values)
    assert (np.diff(codes) >= 0).all() and codes[4] == codes[5] and codes.min() >= 0 and codes.max() < 1 << layout.bits
    for v, c in zip(values, codes):
        assert layout.decode(int(c), 0) <= v <= layout.decode(int(c), 1)
        assert abs(layout.decode(int(c)) - v) <= (1e-4 if 0 <= v <= 100 else abs(v) * 0.016 + 1e-300)


def test_percentiles_of_any_range_and_size(spark):
    """Groups of 1 to 40,000 values, far beyond 0 to 100 and below it, all read off the sketch."""
    rng = np.random.default_rng(3)
    sizes = {"robotics": 1, "visual_security": 300, "construction": 40_000}
    values = [(d, float(v)) for d, n in sizes.items() for v in rng.normal(0, 1e6, n)]
    df = spark.createDataFrame([result(i, v, day=i % 3, domain=d) for i, (d, v) in enumerate(values)], RESULT)
    got = quantiles.percentiles(df, table(spark, D, "category_aliases")).collect()
    assert sorted({r["n"] for r in got}) == sorted(sizes.values())
    for r in got:
        own = np.sort([v for d, v in values if sizes[d] == r["n"]])
        want = own[int(np.ceil(r["percent"] * r["n"] / 100)) - 1]
        assert r["low"] <= want <= r["high"] and (r["n"] < 1000 or r["rank_error_share"] < 0.06)
        if r["n"] <= 300:
            assert abs(r["value"] - want) <= abs(want) * 0.016


def test_summaries_add_up_and_forget(spark, monkeypatch):
    layout = quantiles.Layout(bits=12, width=64)
    a, b = (np.random.default_rng(i).uniform(0, 100, 9000) for i in (1, 2))
    x, y = layout.counters(layout.encode(a)), layout.counters(layout.encode(b))
    both = layout.counters(layout.encode(np.r_[a, b]))
    assert (x + y == both).all() and (both - y == x).all()
    few = layout.encode(a[:100])
    rows = [("g", 9000, 0.0, 100.0, bytearray(quantiles.pack(x, 0)), 1), ("g", 9000, 0.0, 100.0, bytearray(quantiles.pack(both, 0)), 1), ("g", 9000, 0.0, 100.0, bytearray(quantiles.summary_of(layout.encode(a), layout)), -1)]
    rows += [("g", 100, 0.0, 100.0, bytearray(quantiles.pack(few, 1)), s) for s in (1, -1)] * 9 + [("h", 100, 0.0, 100.0, bytearray(quantiles.pack(few, 1)), 1)]
    monkeypatch.setattr(quantiles, "FAN", 3)
    m = {r["domain"]: r for r in quantiles.merge(spark.createDataFrame(rows, "domain string, n bigint, least double, most double, counts binary, sign int"), ["domain"], layout, sign="sign").collect()}
    assert m["g"]["n"] == 9000 and (quantiles.dense(m["g"]["counts"], layout) == both).all()
    assert m["h"]["n"] == 100 and (quantiles.dense(m["h"]["counts"], layout) == layout.counters(few)).all()


def test_percentile_dirt(spark):
    rows = [result(1, 10.0, task="a"), result(2, 90.0, task="a", late=5), result(3, None), result(4, float("nan")), result(5, float("inf")), result(6, -1.0), result(7, 50.0, domain=None), result(8, 1.0, model=None, task="a"), result(9, 1.0, model=None, task="a")]
    got = {(r["domain"], r["percent"]): (r["n"], round(r["value"], 2)) for r in quantiles.percentiles(spark.createDataFrame(rows, RESULT), table(spark, D, "category_aliases")).collect()}
    assert got["embodied_robotics", 99] == (3, 90.0) and got["embodied_robotics", 50] == (3, 1.0) and got[None, 50] == (1, 50.0)
    assert quantiles.percentiles(spark.createDataFrame(rows, RESULT).limit(0), table(spark, D, "category_aliases")).count() == 0


# -- 3: sampling ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("size", "target", "floor", "have", "want"),
    [(10, [0.5, 0.3, 0.2], [0, 0, 0], [99, 99, 99], [5, 3, 2]), (10, [0.5, 0.5], [0, 0], [2, 99], [2, 8]), (10, [0.9, 0.1], [0, 3], [99, 99], [7, 3]), (4, [0.5, 0.5], [5, 5], [9, 9], [2, 2]), (10, [1.0, 0.0], [0, 2], [3, 9], [3, 2]), (0, [1.0], [0], [5], [0])],
)
def test_seats(size, target, floor, have, want):
    assert sampling.seats_of(size, np.array(target, float), np.array(floor), np.array(have)).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 5), st.integers(0, 40)), min_size=1, max_size=6), st.integers(0, 80))
def test_seats_are_the_smallest_priorities(cells, size):
    target, floor, have = (np.array(x) for x in zip(*cells))
    got = sampling.seats_of(size, target.astype(float), floor, have)
    first = [(-1.0, (r - 0.5) / t, c) for c, (t, f, h) in enumerate(cells) for r in range(1, min(f, h) + 1)]
    rest = [(0.0, (r - 0.5) / t, c) for c, (t, f, h) in enumerate(cells) for r in range(min(f, h) + 1, h + 1)]
    taken = sorted(first + rest)[:size]
    assert got.sum() == len(taken)
    assert max([(r - 0.5) / target[c] for c in range(len(cells)) for r in [got[c]] if r > min(floor[c], have[c])], default=0) <= max([p for _, p, _ in taken], default=0) + 1e-9


SAMPLE = "row_id bigint, task_id string, domain string, task_category string, difficulty_profile map<string,string>, plan_id string"


def test_sample_meets_its_plan(spark):
    tasks = [(i, f"t{i % 900}", ["Visual-Security", "robotics", None][i % 3], "x", {"ika": ["HARD ", "easy"][i % 2]}, "clash") for i in range(1000)]
    plans = spark.createDataFrame([(1, 90, 1, "visual_security", None, None, None, 0.5, 10), (1, 90, 2, "embodied robotics", None, "industrial_logic_and_fact_alignment", "hard", 0.5, 10), (2, 5, 1, "nowhere", None, None, None, 1.0, 1), (3, 900, 1, None, None, None, None, 1.0, 0)], "plan_id bigint, plan_size bigint, cell_id int, domain string, task_category string, difficulty_axis string, difficulty string, target_share double, min_count bigint")
    args = spark.createDataFrame(tasks, SAMPLE), plans, table(spark, D, "category_aliases")
    assert {tuple(r) for r in sampling.found(*args).collect()} == {(2, 1)}
    rows = sampling.sample(*args).collect()
    per = {k: [r["rank"] for r in rows if (r["plan_id"], r["cell_id"]) == k] for k in ((1, 1), (1, 2), (3, 1))}
    assert sorted(per[1, 1]) == [*range(1, 46)] and sorted(per[1, 2]) == [*range(1, 46)] and len(per[3, 1]) == 900
    assert len({(r["plan_id"], r["cell_id"], r["task_id"]) for r in rows}) == len(rows)
    empty = spark.createDataFrame([], SAMPLE)
    assert {tuple(r) for r in sampling.found(empty, *args[1:]).collect()} == {(1, 1), (1, 2), (2, 1), (3, 1)}
    assert sampling.sample(empty, *args[1:]).count() == 0


def test_overlapping_cells_share_no_task(spark):
    """The wide cell leaves the tasks of the narrow one to it; both count all that meet them."""
    tasks = [(i, f"t{i}", "visual_security", "x", {"ika": "hard" if i < 20 else "easy"}, "clash") for i in range(100)]
    plans = spark.createDataFrame([(1, 60, 1, "visual security", None, None, None, 0.7, 0), (1, 60, 2, None, None, "industrial_logic_and_fact_alignment", "hard", 0.3, 18), (2, 50, 1, None, None, "ika", "hard", 0.4, 21)], "plan_id bigint, plan_size bigint, cell_id int, domain string, task_category string, difficulty_axis string, difficulty string, target_share double, min_count bigint")
    args = spark.createDataFrame(tasks, SAMPLE), plans, table(spark, D, "category_aliases")
    rows = [r for r in sampling.sample(*args).collect() if r["plan_id"] == 1]
    assert len({r["task_id"] for r in rows}) == len(rows) == 60
    assert sum(r["cell_id"] == 2 for r in rows) == 18 and all(int(r["task_id"][1:]) < 20 for r in rows if r["cell_id"] == 2)
    report = {(r["plan_id"], r["cell_id"]): (r["available"], r["seats"], r["short"]) for r in sampling.cell_report(*args).collect()}
    assert report == {(1, 1): (60, 42, False), (1, 2): (20, 18, False), (2, 1): (20, 20, True)}
    assert {tuple(r) for r in sampling.found(*args).collect()} == {(2, 1)}


def test_a_hot_category_is_numbered_in_buckets(spark):
    drawn = cut(spark.range(5000).select(F.lit(1).alias("plan_id"), F.lit(1).alias("cell_id"), F.col("id").cast("string").alias("task_id")))
    shares = spark.createDataFrame([(1, 1, 700)], "plan_id int, cell_id int, seats bigint")
    got = sampling.draw(drawn, shares, bits=4).collect()
    assert sorted(r["rank"] for r in got) == [*range(1, 701)]


# -- 4: near duplicates -----------------------------------------------------------------------


def brute_pairs(rows, threshold=0.7):
    out = set()
    for k, f in ((1, "prompt"), (2, "video_generation_prompt")):
        sets = [(r[0], set(re.findall("[a-z0-9]+", r[k].lower()))) for r in rows if r[k] is not None and len(r[k]) >= 50]
        for i, (a, x) in enumerate(sets):
            out |= {(min(a, b), max(a, b), f) for b, y in sets[i + 1 :] if x and len(x & y) * 1000 >= round(threshold * 1000) * len(x | y)}
    return out


def edited(rng, n, groups=60, base=None):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        g = rng.integers(groups) if base is None else 0
        seed = np.random.default_rng(g).choice(words, 40)
        for _ in range(rng.integers(0, 7)):
            seed[rng.integers(40)] = words[rng.integers(3000)]
        text = " ".join(rng.permutation(seed))
        rows.append((i, text, text.upper() if i % 3 else None, "clash"))
    return rows


PAIRS = "row_id bigint, prompt string, video_generation_prompt string, rec string"


@pytest.mark.parametrize("plan", [nearpairs.Plan(), nearpairs.Plan(bucket=2, cap=8)])
def test_pairs_against_brute_force(spark, plan):
    rows = edited(np.random.default_rng(5), 500)
    got = {tuple(r) for r in nearpairs.found(spark.createDataFrame(rows, PAIRS), plan=plan).collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 500


def test_a_hot_group_of_near_copies(spark):
    """One group holds all rows: its buckets exceed the cap and are compared in blocks."""
    rows = edited(np.random.default_rng(6), 260, base=1)
    plan = nearpairs.Plan(cap=16)
    got = {tuple(r) for r in nearpairs.found(spark.createDataFrame(rows, PAIRS), plan=plan).collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_pairs_of_the_table_and_groups(spark):
    df = table(spark, D, "samples")
    rows = [(r["row_id"], r["prompt"], r["video_generation_prompt"]) for r in df.collect()]
    want = brute_pairs(rows)
    assert {tuple(r) for r in nearpairs.found(df).collect()} == want
    classes = {(r["row_id"], r["field_name"]): r["class_id"] for r in nearpairs.groups(df).collect()}
    assert all(classes[a, f] == classes[b, f] for a, b, f in want)
    assert len(classes) == sum(x is not None and len(x) >= 50 for r in rows for x in r[1:])


def test_chains_form_one_class(spark):
    text = lambda k: " ".join(f"word{i}" for i in range(k, k + 40))
    rows = [(i, text(5 * i), None, "") for i in range(12)]
    got = nearpairs.groups(spark.createDataFrame(rows, PAIRS)).collect()
    assert {r["class_id"] for r in got} == {0} and all(r["links"] >= 1 for r in got)


def test_long_chains_form_one_class(spark):
    """Chains of 400 texts, numbered at random and up from both ends: labels have hundreds of hops to go."""
    text = lambda c, k: " ".join(f"chain{c}word{i}" for i in range(k, k + 40))
    at_random, ends = np.random.default_rng(9).permutation(400), [2 * min(k, 399 - k) + (k >= 200) for k in range(400)]
    rows = [(int(i), text(0, 5 * k), None, "") for k, i in enumerate(at_random)] + [(400 + i, text(1, 5 * k), None, "") for k, i in enumerate(ends)]
    got = nearpairs.groups(spark.createDataFrame(rows, PAIRS)).collect()
    assert len(got) == 800 and all(r["class_id"] == (0 if r["row_id"] < 400 else 400) for r in got)


def test_pairs_dirt(spark):
    long = "a long prompt of many words " * 3
    rows = [(1, None, None, ""), (2, "", "", ""), (3, "short", long, ""), (4, "é " * 60, long, ""), (5, "!" * 80, long.upper(), ""), (6, "é " * 60, None, "")]
    got = {tuple(r) for r in nearpairs.found(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {(3, 4, "video_generation_prompt"), (3, 5, "video_generation_prompt"), (4, 5, "video_generation_prompt")}
    assert nearpairs.found(spark.createDataFrame([], PAIRS)).count() == 0


def test_groups_edited_with_rare_words():
    """Groups of 0.1 to 30 % of 200,000 texts whose edits bring in words rarer than all that is shared: two runs of each kind see most pairs."""
    rng, records, plan = np.random.default_rng(4), 200_000, nearpairs.Plan()
    for size in (200, 2000, 60_000):
        base = rng.integers(1 << 47, size=100).astype(np.uint64)
        kept = [rng.permutation(100)[:92] for _ in range(60)]
        texts = [np.r_[base[k], rng.integers(1 << 47, size=8).astype(np.uint64)] for k in kept]
        share = np.concatenate([np.r_[np.where(k < 70, max(0.2, size / records), size / records), np.full(8, 5 / records)] for k in kept])
        near = [(i, j) for i in range(60) for j in range(i) if len(c := np.intersect1d(texts[i], texts[j])) >= 0.7 * (200 - len(c))]
        who, path = nearpairs.paths_of(np.concatenate(texts), np.arange(61) * 100, share, records, plan, range(6))
        chose = [set(path[who == i]) for i in range(60)]
        assert len(near) > 1000 and sum(bool(chose[i] & chose[j]) for i, j in near) >= 0.97 * len(near)


def test_unseen():
    """Pairs of unequal chances over five runs: the estimate is near what was missed."""
    rng = np.random.default_rng(2)
    chance = rng.choice([0.9, 0.5, 0.2], 20_000)
    times = (rng.random((20_000, 5)) < chance[:, None]).sum(axis=1)
    got = nearpairs.unseen((times == 1).sum(), (times == 2).sum(), 5)
    assert 0.6 * (times == 0).sum() < got < 1.2 * (times == 0).sum()
    assert nearpairs.unseen(0, 0, 3) == nearpairs.unseen(1, 0, 3) == 0


def test_runs_repeat_until_the_recall(spark, monkeypatch):
    """With one word a record and a path of one word, a run misses many pairs, so more follow."""
    seen = []
    plain = nearpairs.candidates
    monkeypatch.setattr(nearpairs, "candidates", lambda *args: seen.append(args[-1]) or plain(*args))
    rows = edited(np.random.default_rng(8), 300)
    got = {tuple(r) for r in nearpairs.found(spark.createDataFrame(rows, PAIRS), plan=nearpairs.Plan(picks=1, depth=1, runs=2, recall=0.98)).collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) >= 0.96 * len(want) and len(seen) > 1
    assert [r.start for r in seen] == [0, *(2 + 2 * i for i in range(len(seen) - 1))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1Z é\u212a-", max_size=20), max_size=8), st.integers(0, 3))
def test_words_are_hashed_alike(texts, skip):
    import pyarrow as pa

    lower = [t.lower() for t in texts]
    words, offsets = nearpairs.distinct_words(pa.array(lower, pa.string())[skip:])
    sets = [set(re.findall("[a-z0-9]+", t)) for t in lower[skip:]]
    assert np.diff(offsets).tolist() == [len(x) for x in sets]
    alone = {w: int(nearpairs.distinct_words(pa.array([w]))[0][0]) for x in sets for w in x}
    assert len(set(alone.values())) == len(alone)
    assert [set(words[a:b].tolist()) for a, b in zip(offsets, offsets[1:])] == [{alone[w] for w in x} for x in sets]


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    import pyarrow as pa

    text = " ".join(["abc", "x" * 300, "q7"] * 50)
    whole = nearpairs.distinct_words(pa.array([text, "abc"]))
    monkeypatch.setattr(nearpairs, "STRETCH", 64)
    parts = nearpairs.distinct_words(pa.array([text, "abc"]))
    assert len(whole[0]) == 4 and all((a == b).all() for a, b in zip(whole, parts))


def test_large_buckets_split_before_they_are_compared(spark):
    """Records that share a template but are not near part into small buckets; the work grows with the records, not their square."""
    rng = np.random.default_rng(12)
    template = " ".join(f"shared{i}" for i in range(12))
    rows = [(i, template + " " + " ".join(f"own{w}" for w in rng.integers(1 << 40, size=30)), None, "") for i in range(600)]
    rows += [(600 + i, rows[i][1] + " more", None, "") for i in range(40)]
    df = spark.createDataFrame(rows, PAIRS)
    texts = nearpairs.texts_of(df, ("prompt",), 50)
    over = texts.select(F.lit(256).cast("bigint").alias("path"), (F.col("row_id") * 2).alias("rec"))
    plan = nearpairs.Plan(cap=64)
    sizes = lambda e: {r["path"]: r["count"] for r in e.groupBy("path").count().collect()}
    first = nearpairs.children(texts, over, plan)
    second = nearpairs.children(texts, first.join(first.groupBy("path").count().where("count > 64"), "path", "left_semi"), plan)
    pairs = lambda s: sum(n * (n - 1) // 2 for n in s.values())
    assert pairs(sizes(first)) + pairs(sizes(second)) < 0.6 * 640 * 639 // 2
    assert {tuple(r)[:2] for r in nearpairs.found(df, plan=plan).collect()} == {(i, 600 + i) for i in range(40)}


# -- 8: sentences -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cutter(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    corpus = sentences.survey(docs)
    weights = sentences.train(docs, corpus)
    cutter = sentences.Cutter(corpus, weights)
    return lambda s: [s[a:b] for a, b in sentences.split(s, cutter)]


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Optelt rated it 5.21 bar.", "The boom held."],
        ["We stopped at 6 a.m.", "The crew left at 10 p.m.", "Nobody spoke."],
        ['The log says: "Pressure back to 11.94 bar."', "The dolly move began."],
        ["The foreman wrote “Seal it now.” in the margin and left.", "See Fig. 27 for the layout."],
        ["Who moved it?!", "Nobody touched the shell... or so the sheet claims."],
        ["Smoke came from the tray, etc.", "The crew left."],
        ["Am 5. Mai wurde die Seilwinde geprüft.", "Nr. 31 ist z. B. eine Fräse."],
        ["„Sofort anhalten!“, rief der Einweiser.", "Die Presse lief."],
        ["« Arrêtez la grue ! » cria le chef.", "Mme Kraulm refuse la fuite du 8 mai."],
        ["El parte dice: «La fresadora no cede.»", "¿Por qué vibra la prensa?", "La pág. 40 describe la grúa."],
        ["Инж. Ulmgri подписал лист № 16.", "«Стоп!» — крикнул сигнальщик."],
    ],
)
def test_sentences_with_blanks(cutter, want):
    assert cutter(" ".join(want)) == want


@pytest.mark.parametrize(
    "want",
    [
        ["谁移动了起重臂？！", "请注意泄漏！", "“立即停机！”班长喊道。", "《电路板检查。手册》放在工具箱里。", "记录写道：“压力恢复到9.34巴。”", "阀门在04:51完成检查。"],
        ["担当は誰ですか？", "「止めろ！」と合図者が叫んだ。", "カメラは45°回り込み、基板の形は保たれた…。", "隙間は16.3ミリで、短絡の基準より小さい。"],
    ],
)
def test_sentences_without_blanks(cutter, want):
    assert cutter("".join(want)) == want


def test_other_scripts(cutter):
    assert cutter("ใครย้ายเครน? เฟืองทำงานปกติ ระยะห่าง 54.6 มม. ต่ำกว่าเกณฑ์") == ["ใครย้ายเครน?", "เฟืองทำงานปกติ", "ระยะห่าง 54.6 มม. ต่ำกว่าเกณฑ์"]
    assert cutter("रिसाव से सावधान! “रुको!” संकेतक चिल्लाया। क्रेन क्यों हिल रहा है?") == ["रिसाव से सावधान!", "“रुको!” संकेतक चिल्लाया।", "क्रेन क्यों हिल रहा है?"]


def test_units(cutter):
    assert cutter("\n  Shift summary \n \n- lock out unit X1\n- note (5.2 bar)\n\n1. check it\n2. film it\r\n\r\nOne line\ngoes on. Two: a; b\n") == ["Shift summary", "- lock out unit X1", "- note (5.2 bar)", "1. check it", "2. film it", "One line\ngoes on.", "Two: a; b"]


def test_sentences_of_nothing(spark, cutter):
    assert cutter("") == cutter(" \n\t ") == cutter(None) == []
    long = "Word after word " * 20000 + "ends. " + "(" * 300 + "x"
    assert len(cutter(long)) >= 1
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "One end. Two.", 1), (3, "One end. Two.", 1)], "doc_id bigint, text string, start_pos int")
    got = sentences.sentences(docs)
    assert got.columns == ["doc_id", "start_pos", "end_pos"] and got.where("doc_id = 3").count() in (2, 4)
    assert sentences.sentences(docs.limit(0)).count() == 0


def test_copies_take_one_place_of_the_sample(spark):
    """The text of the smallest hash holds most rows."""
    docs = spark.range(40).select(F.concat(F.lit("text "), "id").alias("text"))
    places = [r["text"] for r in docs.orderBy(F.xxhash64("text")).collect()]
    rows = [(places[0],)] * 500 + [(t,) for t in places] + [(None,)]
    assert sorted(r["text"] for r in sentences.sampled(spark.createDataFrame(rows, "text string"), 20).collect()) == sorted(places[:20])


def test_held_out_accuracy(spark):
    """Reliable boundaries of documents that were not in the sample are told apart."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    corpus = sentences.survey(docs)
    weights = sentences.train(docs.where("doc_id % 2 = 0"), corpus)
    rows = [r for d in docs.where("doc_id % 2 = 1").collect() for r in sentences.labelled(d["text"], corpus)]
    right = sum((weights[x].sum() > 0) == y for x, y in rows)
    assert right >= 0.99 * len(rows) and len(rows) > 1000


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\"'()“”。…é一", max_size=60))
def test_sentences_cover_all_that_is_not_blank(text):
    corpus = sentences.Corpus(np.zeros(sentences.SLOTS, int), np.zeros(sentences.SLOTS, int), 0.3)
    got = sentences.split(text, sentences.Cutter(corpus, np.random.default_rng(0).normal(size=sentences.WEIGHTS)))
    assert "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
