"""Problem 5: tree edit scripts, changes of files, the consistent table."""

import json

from benchloom.operators import drift as D
from benchloom.session import table

ALIASES = [("vfa_score", "viewpoint_motion_score"), ("ic_details", "industrial_constraint_details")]


def frames(spark, files, aliases=ALIASES):
    """files: lists of payloads in order, of one stream."""
    raw = [(10 * i + k, i, k, p) for i, lines in enumerate(files) for k, p in enumerate(lines)]
    return (
        spark.createDataFrame(raw, "line_id bigint, file_id bigint, line_no int, payload string"),
        spark.createDataFrame([(i, 1, i) for i in range(len(files))], "file_id bigint, stream_id bigint, file_seq int"),
        spark.createDataFrame(aliases, "alias string, canonical string"),
    )


def changes(spark, *files):
    return {tuple(r) for r in D.found(*frames(spark, files)).collect()}


def test_changes(spark):
    got = changes(
        spark,
        ['{"vfa_score": 1, "a": 1}', '{"vfa_score": null}'],
        ['{"viewpointMotionScore": 2.5, "b": "x"}'],
        ['{"VFA-SCORE": "2", "b": null}'],
        ['{"vfa_score": true, "b": 1, "a": {"c": 1}}'],
    )
    v = "viewpoint_motion_score"
    assert got == {(1, v, "renamed"), (1, "a", "removed"), (1, "b", "added"), (2, v, "renamed"), (2, v, "retyped"), (3, v, "renamed"), (3, v, "retyped"), (3, "b", "retyped"), (3, "a", "added")}


def test_a_kind_is_forgotten_when_a_field_goes(spark):
    assert changes(spark, ['{"b": 1}'], ["{}"], ['{"b": null}'], ['{"b": "x"}']) == {(1, "b", "removed"), (2, "b", "added")}


def test_dirt_adds_no_field(spark):
    bad = [None, "", "{", "[1]", "3", "null", '{"task_id": "t", "domain": 4}', '{"a": 1}', '{"a": 1}']
    assert changes(spark, ['{"a": 1}'], bad) == set()
    assert D.consistent_table(*frames(spark, [bad])).where("not parsed").count() == 6
    assert D.consistent_table(*frames(spark, [])).count() == 0


def test_moves_count_at_the_top_level(spark):
    assert changes(spark, ['{"a": {"q": 1}, "z": 1}'], ['{"a": {}, "q": 1, "z": 1}']) == {(1, "q", "added")}


def kind(v):
    if isinstance(v, bool) or v is None:
        return "" if v is None else "boolean"
    return {dict: "object", list: "array", str: "string"}.get(type(v), "number")


def type_of(v):
    """The type of a value as the JSON reader names it."""
    if isinstance(v, dict):
        quoted = lambda k: k if k.isidentifier() else "`" + k.replace("`", "``") + "`"
        return "OBJECT<" + ", ".join(f"{quoted(k)}: {type_of(x)}" for k, x in v.items()) + ">"
    if isinstance(v, list):
        return f"ARRAY<{type_of(v[0]) if v else 'VOID'}>"
    return {"": "VOID", "boolean": "BOOLEAN", "string": "STRING", "number": "DECIMAL(2,1)"}[kind(v)]


def tree(d):
    return D.tree_of([{"canonical": k, "written": [k], "kind": kind(v) or None, "known": kind(v) or None, "types": [type_of(v)] if isinstance(v, (dict, list)) else []} for k, v in d.items()])


def script(a, b):
    cost, ops = D.edit_script(tree(a), tree(b))
    return cost, sorted((o[0], o[1].replace(D.SEP, "."), o[2].replace(D.SEP, ".")) for o in ops)


def test_edit_script_prefers_cheap_operations():
    assert script({"a": 1, "b": {"c": 1}}, {"a": 1, "b": {"c": 1}}) == (0.0, [])
    assert script({"a": {"q": 1, "r": 2}, "b": 1}, {"a": {"r": 2}, "b": {"q": 1}}) == (D.MOVE + D.RETYPE, [("moved", "a.q", "b.q"), ("retyped", "b", "b")])
    assert script({"a": {"q": 1}}, {}) == (2 * D.DELETE, [("removed", "a", "a")])


def test_renames_without_an_alias():
    assert script({"score_v1": 1, "x": 1}, {"score_v2": 1, "x": 1}) == (D.RENAME, [("renamed", "score_v1", "score_v2")])
    assert script({"score_v1": 1}, {"score_v2": "a"}) == (D.DELETE + D.INSERT, [("added", "score_v2", "score_v2"), ("removed", "score_v1", "score_v1")])
    assert script({"frame_count": 1}, {"weight": 1})[0] == D.DELETE + D.INSERT
    assert script({"box": {"left": 1, "top": 2}}, {"frame": {"left": 1, "top": 2}}) == (D.RENAME, [("renamed", "box", "frame")])
    # Either name alone is nearest to score_b2; together they are paired at the least cost.
    assert script({"score_b1": 1, "score_b": {"k": 1}}, {"score_b2": 1, "score_bb": {"k": 1}})[0] == 2 * D.RENAME


def test_every_depth_and_arrays():
    deep = lambda leaf: {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": leaf}}}}}}}}
    assert script(deep({"i": 1}), deep({"i": 1, "j": 1}))[1] == [("added", "a.b.c.d.e.f.g.h.j", "a.b.c.d.e.f.g.h.j")]
    assert script({"a": {"b": [{"c": 1}]}}, {"a": {"b": [{"c": 1, "d": 2}]}})[1] == [("added", "a.b.[].d", "a.b.[].d")]
    assert script({"a": ["x"]}, {"a": [1]})[1] == [("retyped", "a.[]", "a.[]")]
    assert D.read_type("OBJECT<`c``d`: ARRAY<OBJECT<e: VARIANT, f: VOID>>, g: DECIMAL(23,0)>") == ("object", [("c`d", ("array", [("[]", ("object", [("e", ("", [])), ("f", ("", []))]))])), ("g", ("number", []))])


def test_moves_cost_least_in_all():
    # The larger of two deleted subtrees of one name goes where it costs fewer edits.
    big, small = {"k": 1, "l": 2, "m": 3}, {"n": 1}
    cost, ops = script({"a": {"q": big}, "b": {"q": small}, "c": {}, "d": {}}, {"a": {}, "b": {}, "c": {"q": small}, "d": {"q": big}})
    assert cost == 2 * D.MOVE and ops == [("moved", "a.q", "d.q"), ("moved", "b.q", "c.q")]
    # A field survives the deletion of its parent.
    assert script({"old": {"q": 1, "r": 1}}, {"q": 1}) == (2 * D.DELETE + D.MOVE, [("moved", "old.q", "q"), ("removed", "old", "old")])


def test_assignment_is_the_best():
    rng = __import__("random").Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        profit = {(i, j): rng.choice([-1.0, 0.5, 1.0, 2.5]) for i in range(n) for j in range(m) if rng.random() < 0.7}
        best = lambda i, used: 0.0 if i == n else max([best(i + 1, used)] + [profit[i, j] + best(i + 1, used | {j}) for j in range(m) if (i, j) in profit and j not in used])  # noqa: B023, E731
        got = D.assign(profit) if profit else []
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert abs(sum(profit[p] for p in got) - max(0.0, best(0, frozenset()))) < 1e-9


def test_names_with_dots_and_lines_with_more_than_an_object(spark):
    assert changes(spark, ['{"a.b": 1}'], ['{"c.d": "x"}', '{"e": 1} tail', '{"e": 1},{"f": 2}', '{"e": 1}{"f": 2}']) == {(1, "a.b", "removed"), (1, "c.d", "added")}


def test_unaliased_renames_are_removed_and_added(spark):
    assert changes(spark, ['{"score_v1": 1}'], ['{"score_v2": 2}'], ['{"score_v2": "x"}']) == {(1, "score_v1", "removed"), (1, "score_v2", "added"), (2, "score_v2", "retyped")}


def rows(spark, *files, aliases=ALIASES):
    return {r["line_id"]: r for r in D.consistent_table(*frames(spark, files, aliases)).collect()}


def test_values_that_do_not_fit_are_kept(spark):
    got = rows(spark, ['{"vfa_score": 7, "viewpoint_motion_score": null}', '{"weighted_score": "high", "vfa_score": "12,5"}', '{"weighted_score": [1, 2], "skipped": "no"}', '{"vfa_score": 1, "viewpoint_motion_score": 2}', '{"weighted_score": 0.1234567890123456789, "x": null}', "no json", None, '{"weighted_score": {"value": 3}}'])
    assert got[0]["viewpoint_motion_score"] == 7 and json.loads(got[0]["rescued"]) == {"viewpoint_motion_score": None}
    assert json.loads(got[1]["rescued"]) == {"weighted_score": "high", "vfa_score": "12,5"} and got[1]["weighted_score"] is None
    assert json.loads(got[2]["rescued"]) == {"weighted_score": [1, 2], "skipped": "no"}
    assert got[3]["viewpoint_motion_score"] == 1 and json.loads(got[3]["rescued"]) == {"viewpoint_motion_score": 2}
    assert got[4]["rescued"] == '{"weighted_score":0.1234567890123456789}' and json.loads(got[4]["other_fields"]) == {"x": None}
    assert (got[5]["parsed"], got[5]["raw"], got[6]["parsed"], got[6]["raw"]) == (False, "no json", False, None)
    assert got[7]["weighted_score"] == 3 and json.loads(got[7]["rescued"]) == {"weighted_score": {"value": 3}}


def test_renames_and_moves_are_followed(spark):
    got = rows(
        spark,
        ['{"note_v1": "a", "vfa_score": 1}'],
        ['{"note_v2": "b", "vfa_score": 2}'],
        ['{"note_v3": "c", "wrap": {"vfa_score": 3}}'],
        ['{"note_v3": "d", "wrap": {"vfa_score": 4}}'],
        ['{"wrap": {}}'],
        ['{"note_v3": "e", "wrap": {}}'],
    )
    assert [json.loads(got[10 * i]["other_fields"]).get("note_v1") for i in range(4)] == ["a", "b", "c", "d"]
    assert [got[10 * i]["viewpoint_motion_score"] for i in range(5)] == [1, 2, 3, 4, None]
    assert json.loads(got[50]["other_fields"])["note_v3"] == "e"


def test_no_value_is_lost(spark):
    d = "/root/testdata/sf0.001"
    tables = [table(spark, d, t) for t in ("raw_results", "result_files", "field_aliases")]
    names = {r["file_id"]: r["names"] for r in D.projections(*tables).collect()}
    payloads = {r["line_id"]: (r["file_id"], r["payload"]) for r in tables[0].collect()}
    for r in D.consistent_table(*tables).collect():
        file, payload = payloads[r["line_id"]]
        if not r["parsed"]:
            assert r["raw"] == payload
            continue
        want, kept = json.loads(payload), json.loads(r["rescued"] or "{}")
        others = json.loads(r["other_fields"] or "{}")
        for written, v in want.items():
            column = names[file][written]
            if written in kept:
                assert kept[written] == v
            elif column in others:
                assert others[column] == v
            else:
                assert (json.loads(r[column]) if column in D.DETAILS else r[column]) == v and v is not None


def test_empty_tables(spark):
    assert changes(spark) == set()


def brute(spark, d):
    """The same changes by plain loops."""
    names: dict = {}
    for r in table(spark, d, "field_aliases").collect():
        for n in (r["alias"], r["canonical"]):
            names[D.letters_py(n)] = r["canonical"]
    lines: dict = {}
    for r in table(spark, d, "raw_results").collect():
        try:
            o = json.loads(r["payload"] or "")
        except ValueError:
            continue
        if isinstance(o, dict):
            for k, v in o.items():
                f = lines.setdefault(r["file_id"], {}).setdefault(names.get(D.letters_py(k), k), (set(), set()))
                f[0].add(k)
                f[1].update([kind(v)] if v is not None else [])
    out, before = set(), {}
    for r in sorted(table(spark, d, "result_files").collect(), key=lambda r: (r["stream_id"], r["file_seq"])):
        now = {n: (w, k) for n, (w, k) in lines.get(r["file_id"], {}).items() if n not in D.IDENTITY}
        if (old := before.get(r["stream_id"])) is not None:
            out |= {(r["file_id"], n, "added") for n in now.keys() - old.keys()} | {(r["file_id"], n, "removed") for n in old.keys() - now.keys()}
            out |= {(r["file_id"], n, "renamed") for n in now.keys() & old.keys() if now[n][0] != old[n][0]} | {(r["file_id"], n, "retyped") for n in now.keys() & old.keys() if now[n][1] and old[n][1] and now[n][1] != old[n][1]}
            now = {n: (w, k or old.get(n, (0, set()))[1]) for n, (w, k) in now.items()}
        before[r["stream_id"]] = now
    return out


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {tuple(r) for r in D.found(table(spark, d, "raw_results"), table(spark, d, "result_files"), table(spark, d, "field_aliases")).collect()}
    assert got == brute(spark, d) and got
