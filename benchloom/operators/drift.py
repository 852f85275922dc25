"""Schemas that drift between files (problem 5).

1. ``file_fields`` reads every line once, in built-in expressions: each top-level field with the
   type of its value, which names the fields and kinds of everything nested in it, elements of
   arrays included, at any depth.  Only distinct (file, field, type) go on.
2. ``edit_script`` compares the tree of a file with that of the file before it in its stream.
   Fields of an object have no order, so its children are aligned as sets: those of one
   canonical name belong together; the others are paired by an assignment of minimum cost
   between fields of equal kind whose names or subtrees are alike (a rename), and what is left is
   deleted or inserted with its subtree.  Nodes of deleted and of inserted subtrees that bear one name are then
   paired by assignments of minimum cost, larger subtrees first, where moving costs less.
3. ``projections`` compiles the scripts of a stream: following its renames and moves back gives,
   for every file, which column each field written there belongs to, and which nested places hold
   columns that were moved there.  ``consistent_table`` applies a file's projection to its lines in built-in expressions.

Only types and names go through Python.  The state for one file or stream position is its schema, never its
lines, so a stream with a third of all lines puts no burden on one task.

Defined results.  Null, empty, cut lines and lines that are not one JSON object add no field (a file
with nothing else has an empty schema); they stay in the consistent table with
``parsed = false`` and their text in ``raw``.  A null value adds the field without a kind.  Repeated lines change
nothing in a schema and stay in the table.  A name repeated within one object counts with
its last value.  Ties in file_seq are ordered by file_id.  Empty tables give empty results;
other columns of the inputs are ignored.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.session import cut, join_dimension

#: Fields that identify a record; their changes are not reported.
IDENTITY = ("task_id", "domain", "task_category")
#: Canonical names of result fields that are numbers in the consistent table, and of those kept as JSON.
NUMERIC = ("viewpoint_motion_score", "viewpoint_motion", "viewpoint_motion_target_degrees", "weighted_score", "frame_count_actual")
DETAILS = ("industrial_constraint_details", "industrial_logic_and_fact_alignment_details")
SEP = "\x1f"
#: Costs of a tree edit script.
DELETE, INSERT, RENAME, RETYPE, MOVE = 1.0, 1.0, 0.5, 0.5, 1.0
#: Share of bigrams that two names must have in common to be one field renamed.
ALIKE = 0.5
#: Levels of nesting that a schema may have; the JSON reader takes 1,000.
DEEP = 20_000


def members(payload: Column) -> Column:
    """map<string, variant> of a line that is one JSON object, else null."""
    whole = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    one = F.try_variant_get(whole, "$[1]", "variant").isNull() & payload.rlike(r"\}\s*$")
    return F.when(one, F.try_variant_get(whole, "$[0]", "map<string,variant>"))


def kind_of(kind: Column) -> Column:
    """number, string, boolean, object or array of a variant's type; empty for null."""
    number = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(number, "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("")


def file_fields(raw: DataFrame) -> DataFrame:
    """(file_id, written, kind, type), distinct: each top-level field of each file; ``type`` only where something is nested."""
    rows = raw.where(F.col("file_id").isNotNull()).select("file_id", F.explode(F.transform_values(members(F.col("payload")), lambda _, v: F.schema_of_variant(v))).alias("written", "t"))
    return rows.select("file_id", "written", kind_of(F.col("t")).alias("kind"), F.when(F.col("t").contains("<"), F.col("t")).alias("type")).distinct()


def letters(c: Column) -> Column:
    """Names compare by letters and digits only, without case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def canonical_names(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical``.

    A name equal to an alias or to a canonical name by letters and digits takes the canonical
    name; any other stays as written.
    """
    names = aliases.select(letters(F.col("alias")).alias("key"), "canonical").unionByName(aliases.select(letters(F.col("canonical")).alias("key"), "canonical"))
    names = names.unionByName(fields.sparkSession.createDataFrame([(letters_py(n), n) for n in IDENTITY + NUMERIC + ("skipped",)], "key string, canonical string"))
    names = names.where(F.col("key") != "").groupBy("key").agg(F.min("canonical").alias("canonical"))
    return join_dimension(fields.withColumn("key", letters(F.col("written"))), names, ["key"]).withColumn("canonical", F.coalesce("canonical", "written")).drop("key")


def letters_py(name: str) -> str:
    """``letters`` for a Python string."""
    return "".join(ch for ch in name.lower() if ch.isalnum())


def streams(files: DataFrame) -> DataFrame:
    """(file_id, stream_id, pos): the place of each file in its stream."""
    order = Window.partitionBy("stream_id").orderBy("file_seq", "file_id")
    rows = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min_by("stream_id", "file_seq").alias("stream_id"), F.min("file_seq").alias("file_seq"))
    return rows.withColumn("pos", F.row_number().over(order)).drop("file_seq")


def file_schemas(raw: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, stream_id, pos, fields): one row a file, also for files without readable lines.

    ``fields``: array of (canonical, written names, kind, known kind, types), one for each top-level
    field; ``known`` is the last kind since the field was added, for files that have only nulls.
    """
    fields = canonical_names(file_fields(raw), aliases)
    fields = fields.groupBy("file_id", "canonical").agg(
        F.array_sort(F.collect_set("written")).alias("written"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif("kind", F.lit("")))), "|"), F.lit("")).alias("kind"),
        F.array_sort(F.collect_set("type")).alias("types"),
    )
    placed = streams(files)
    rows = fields.join(placed, "file_id")
    by_field = Window.partitionBy("stream_id", "canonical").orderBy("pos")
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(by_field))
    since = Window.partitionBy("stream_id", "canonical", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("known", F.last("kind", ignorenulls=True).over(since))
    trees = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("canonical", "written", "kind", "known", "types"))).alias("fields"))
    return placed.join(trees, "file_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast(trees.schema["fields"].dataType)))


# -- trees ------------------------------------------------------------------------------------


class Node:
    """A field of a schema tree; ``name`` is what it is compared by."""

    __slots__ = ("children", "kind", "known", "name", "size", "written")

    def __init__(self, name: str, written: tuple[str, ...], kind: str | None, known: str | None, children: list[Node]):
        self.name, self.written, self.kind, self.known = name, written, kind, known
        self.children = sorted(children, key=lambda c: c.name)
        self.size = 1 + sum(c.size for c in children)


Type = tuple[str, list[tuple[str, "Type"]]]


def read_type(text: str) -> Type:
    """(kind, children) of a variant's type: OBJECT<name: TYPE, ...>, ARRAY<TYPE> or a plain one.

    >>> read_type("OBJECT<a: BIGINT, `b c`: ARRAY<STRING>>")
    ('object', [('a', ('number', [])), ('b c', ('array', [('[]', ('string', []))]))])
    """
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] != "`":
            end = text.index(":", at)
            out, at = text[at:end], end
            return out
        out, at = [], at + 1
        while True:
            end = text.index("`", at)
            out.append(text[at:end])
            at = end + 1
            if text[at : at + 1] != "`":
                return "`".join(out)
            at += 1

    def one() -> Type:
        nonlocal at
        if text.startswith("OBJECT<", at):
            at, fields = at + 7, []
            while text[at] != ">":
                at += 2 if text[at] == "," else 0
                key = name()
                at += 2
                fields.append((key, one()))
            at += 1
            return "object", fields
        if text.startswith("ARRAY<", at):
            at += 6
            of = one()
            at += 1
            return "array", [("[]", of)] if of[0] else []
        end = at
        while end < len(text) and text[end] not in ",>" or text[at:end].startswith("DECIMAL(") and ")" not in text[at:end]:
            end += 1
        word, at = text[at:end], end
        return {"STRING": "string", "BOOLEAN": "boolean", "VOID": "", "VARIANT": ""}.get(word, "number"), []

    return one()


def nest(types: list[Type]) -> list[Node]:
    """The children of a field with these types, united by their names."""
    by: dict[str, list[tuple[str, Type]]] = {}
    for _, children in types:
        for written, t in children:
            by.setdefault(written if written == "[]" else letters_py(written) or written, []).append((written, t))
    out = []
    for key, found in by.items():
        kind = "|".join(sorted({t[0] for _, t in found if t[0]})) or None
        out.append(Node(key, tuple(sorted({w for w, _ in found})), kind, kind, nest([t for _, t in found])))
    return out


def tree_of(fields: list) -> Node:
    """The schema tree of a file."""
    return Node("", (), "object", "object", [Node(f["canonical"], tuple(f["written"]), f["kind"], f["known"], nest([read_type(t) for t in f["types"]])) for f in fields])


# -- tree edit distance -----------------------------------------------------------------------

#: Operation, place before, place after (equal unless renamed to another name or moved), and names or kinds before and after.
Op = tuple[str, str, str, str, str]


def assign(profit: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The pairs, each side used once at most, with the greatest sum of positive profits (Hungarian method)."""
    left, right = sorted({i for i, _ in profit}), sorted({j for _, j in profit})
    n, m = len(left), max(len(right), len(left))
    cost = [[-max(0.0, profit.get((i, right[c]), 0.0)) if c < len(right) else 0.0 for c in range(m)] for i in left]
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, way, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[at] = True
            i, step, nxt = match[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    if (c := cost[i - 1][j - 1] - u[i] - v[j]) < least[j]:
                        least[j], way[j] = c, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
            if match[at] == 0:
                break
        while at:
            match[at] = match[way[at]]
            at = way[at]
    pairs = [(left[match[j] - 1], right[j - 1]) for j in range(1, len(right) + 1) if match[j]]
    return sorted(p for p in pairs if profit.get(p, 0.0) > 0)


def bigrams(name: str) -> set[str]:
    padded = f"^{letters_py(name) or name}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def alike(x: Node, y: Node) -> bool:
    """Whether two names may be one field renamed: equal kind, and like names or the same children."""
    if x.kind != y.kind or "[]" in (x.name, y.name):
        return False
    if x.children and [c.name for c in x.children] == [c.name for c in y.children]:
        return True
    a, b = bigrams(x.name), bigrams(y.name)
    return 2 * len(a & b) >= 2 * ALIKE * max(len(a), len(b))


Gone = list[tuple[str, Node]]


def place(path: str, node: Node) -> str:
    return f"{path}{SEP}{node.name}" if path else node.name


def match(x: Node, y: Node, before: str, after: str, gone: Gone, come: Gone) -> tuple[float, list[Op]]:
    """Cost and script that turn one field into another, subtrees included."""
    cost, ops, other = 0.0, [], before.rpartition(SEP)[2] != after.rpartition(SEP)[2]
    if other or x.written != y.written:
        cost, ops = RENAME, [("renamed", before, after, "|".join(x.written), "|".join(y.written))]
    if y.kind and x.known and y.kind != x.known:
        cost, ops = cost + RETYPE, [*ops, ("retyped", before, after, x.known, y.kind)]
    below, more = align(x, y, before, after, gone, come)
    return cost + below, ops + more


def align(a: Node, b: Node, before: str, after: str, gone: Gone, come: Gone) -> tuple[float, list[Op]]:
    """Cost and script that turn ``a``'s children into ``b``'s; what is deleted or inserted is added to ``gone`` and ``come``."""
    cost, ops = 0.0, []
    theirs = {y.name: y for y in b.children}
    mine = {x.name for x in a.children}
    for x in a.children:
        if y := theirs.get(x.name):
            c, more = match(x, y, place(before, x), place(after, y), gone, come)
            cost, ops = cost + c, ops + more
    xs, ys = [x for x in a.children if x.name not in theirs], [y for y in b.children if y.name not in mine]
    profit = {}
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            if alike(x, y):
                c, _ = match(x, y, place(before, x), place(after, y), [], [])
                profit[i, j] = DELETE * x.size + INSERT * y.size - c
    pairs = assign(profit) if profit else []
    for i, j in pairs:
        c, more = match(xs[i], ys[j], place(before, xs[i]), place(after, ys[j]), gone, come)
        cost, ops = cost + c, ops + more
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    for i, x in enumerate(xs):
        if i not in left:
            cost += DELETE * x.size
            gone.append((place(before, x), x))
            ops.append(("removed", place(before, x), place(before, x), "|".join(x.written), ""))
    for j, y in enumerate(ys):
        if j not in right:
            cost += INSERT * y.size
            come.append((place(after, y), y))
            ops.append(("added", place(after, y), place(after, y), "", "|".join(y.written)))
    return cost, ops


def spread(roots: Gone) -> Gone:
    """All nodes of these subtrees with their places, but elements of arrays."""
    out, todo = [], list(roots)
    while todo:
        path, node = todo.pop()
        if node.name != "[]":
            out.append((path, node))
        todo += [(place(path, c), c) for c in node.children]
    return out


def within(path: str, taken: set[str]) -> bool:
    """Whether a place, one above or one below it is among those taken."""
    return any(path == t or path.startswith(t + SEP) or t.startswith(path + SEP) for t in taken)


def edit_script(before: Node, after: Node) -> tuple[float, list[Op]]:
    """The minimum-cost script of deletions, insertions, renames, changes of kind, and moves."""
    gone: Gone = []
    come: Gone = []
    cost, ops = align(before, after, "", "", gone, come)
    names: dict[str, tuple[Gone, Gone]] = {}
    for side, roots in enumerate((gone, come)):
        for path, node in spread(roots):
            names.setdefault(letters_py(node.written[0]) or node.written[0], ([], []))[side].append((path, node))
    groups = [(old, new) for _, (old, new) in sorted(names.items()) if old and new]
    left: set[str] = set()
    right: set[str] = set()
    for old, new in sorted(groups, key=lambda g: -max(n.size for _, n in g[0])):
        profit = {}
        for i, (p, x) in enumerate(old):
            for j, (q, y) in enumerate(new):
                if not within(p, left) and not within(q, right) and (x.kind == y.kind or not (x.kind and y.kind)):
                    profit[i, j] = DELETE * x.size + INSERT * y.size - MOVE - align(x, y, p, q, [], [])[0] - (RENAME if x.written != y.written else 0)
        for i, j in sorted(assign(profit), key=lambda k: -profit[k]) if profit else []:
            (p, x), (q, y) = old[i], new[j]
            if within(p, left) or within(q, right):
                continue
            cost -= profit[i, j]
            left.add(p)
            right.add(q)
            ops = [op for op in ops if not (op[0] == "removed" and op[1] == p or op[0] == "added" and op[2] == q)]
            ops.append(("moved", p, q, "|".join(x.written), "|".join(y.written)))
            ops += align(x, y, p, q, [], [])[1]
    return cost, ops


def placed_scripts(schemas: DataFrame) -> DataFrame:
    """(file_id, stream_id, pos, cost, op, path, place, before, after): the script of each file against the one before it.

    ``path`` and ``place`` are where a field was and is; steps are parted by ``SEP``.
    """
    before = schemas.select("stream_id", (F.col("pos") + 1).alias("pos"), F.col("fields").alias("old"))
    pairs = schemas.join(before, ["stream_id", "pos"]).select("file_id", "stream_id", "pos", F.to_json("old").alias("old"), F.to_json("fields").alias("new"))

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(DEEP, sys.getrecursionlimit()))
        cache: dict[tuple[str, str], tuple[float, list[Op]]] = {}
        for pdf in batches:
            out = []
            for file_id, stream_id, pos, old, new in pdf.itertuples(index=False):
                if (key := (old, new)) not in cache:
                    if len(cache) > 10_000:
                        cache.clear()
                    load = lambda s: tree_of([{"kind": None, "known": None} | f for f in json.loads(s)])
                    cache[key] = edit_script(load(old), load(new))
                cost, ops = cache[key]
                out += [(file_id, stream_id, pos, cost, *op) for op in ops]
            yield pd.DataFrame(out, columns=["file_id", "stream_id", "pos", "cost", "op", "path", "place", "before", "after"])

    return pairs.mapInPandas(diff, "file_id bigint, stream_id bigint, pos int, cost double, op string, path string, place string, before string, after string")


def scripts(schemas: DataFrame) -> DataFrame:
    """``placed_scripts`` with places as dotted names."""
    dotted = lambda c: F.replace(c, F.lit(SEP), F.lit(".")).alias(c)
    return placed_scripts(schemas).select("file_id", "stream_id", "pos", "cost", "op", dotted("path"), dotted("place"), "before", "after")


def found(raw: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind): changes of top-level fields, out of the edit scripts.

    A field that was moved, or renamed to a name that no alias joins to its own, is removed under one name and added under the other.
    """
    one = lambda name, kind: F.struct(F.col(name).alias("field_name"), kind.alias("change_kind"))
    apart = (F.col("path") != F.col("place")) & F.col("op").isin("moved", "renamed")
    rows = placed_scripts(file_schemas(raw, files, aliases)).where((F.col("op") != "retyped") | (F.col("path") == F.col("place")))
    changes = F.when(apart, F.array(one("path", F.lit("removed")), one("place", F.lit("added")))).otherwise(F.array(one("place", F.col("op"))))
    rows = rows.select("file_id", F.inline(changes))
    return rows.where(~F.col("field_name").contains(SEP) & ~F.col("field_name").isin(*IDENTITY)).distinct()


# -- one consistent table -------------------------------------------------------------------


def followed(steps: DataFrame) -> DataFrame:
    """(stream_id, place, since, until, root): what each renamed or moved field was at first, for positions from ``since`` to before ``until``.

    A field that was moved below another counts only if that one is new, a wrapper put around it: in an object that was
    there before, a field of the same name may well be another.  Each change is an arrow from a field to the one it was before; arrows are followed by doubling.
    """
    added = steps.where("op = 'added'").select(F.col("stream_id").alias("s"), F.col("pos").alias("p"), F.col("place").alias("wrapper")).distinct()
    above = F.array_join(F.slice(F.split("place", SEP), 1, F.size(F.split("place", SEP)) - 1), SEP)
    steps = steps.join(added, (F.col("op") == "moved") & (F.col("stream_id") == F.col("s")) & (F.col("pos") == F.col("p")) & (above == F.col("wrapper")), "left")
    below = F.col("place").contains(SEP) & (F.col("op") == "moved")
    link = F.col("op").isin("renamed", "moved") & (F.col("path") != F.col("place")) & (~below | F.col("wrapper").isNotNull())
    events = steps.where(link | (F.col("op") == "added")).select("stream_id", "pos", "place", F.when(link, F.col("path")).alias("path"))
    by_place = Window.partitionBy("stream_id", "place").orderBy("pos")
    events = cut(events.withColumn("until", F.lead("pos").over(by_place)))
    arrows = events.where(F.col("path").isNotNull()).select("stream_id", "place", F.col("pos").alias("since"), "until", "path")
    ends = arrows.select(F.col("stream_id").alias("s"), F.col("place").alias("from"), F.col("since").alias("start"), F.col("until").alias("stop"))
    inside = (F.col("stream_id") == F.col("s")) & (F.col("path") == F.col("from")) & (F.col("since") > F.col("start")) & (F.col("since") <= F.coalesce("stop", F.col("since")))
    state = cut(arrows.join(ends, inside, "left").select("stream_id", "place", "since", "until", F.col("path").alias("root"), F.col("from").alias("to"), F.col("start").alias("at")))
    while state.where(F.col("to").isNotNull()).limit(1).count():
        target = state.select("stream_id", F.col("place").alias("to"), F.col("since").alias("at"), F.col("root").alias("r"), F.col("to").alias("t"), F.col("at").alias("a"))
        state = cut(state.join(target, ["stream_id", "to", "at"], "left").select("stream_id", "place", "since", "until", F.coalesce("r", "root").alias("root"), F.col("t").alias("to"), F.col("a").alias("at")))
    return state.select("stream_id", "place", "since", "until", "root")


def projections(raw: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, names, lifted), compiled from the scripts.

    ``names``: from each name written at the top of a file to its column.  ``lifted``: from
    columns to the places, as steps, of nested fields that were moved there from the top.
    """
    schemas = cut(file_schemas(raw, files, aliases))
    roots = followed(cut(placed_scripts(schemas))).withColumnRenamed("stream_id", "s")
    now = (F.col("stream_id") == F.col("s")) & (F.col("pos") >= F.col("since")) & (F.col("pos") < F.coalesce("until", F.lit(1 << 31)))
    pairs = schemas.select("file_id", "stream_id", "pos", F.explode("fields").alias("f")).select("file_id", "stream_id", "pos", F.col("f.canonical").alias("canonical"), F.explode("f.written").alias("written"))
    flat = roots.where(~F.col("root").contains(SEP))
    named = pairs.join(flat.where(~F.col("place").contains(SEP)), now & (F.col("canonical") == F.col("place")), "left")
    names = named.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("written", F.coalesce("root", "canonical").alias("column")))).alias("names"))
    moved = schemas.select("file_id", "stream_id", "pos").join(flat.where(F.col("place").contains(SEP)), now)
    lifted = moved.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("root", F.split("place", SEP).alias("steps")))).alias("lifted"))
    return names.join(lifted, "file_id", "left")


def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator that yields each once, so that no later expression computes their columns again."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def consistent_table(raw: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every line of every file under one schema: identity, typed results, details, and the rest as JSON.

    Nothing is lost: ``other_fields`` has the fields of no column by their consistent names; ``rescued`` has, as written,
    what a column does not hold as it is (values of other kinds, nulls, and what another name of the column
    stands before); ``raw`` has lines that are no object.  Of several names of one column the first that is not null counts.
    """
    columns = (*IDENTITY, *NUMERIC, "skipped", *DETAILS)
    rows = raw.select("line_id", "file_id", "line_no", "payload", members(F.col("payload")).alias("m"))
    rows = settled(join_dimension(rows, projections(raw, files, aliases), ["file_id"]))
    # The kind of each value is worked out once; null has none and comes last among the names of a column.
    told = F.map_entries(F.transform_values("m", lambda _, v: kind_of(F.schema_of_variant(v))))
    keys = F.transform(told, lambda e: F.struct(F.coalesce(F.try_element_at("names", e["key"]), e["key"]).alias("column"), (e["value"] == "").alias("void"), e["key"].alias("written"), e["value"].alias("kind")))
    rows = settled(rows.withColumn("keys", F.array_sort(keys)))
    first = F.filter("keys", lambda x, i: (i == 0) | (F.get("keys", i - 1)["column"] != x["column"]))
    rows = settled(rows.withColumn("by", F.map_from_entries(F.transform(first, lambda x: F.struct(x["column"], x)))))
    held = lambda c: F.try_element_at("by", F.lit(c))
    value = lambda c: F.element_at("m", held(c)["written"])

    def nested(steps: Column) -> Column:
        """The value some steps down, names compared by letters and digits."""
        down = lambda at, step: F.get(F.filter(F.map_entries(F.try_variant_get(at, "$", "map<string,variant>")), lambda e: letters(e["key"]) == step), F.lit(0))["value"]
        return F.aggregate(F.slice(steps, 2, F.size(steps)), F.element_at("m", F.try_element_at("by", F.get(steps, F.lit(0)))["written"]), down)

    def number(c: str) -> Column:
        own = F.when(held(c)["kind"].isin("number", "string"), F.try_variant_get(value(c), "$", "double")).when(held(c)["kind"] == "object", F.try_variant_get(value(c), "$.value", "double"))
        lifted = F.try_element_at("lifted", F.lit(c))
        return F.coalesce(own, F.when(lifted.isNotNull(), F.try_variant_get(nested(lifted), "$", "double")))

    text = lambda c: F.try_variant_get(value(c), "$", "string")
    rows = rows.withColumns({f"c_{c}": text(c) for c in (*IDENTITY, *DETAILS)} | {f"c_{c}": number(c) for c in NUMERIC} | {"c_skipped": F.when(held("skipped")["kind"] == "boolean", F.try_variant_get(value("skipped"), "$", "boolean"))})

    def fits(x: Column) -> Column:
        """Whether a column holds a value just as it is."""
        v = F.element_at("m", x["written"])
        exact = F.coalesce(F.try_variant_get(v, "$", "double").cast("decimal(38,18)") == F.try_variant_get(v, "$", "decimal(38,18)"), F.lit(False))
        column, kind = x["column"], x["kind"]
        typed = F.when(column.isin(*NUMERIC), F.when(kind == "number", exact).otherwise(False)).when(column.isin(*IDENTITY), kind == "string").when(column == "skipped", kind == "boolean").when(column.isin(*DETAILS), kind.isin("object", "array")).otherwise(True)
        return (F.try_element_at("by", column)["written"] == x["written"]) & typed

    rest = F.filter("keys", lambda x: ~fits(x))
    pick = lambda xs, name: F.when(F.size(xs) > 0, F.to_json(F.map_from_entries(F.transform(xs, lambda x: F.struct(x[name], F.element_at("m", x["written"])))), {"ignoreNullFields": "false"}))
    others = F.filter(first, lambda x: ~x["column"].isin(*columns))
    return rows.select(
        "line_id",
        "file_id",
        "line_no",
        F.col("m").isNotNull().alias("parsed"),
        *(F.col(f"c_{c}").alias(c) for c in columns),
        pick(others, "column").alias("other_fields"),
        pick(rest, "written").alias("rescued"),
        F.when(F.col("m").isNull(), F.col("payload")).alias("raw"),
    )
