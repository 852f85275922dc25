"""Harmonisation of one quantity recorded in many units and spellings (problem 1).

Every target becomes one number in the common unit of its kind of motion:
degrees for angular motions, the ratio of end to start size for dollies.

Method.  The distinct spellings of units (in targets, where the most of
the words after the number that names a unit counts, in the sources' declarations, beside the number in the prompt) are mapped to the lexicon through
an inverted index of character bigrams; every candidate is verified by a
weighted edit distance.  The alias dictionary this yields is joined to all rows.
Only the dictionary goes through Python; numbers are read and converted in
built-in expressions.

Defined results.  Null or empty target, placeholder text, static or unknown
motion, a dimension without magnitude: no row.  Null source or unknown
source_id: no declared unit.  Null motion_type: the one in
constraint_annotations.  Repeated rows each give their own row.  Columns other
than those named are ignored, so clashing names do no harm.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchloom.session import cut, join_dimension

#: unit -> (kind, factor to the common unit, spellings).
LEXICON: dict[str, tuple[str, float, tuple[str, ...]]] = {
    "degree": ("deg", 1.0, ("deg", "degs", "degree", "degrees", "°", "º")),
    "radian": ("deg", 180.0 / math.pi, ("rad", "rads", "radian", "radians", "π")),
    "milliradian": ("deg", 0.18 / math.pi, ("mrad", "mrads", "milliradian", "milliradians")),
    "turn": ("deg", 360.0, ("turn", "turns", "rev", "revs", "revolution", "revolutions", "circle", "circles", "orbit", "orbits", "rotation", "rotations", "cycle", "cycles")),
    "gon": ("deg", 0.9, ("gon", "gons", "grad", "grads", "gradian", "gradians", "grade")),
    "arcminute": ("deg", 1.0 / 60.0, ("'", "′", "’", "arcmin", "arcmins", "arcminute", "arcminutes", "arc min", "arc minute", "arc minutes", "minute of arc", "minutes of arc")),
    "arcsecond": ("deg", 1.0 / 3600.0, ('"', "″", "arcsec", "arcsecs", "arcsecond", "arcseconds", "arc second", "arc seconds")),
    "ratio": ("x", 1.0, ("x", "×", "times", "fold", "ratio", "factor", "size", "multiple")),
    "percent": ("x", 0.01, ("%", "％", "pct", "percent", "per cent", "percentage")),
}
#: Kind of motion -> common unit.
KINDS = {"orbit": "deg", "pan": "deg", "crane": "deg", "tilt": "deg", "dolly": "x"}

#: Words of numbers in English; fixed values.
CARDINALS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
PARTS = {"half": 2, "halves": 2, "third": 3, "quarter": 4, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "twelfth": 12, "sixteenth": 16}
MULTIPLES = {"double": 2.0, "doubled": 2.0, "twice": 2.0, "triple": 3.0, "tripled": 3.0, "thrice": 3.0, "quadruple": 4.0, "quadrupled": 4.0}
WHOLES = {"full": 1.0, "whole": 1.0, "complete": 1.0}
FILLERS = {"of", "the", "by", "about", "around", "roughly", "approximately", "approx", "nearly", "orbit_by", "to", "in", "start", "original", "end", "its"}

#: Largest weighted edit distance, per character of the longer spelling, that still maps.
MAX_DISTANCE = 0.25
#: Words that one spelling of a unit may have.
RUN = 4
#: The length above which no spelling can be within ``MAX_DISTANCE`` of the longest known one.
LONGEST = int(max(len(s) for _, _, spellings in LEXICON.values() for s in spellings) * 0.3 / (0.3 - MAX_DISTANCE)) + 1
NUMBER = r"(?:\d+(?:\.\d+)?|\.\d+)"
WRITTEN = r"(?:\d+(?:[\u00a0\u2009\u202f ]\d{3}(?!\d))*(?:[.,]\d+)*|[.,]\d+)"


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which the slips of hasty writing cost less than other edits.

    Doubling or dropping a doubled letter and a trailing plural ``s`` cost 0.3, a swap of
    neighbours and vowel for vowel 0.5, anything else 1.
    """
    vowels, n, m = "aeiouy", len(a), len(b)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]

    def lone(s: str, i: int) -> float:
        if i and s[i] == s[i - 1] or i == len(s) - 1 and s[i] == "s":
            return 0.3
        return 1.0

    for i in range(1, n + 1):
        rows[i][0] = rows[i - 1][0] + lone(a, i - 1)
    for j in range(1, m + 1):
        rows[0][j] = rows[0][j - 1] + lone(b, j - 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            swap = 0.0 if x == y else 0.5 if x in vowels and y in vowels else 1.0
            best = min(rows[i - 1][j] + lone(a, i - 1), rows[i][j - 1] + lone(b, j - 1), rows[i - 1][j - 1] + swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            rows[i][j] = best
    return rows[n][m]


def phrase_value(text: str) -> tuple[float | None, str]:
    """The magnitude and the unit's words of a phrase without digits; (None, "") if it has none.

    >>> phrase_value("three-quarter turn")
    (0.75, 'turn')
    """
    words = re.findall(r"[^\W\d_]+|°|º|×|%|′|'", text.lower())
    total, seen, unit, i = 0.0, False, [], 0
    while i < len(words):
        w = words[i]
        nxt = words[i + 1] if i + 1 < len(words) else ""
        part = lambda s: PARTS.get(s) or PARTS.get(s[:-1] if s.endswith("s") else "")
        if w == "and" and seen:
            i += 1
            continue
        if w in MULTIPLES and not seen:
            total, seen = MULTIPLES[w], True
            unit.append("x")
        elif w in WHOLES:
            total, seen = total or WHOLES[w], True
        elif w in CARDINALS:
            value, j = float(CARDINALS[w]), i + 1
            if value >= 20 and nxt in CARDINALS and CARDINALS[nxt] < 10 and nxt not in ("a", "an"):
                value, j = value + CARDINALS[nxt], i + 2
            if j < len(words) and part(words[j]):
                value, j = value / part(words[j]), j + 1
            elif w in ("a", "an") and seen:
                i += 1
                continue
            if not (w in ("a", "an") and value == 1.0):
                total, seen = total + value, True
            elif not seen and j < len(words) and words[j] not in FILLERS:
                total, seen = 1.0, True
            i = j
            continue
        elif part(w):
            total, seen = total + 1.0 / part(w), True
        elif w not in FILLERS:
            unit.append(w)
        i += 1
    if not seen or not unit:
        return None, ""
    return total, "x" if unit[0] == "x" else " ".join(unit)


def clean_spelling(c: Column) -> Column:
    """A unit as compared: lower case, single blanks, without enclosing marks and filler words."""
    c = F.regexp_replace(F.lower(c), r"[\s\u00a0\u2009\u202f]+", " ")
    c = F.regexp_replace(c, r"^[\s.,;:()\[\]_-]+|[\s.,;:()\[\]_-]+$", "")
    return F.nullif(F.regexp_replace(c, r"^(?:of )?(?:a |an |the )?(?:full |whole |complete )?", ""), F.lit(""))


def _folded(c: Column) -> Column:
    """Lower case, plain digits, marks and blanks; numbers without grouping and with a decimal point.

    Blanks group thousands; so does a comma before a later decimal point; any other comma
    between digits is the decimal mark.
    """
    c = F.translate(F.lower(c), "０１２３４５６７８９．，／：％＋～\u00a0\u2009\u202f\u3000\t\r\n", "0123456789.,/:%+~       ")
    c = F.regexp_replace(c, r"(?<=\d) (?=\d{3}(?!\d))|(?<=\d),(?=\d{3}(?:,\d{3})*\.)", "")
    c = F.regexp_replace(c, r"(?<=\d),(?=\d)|^,(?=\d)", ".")
    return F.regexp_replace(c, r"^[~≈±+\s-]+(?:about |approx\.? |approximately |around |circa |ca\. )?|^(?:about |approx\.? |approximately |around |circa |ca\. )|\s+$", "")


def motion_kind(motion_type: Column, annotations: Column) -> Column:
    """orbit, pan, crane, tilt, dolly or whatever else the first word says; null if unknown."""
    named = F.nullif(F.trim(motion_type), F.lit(""))
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(named, F.get_json_object(annotations, "$.motion_type"))), r"([a-z]+)", 1), F.lit(""))


def readings(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """What is written for each row: kind, value, and the spellings of its unit by precedence."""
    sources = sources.groupBy("source_id").agg(F.max("angle_unit").alias("angle_unit"), F.max("dolly_unit").alias("dolly_unit"))
    written = rf"(?is)target\s+motion\s+value\s+[~≈+]?\s*{WRITTEN}"
    rows = samples.select(
        "row_id",
        "source_id",
        motion_kind(F.col("motion_type"), F.col("constraint_annotations")).alias("kind"),
        _folded(F.col("viewpoint_motion_target")).alias("t"),
        F.regexp_extract(F.col("prompt"), written + r"(?:\s*\([^)]*\)|,\s*expressed\s+in\s+[a-z]+|\s*(?:arc\s+minutes?|[^\s\d.,;:()]+))", 0).alias("clause"),
    ).where(F.col("kind").isin(*KINDS) & (F.col("t") != ""))
    rows = join_dimension(rows, sources, ["source_id"])
    t = F.col("t")
    number = lambda pattern, g: F.regexp_extract(t, pattern, g).try_cast("double")
    dms = rf"({NUMBER})\s*[°º]\s*({NUMBER})\s*[′'’]"
    pi = rf"({NUMBER})?\s*π\s*(?:/\s*({NUMBER}))?"
    fraction = rf"({NUMBER})\s*/\s*({NUMBER})(.*)$"
    ratio = rf"({NUMBER})\s*:\s*({NUMBER})"
    plain = rf"({NUMBER})(.*)$"
    form = F.when(t.contains("π"), "pi").when(t.rlike(dms), "dms").when(t.rlike(ratio), "ratio").when(t.rlike(fraction), "fraction").when(t.rlike(rf"(?:^|[\s_])[x×]\s*{NUMBER}\s*$"), "prefix").when(t.rlike(r"\d"), "plain")
    rows = rows.withColumn("form", form)
    form = F.col("form")
    value = (
        F.when(form == "pi", F.coalesce(number(pi, 1), F.lit(1.0)) * math.pi / F.nullif(F.coalesce(number(pi, 2), F.lit(1.0)), F.lit(0.0)))
        .when(form == "dms", number(dms, 1) + number(dms, 2) / 60)
        .when(form == "ratio", number(ratio, 1) / F.nullif(number(ratio, 2), F.lit(0.0)))
        .when(form == "fraction", number(fraction, 1) / F.nullif(number(fraction, 2), F.lit(0.0)))
        .otherwise(number(plain, 1))
    )
    unit = F.when(form == "pi", "rad").when(form == "dms", "deg").when(form.isin("ratio", "prefix"), "x").when(form == "fraction", F.regexp_extract(t, fraction, 3)).otherwise(F.regexp_extract(t, plain, 2))
    beside = F.regexp_replace(F.col("clause"), written + r"(?:,?\s*expressed\s+in)?", "")
    return rows.select(
        "row_id",
        "kind",
        value.alias("value"),
        F.when(form.isNull(), t).alias("phrase"),
        t.rlike(rf"^{NUMBER}$").alias("bare"),
        clean_spelling(unit).alias("u_target"),
        clean_spelling(F.when(F.col("kind") == "dolly", F.col("dolly_unit")).otherwise(F.col("angle_unit"))).alias("u_source"),
        clean_spelling(beside).alias("u_prompt"),
    )


def lexicon(spark) -> DataFrame:
    """One row for each known spelling."""
    rows = [(u, k, f, s) for u, (k, f, spellings) in LEXICON.items() for s in spellings]
    return spark.createDataFrame(rows, "unit string, kind string, factor double, known string")


def _grams(c: Column) -> Column:
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2))))


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(spelling, unit, kind, factor) for the distinct ``spelling`` of the input that map to the lexicon.

    Candidates share at least a third of their bigrams with a known spelling (found by an
    equi-join on bigrams); the weighted edit distance decides; ties go to the smaller
    distance, then to the unit's name.
    """
    known = lexicon(spellings.sparkSession)
    # No pair further apart in length can be within MAX_DISTANCE: each character too many costs 0.3 at least.
    wanted = spellings.where(F.length("spelling").between(1, LONGEST)).distinct()
    a = wanted.select("spelling", F.size(_grams(F.col("spelling"))).alias("na"), F.explode(_grams(F.col("spelling"))).alias("gram"))
    b = known.select("known", "unit", "kind", "factor", F.size(_grams(F.col("known"))).alias("nb"), F.explode(_grams(F.col("known"))).alias("gram"))
    pairs = a.join(F.broadcast(b), "gram").groupBy("spelling", "known", "unit", "kind", "factor").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.where(2 * F.col("shared") >= (F.col("na") + F.col("nb")) / 3)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far = [weighted_distance(x, y) / max(len(x), len(y)) for x, y in zip(pdf["spelling"], pdf["known"])]
            yield pdf.assign(far=pd.Series(far, index=pdf.index, dtype="float64"))[["spelling", "unit", "kind", "factor", "far"]]

    near = pairs.mapInPandas(verify, "spelling string, unit string, kind string, factor double, far double").where(F.col("far") <= MAX_DISTANCE)
    best = near.groupBy("spelling").agg(F.min_by(F.struct("unit", "kind", "factor"), F.struct("far", "unit")).alias("b"))
    return best.select("spelling", "b.*")


def unit_words(spellings: DataFrame) -> DataFrame:
    """(spelling, at, head): each distinct spelling (at 0) and every run of up to ``RUN`` of its words, by the place of the first."""
    words = F.split(F.trim(F.regexp_replace("spelling", r"[\s.,;:()\[\]_-]+", " ")), " ")
    run = lambda i, k: F.struct(i.alias("at"), F.array_join(F.slice(words, i, k), " ").alias("head"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(words) - i + 1)), lambda k: run(i, k))))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("spelling").alias("head")))
    return spellings.where(F.col("spelling").isNotNull()).distinct().select("spelling", F.inline(F.concat(whole, runs))).where(F.length("head") > 0)


def target_dictionary(heads: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spelling, kind, unit, factor): what the whole spelling maps to, else the first and then longest of its words that map to a unit of the kind."""
    known = heads.join(aliases.withColumnRenamed("spelling", "head"), "head")
    best = known.groupBy("spelling", "kind").agg(F.min_by(F.struct("unit", "factor"), F.struct("at", (-F.length("head")).alias("long"), "head")).alias("b"))
    return best.select("spelling", "kind", "b.*")


def phrase_dictionary(phrases: DataFrame) -> DataFrame:
    """(phrase, p_value, p_unit) for distinct phrases that name a magnitude in words."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [phrase_value(p) for p in pdf["phrase"]]
            yield pd.DataFrame({"phrase": pdf["phrase"], "p_value": pd.Series([g[0] for g in got], index=pdf.index, dtype="float64"), "p_unit": [g[1] for g in got]})

    out = phrases.where(F.col("phrase").isNotNull()).distinct().mapInPandas(read, "phrase string, p_value double, p_unit string")
    return out.where("not isnan(p_value) and p_value is not null")


def harmonise(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """row_id, kind, target_unit, value (in the common unit), unit (as resolved), via, bare.

    ``via`` says where the unit came from: target, source, prompt or default; unresolved is the
    default too, but of a target in which something is written beside the number that names no unit.
    """
    rows = cut(readings(samples, sources))
    words = cut(phrase_dictionary(rows.select("phrase")))
    heads = cut(unit_words(rows.select(F.col("u_target").alias("spelling")).unionByName(words.select(clean_spelling(F.col("p_unit")).alias("spelling")))))
    every = rows.select(F.explode(F.array_distinct(F.array("u_source", "u_prompt"))).alias("spelling")).where(F.col("spelling").isNotNull())
    aliases = cut(alias_dictionary(every.unionByName(heads.select(F.col("head").alias("spelling")))))
    targets = cut(target_dictionary(heads, aliases))
    common = F.when(F.col("kind") == "dolly", F.lit("x")).otherwise(F.lit("deg"))
    rows = join_dimension(rows.withColumn("common", common), words, ["phrase"])
    rows = rows.withColumn("u_target", F.coalesce(clean_spelling(F.col("p_unit")), "u_target")).withColumn("value", F.coalesce("p_value", "value")).where(F.col("value").isNotNull())
    for where, dictionary in (("target", targets), ("source", aliases), ("prompt", aliases)):
        named = dictionary.select(F.col("spelling").alias(f"u_{where}"), F.col("kind").alias("common"), *(F.col(c).alias(f"{where}_{c}") for c in ("unit", "factor")))
        rows = join_dimension(rows, named, [f"u_{where}", "common"])
    pick = F.lit(None)
    for where in ("prompt", "source", "target"):
        found = F.struct(F.col(f"{where}_unit").alias("unit"), F.col(f"{where}_factor").alias("factor"), F.lit(where).alias("via"))
        pick = F.when(F.col(f"{where}_unit").isNotNull(), found).otherwise(pick)
    via = F.when(F.col("u_target").isNotNull(), F.lit("unresolved")).otherwise(F.lit("default"))
    default = F.struct(F.when(F.col("common") == "x", F.lit("ratio")).otherwise(F.lit("degree")).alias("unit"), F.lit(1.0).alias("factor"), via.alias("via"))
    rows = rows.withColumn("pick", F.coalesce(pick, default))
    return rows.select("row_id", "kind", F.col("common").alias("target_unit"), (F.col("value") * F.col("pick.factor")).alias("value"), "pick.unit", "pick.via", "bare")


def found(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose target has a magnitude and is not already a bare number in the common unit."""
    rows = harmonise(samples, sources)
    already = F.col("bare") & F.col("unit").isin("degree", "ratio")
    return rows.where(~already).select("row_id", "target_unit", F.round(F.col("value") * 1000).cast("bigint").alias("milli"))
