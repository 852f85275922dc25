"""Sentence boundaries across languages and scripts (problem 8).

1. A text is cut into units: blank lines end one, list items and marked headings are their own.
2. Inside a unit every run of final marks with its closing quotes and brackets is a
   candidate; so is a blank between two Thai characters, which always ends a sentence.
   Marks inside open quotes or brackets are none.
3. A maximum-entropy (logistic) classifier decides candidates by neighbouring tokens, case,
   length, digits, script and quoting.  It is trained on reliable boundaries of the corpus
   itself: marks that end a unit are boundaries, and so are those between a token that often ends
   units and a number; marks before a lower-case letter or a comma are none;
   nor are those after a token, or in a quoting pattern, that occurs often inside units and
   never at their end.

How often a token or pattern ends units or stands inside them, and how often a word begins
them, is counted over all documents into hash histograms of fixed size (``SLOTS`` counters),
which is all the classifier needs of the corpus.  Weights are fitted on the labelled candidates of at
most ``SAMPLE_DOCS`` documents (those with the smallest hashes), ``SAMPLE_ROWS`` rows at most; every
document is then classified.

Defined results.  Null, empty and blank texts have no sentences.  Offsets are code points; the end
is exclusive.  Repeated rows give their own sentences.  ``lang`` is not used, so wrong
values do no harm.  Without any documents, or any labelled row, the result is empty or
comes from the rules of lower case alone.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample, counters of each histogram, hashed weights.
SAMPLE_DOCS, SAMPLE_ROWS, SLOTS, WEIGHTS = 4_000, 200_000, 1 << 17, 1 << 16

MARKS = ".!?…。！？｡．؟۔।॥‼⁇⁈⁉።։។။"
OPEN = {"“": "”", "‘": "’", "„": "“”", "‚": "‘’", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "（": "）", "(": ")", "[": "]", "{": "}", "〔": "〕", "［": "］"}
CLOSE = set("”’»›」』》〉】）)]}〕］")
PAIRS = regex.compile("[" + regex.escape("".join(OPEN) + "".join(sorted(CLOSE))) + "\"']")
SCRIPTS = regex.compile(r"(?P<Latin>\p{Latin})|(?P<Cyrillic>\p{Cyrillic})|(?P<Han>\p{Han})|(?P<Kana>[\p{Hiragana}\p{Katakana}ー])|(?P<Hangul>\p{Hangul})|(?P<Thai>\p{Thai})|(?P<Arabic>\p{Arabic})|(?P<Deva>\p{Devanagari})|(?P<Digit>\p{N})|(?P<Blank>\s)|(?P<Letter>\p{L})")
BREAKS = r"\n\r\x0b\x0c\x85\u2028\u2029"
BLANK_LINE = regex.compile(rf"(?:\r\n|[{BREAKS}])[^\S{BREAKS}]*(?:\r\n|[{BREAKS}])\s*")
LINE = regex.compile(rf"[^{BREAKS}]+")
BULLET = regex.compile(r"\s*(?:[-*+•‣◦▪–—·]\s+\S|#{1,6}\s+\S)")
NUMBERED = regex.compile(r"\s*[(（]?(\d{1,3})[.)）、]\s*\S")
RUN = regex.compile(rf"[{regex.escape(MARKS)}](?:\s?(?=…|\.\.)[{regex.escape(MARKS)}]+|[{regex.escape(MARKS)}]+)?")
THAI_BLANK = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})")
TOKEN = regex.compile(r"[^\s(（\[“”„«»‘「『《\"]+$")
#: What precedes a sentence that follows a mark without a blank.
GLUED = regex.compile(r"^.*\p{Ll}[.!?](?=\p{Lu})")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’.][\p{L}\p{N}]+)*")
DIGITS = regex.compile(r"\p{N}+")
MARK_SET, MARK_OR_CLOSE = frozenset(MARKS), frozenset(MARKS) | CLOSE
#: Contexts whose decision a worker remembers.
CONTEXTS = 200_000


@lru_cache(4096)
def script(ch: str) -> str:
    m = SCRIPTS.match(ch)
    return m.lastgroup if m else "Other"


@lru_cache(100_000)
def shape(token: str) -> str:
    """A token as counted: lower case, digits as one 9, at most its last 16 characters."""
    return DIGITS.sub("9", token.lower())[-16:]


@lru_cache(200_000)
def slot(kind: str, key: str) -> int:
    return zlib.crc32(f"{kind}\x1f{key}".encode()) % SLOTS


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, where prose starts after a list marker) of each unit, blanks trimmed."""
    out = []
    begin = 0
    for m in [*BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        cuts, number, first = [begin], None, True
        for line in LINE.finditer(text, begin, end):
            if line.group().isspace():
                continue
            n = NUMBERED.match(text, line.start(), end)
            value = int(n.group(1)) if n else None
            if n and (first or number is not None and value == number + 1):
                number = value
                cuts.append(line.start())
            elif BULLET.match(text, line.start(), end):
                number = None
                cuts.append(line.start())
            first = False
        cuts.append(end)
        for a, b in zip(cuts, cuts[1:]):
            piece = text[a:b]
            if stripped := piece.strip():
                at = a + len(piece) - len(piece.lstrip())
                marker = NUMBERED.match(text, at, at + len(stripped))
                skip = marker.end() - 1 if marker and a != begin or marker and len(cuts) > 3 else at
                out.append((at, at + len(stripped), skip))
        begin = m.end() if m else end
    return out


@dataclass(slots=True)
class Candidate:
    """A place where a sentence may end, and what is around it."""

    end: int
    final: bool
    inside: bool
    mark: str
    closers: str
    opened: str
    token: str
    left: str
    gap: bool
    nxt: str
    at: int

    @property
    def before(self) -> str:
        """The token before ``token``."""
        return last_token(self.left)[0]

    def word(self, text: str, end: int) -> str:
        """The first word of what follows."""
        for i in range(self.at, min(self.at + 3, end)):
            if w := WORD.match(text, i, min(end, self.at + 40)):
                return w.group().lower()
        return ""


def last_token(left: str) -> tuple[str, str]:
    """The last token of a text that ends in no blank, and what precedes it."""
    head, _, token = left.rpartition(" ")
    if not token.isalnum():
        t = TOKEN.search(left)
        if t is None:
            return "", ""
        head, token = left[: t.start()], t.group()
        if "." in token or "!" in token or "?" in token:
            token = GLUED.sub("", token)
    return token, head.rstrip()


def follows(text: str, at: int, end: int) -> tuple[int, str]:
    """Where what follows begins, and its class."""
    i = at
    while i < end and text[i].isspace():
        i += 1
    if i >= end:
        return i, "end"
    ch = text[i]
    if ch.islower():
        return i, "lower"
    if ch.isupper() or ch.istitle():
        return i, "upper"
    if ch in OPEN or ch in "\"'¿¡" and i + 1 < end and not text[i + 1].isspace():
        kind = "quote" if ch not in "(（[{" else "bracket"
        if w := WORD.match(text, i, min(end, i + 40)) or WORD.match(text, i + 1, min(end, i + 40)) or WORD.match(text, i + 2, min(end, i + 40)):
            kind += "_low" if w.group()[0].islower() else "_up"
        return i, kind
    if ch.isdecimal():
        return i, "digit"
    if ch.isalpha() or unicodedata.category(ch).startswith("M"):
        return i, script(ch)
    return i, "goes_on" if ch in ",;:،؛、，；：–—-)/”’»" else "symbol"


def candidates(text: str, start: int, end: int, skip: int) -> list[Candidate]:
    """The candidates of a unit, in order."""
    out: list[Candidate] = []
    stack: list[tuple[str, int]] = []
    # Quotes that never close within the unit open nothing.
    spans: list[tuple[int, int]] = []
    closed_at: dict[int, tuple[str, int]] = {}

    waiting: Counter[str] = Counter()  # closing marks that some open one waits for

    def drop() -> tuple[str, int]:
        opener, since = stack.pop()
        waiting.subtract(OPEN.get(opener, ""))
        return opener, since

    def close(at: int) -> None:
        opener, since = drop()
        spans.append((since, at))
        closed_at[at] = opener, since

    for hit in PAIRS.finditer(text, start, end):
        ch, i = hit.group(), hit.start()
        top = stack[-1][0] if stack else ""
        if top and ch in OPEN.get(top, "") or ch == '"' == top or ch == "'" == top and (i + 1 >= end or not text[i + 1].isalnum()):
            close(i)
        elif ch in OPEN or ch == '"' or ch == "'" and (i == start or not text[i - 1].isalnum()) and i + 1 < end and text[i + 1].isalnum():
            stack.append((ch, i))
            waiting.update(OPEN.get(ch, ""))
        elif ch in CLOSE and waiting[ch] > 0:
            while ch not in OPEN.get(stack[-1][0], ""):
                drop()
            close(i)
    begins, ends = sorted([a for a, _ in spans]), sorted([b for _, b in spans])
    pos = start
    while m := RUN.search(text, pos, end):
        pos = at = m.end()
        if m.start() < skip:
            continue
        opened, closers = "", ""
        while at < end:
            j = at
            if j + 1 < end and text[j].isspace() and text[j] not in "\n\r" and text[j + 1] == "»" and j + 1 in closed_at:
                j += 1
            if j in closed_at:
                opener, a = closed_at[j]
                b = a - 1
                while b >= start and text[b].isspace():
                    b -= 1
                opened = "start" if b < start or text[b] in MARK_SET or text[b] in CLOSE and b - 1 >= start and (text[b - 1] in MARK_SET or text[b - 2 : b - 1] in MARK_SET) else "colon" if text[b] in ":：،,，" else "mid"
                if opener in "([{（【〔［":
                    opened = "b" + opened
                closers += text[j]
                at = j + 1
            elif closers and text[j] in MARK_SET:
                at = j + 1
            else:
                break
        pos = max(pos, at)
        i, nxt = follows(text, at, end)
        gap = i > at
        mark = m.group()
        alone = mark == "."
        if nxt != "end" and not gap:
            prev, ch = text[m.start() - 1 : m.start()], text[at]
            if alone and not closers and (not prev.islower() or not ch.isupper() or not text[m.start() - 2 : m.start() - 1].islower()):
                continue
            if mark in ("!", "?", "…", "...") and not closers and ch.isalnum() and not (prev.isalnum() and ch.isupper()) and script(ch) in ("Latin", "Cyrillic", "Digit"):
                continue
        if m.start() > start and text[m.start() - 1].isspace() and alone and not gap and nxt == "digit":
            continue
        left = text[max(start, m.start() - 40) : m.start()].rstrip()
        token, rest = last_token(left)
        kind = "dot" if alone else "ell" if mark[0] == "…" or mark.startswith("..") or "…" in mark else mark[-1]
        inside = bool(begins) and bisect_left(begins, at - 1) > bisect_right(ends, at - 1)
        out.append(Candidate(at, nxt == "end", inside, kind, closers, opened, token or left[-1:], rest, gap, nxt, i))
    return out


def patterns(c: Candidate) -> list[tuple[str, str]]:
    """The keys under which a candidate is counted."""
    last = script(c.token[-1:]) if c.token else "none"
    token = shape(c.token)
    keys = [("sig", f"{c.mark}|{c.closers}|{c.opened}|{last}")]
    if c.mark == "dot":
        keys.append(("tok", token + ("|" + c.closers if c.closers else "")))
        if token == "9" and DIGITS.fullmatch(c.token) or len(token) <= 2:
            keys.append(("two", f"{shape(c.before)} {token}"))
    return keys


def count(texts: Iterator[str], mid: np.ndarray, fin: np.ndarray) -> None:
    """Adds to the counters of what stands inside units and what ends (or, for words, begins) them."""
    inner: Counter[str] = Counter()
    for text in texts:
        for start, end, skip in units(text):
            first = WORD.match(text, skip if skip != start else start, end) or WORD.search(text, start, min(end, start + 4))
            inner.update(map(str.lower, WORD.findall(text, start, end)[1:]))
            marked = False
            for c in candidates(text, start, end, skip):
                if c.inside:
                    continue
                counts = fin if c.final else mid
                for kind, key in patterns(c):
                    counts[slot(kind, key)] += 1
                marked |= c.final
            if marked and first:
                fin[slot("word", first.group().lower())] += 1
    for word, n in inner.items():
        mid[slot("word", word)] += n


def level(mid: int, fin: int, share: float) -> str:
    """How a count at the end compares with what is expected of sentence ends."""
    n = mid + fin
    if n < 4:
        return "rare"
    odds = fin / max(share * n, 1e-9)
    name = "none" if fin == 0 and share * n >= 2.5 else "few" if odds < 0.12 else "some" if odds < 0.4 else "many"
    return name + ("" if n >= 30 else "?")


@dataclass
class Corpus:
    """The counters of all documents."""

    mid: np.ndarray
    fin: np.ndarray
    share: float

    def level(self, kind: str, key: str) -> str:
        s = slot(kind, key)
        return level(int(self.mid[s]), int(self.fin[s]), self.share)

    def begins(self, word: str) -> str:
        """How readily a word begins a unit."""
        s = slot("word", word)
        mid, fin = int(self.mid[s]), int(self.fin[s])
        if mid + fin < 4:
            return "rare"
        r = fin / (mid + fin)
        return "never" if fin == 0 else "little" if r < 0.02 else "often" if r < 0.2 else "mostly"


def facts(c: Candidate, word: str, corpus: Corpus) -> list[str]:
    """The features of a candidate before ``word``."""
    found = {kind: corpus.level(kind, key) for kind, key in patterns(c)}
    sig, tok, two = found["sig"], found.get("tok", "-"), found.get("two", "-")
    begins = corpus.begins(word) if word else "-"
    token = c.token
    form = "digits" if token.isdecimal() else "single" if len(token) == 1 and token.isalpha() else "dotted" if "." in token else "caps" if token[:1].isupper() else "plain"
    length = min(len(token), 8)
    last = script(token[-1:]) if token else "none"
    nxt = c.nxt if c.gap else "tight_" + c.nxt
    return [
        "bias", f"mark={c.mark}", f"next={nxt}", f"mark={c.mark},next={nxt}", f"sig={sig},next={nxt}", f"tok={tok}", f"tok={tok},next={nxt}", f"two={two}", f"two={two},tok={tok}",
        f"begins={begins},mark={c.mark}", f"begins={begins},tok={tok}", f"begins={begins},two={two}", f"form={form},len={length},mark={c.mark}", f"form={form},tok={tok}", f"last={last},mark={c.mark}", f"sig={sig}", f"opened={c.opened},next={nxt}", f"word={word}", f"token={shape(token)}",
    ]


def label(c: Candidate, corpus: Corpus) -> int | None:
    """1 or 0 where the case is reliable, else None."""
    if c.final:
        return 1
    if c.nxt in ("lower", "goes_on", "quote_low", "bracket_low"):
        return 0
    levels = [corpus.level(kind, key) for kind, key in patterns(c)]
    if "none" in levels:
        return 0
    if c.nxt == "digit" and c.gap and set(levels) == {"many"}:
        return 1
    return None


@lru_cache(200_000)
def weight_of(fact: str) -> int:
    return zlib.crc32(fact.encode()) % WEIGHTS


def labelled(text: str, corpus: Corpus) -> list[tuple[list[int], int]]:
    """Training rows of a text; a final mark looks ahead to the unit that comes next."""
    out = []
    cut = units(text)
    for k, (start, end, skip) in enumerate(cut):
        for c in candidates(text, start, end, skip):
            if c.inside or (y := label(c, corpus)) is None:
                continue
            if c.final:
                if k + 1 == len(cut):
                    continue
                end = cut[k + 1][1]
                c.at, c.nxt = follows(text, cut[k + 1][0], end)
                c.gap = script(c.token[-1:] or " ") not in ("Han", "Kana")
                if c.nxt in ("lower", "goes_on", "symbol", "end"):
                    continue
            out.append(([weight_of(f) for f in facts(c, c.word(text, end), corpus)], y))
    return out


def fit(rows: list[list[int]], labels: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Weights of the logistic model by gradient steps scaled for each weight (Adagrad), full batch."""
    weights, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    if not len(rows):
        return weights
    x = np.array(rows)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30))) - labels
        gradient = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), WEIGHTS) / len(labels) + decay * weights
        seen += gradient**2
        weights -= rate * gradient / np.sqrt(seen)
    return weights


class Cutter:
    """The classifier with the contexts it has decided, of which it remembers at most ``CONTEXTS``."""

    def __init__(self, corpus: Corpus, weights: np.ndarray):
        self.corpus, self.weights = corpus, weights.tolist()
        self.known: dict[tuple, bool] = {}

    def ends(self, c: Candidate, text: str, end: int) -> bool:
        """Whether a sentence ends at a candidate."""
        word = c.word(text, end)
        context = c.token, c.left[-16:] if len(c.token) <= 2 or c.token.isnumeric() else "", word, c.mark, c.closers, c.opened, c.nxt, c.gap
        if (known := self.known.get(context)) is None:
            if len(self.known) >= CONTEXTS:
                self.known.clear()
            weights = self.weights
            known = self.known[context] = sum([weights[weight_of(f)] for f in facts(c, word, self.corpus)]) > 0
        return known


def split(text: str | None, cutter: Cutter) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out: list[tuple[int, int]] = []
    for start, end, skip in units(text or ""):
        ends = {end}
        for c in candidates(text, start, end, skip):
            if not (c.final or c.inside or c.nxt == "lower" or c.nxt == "goes_on") and cutter.ends(c, text, end):
                ends.add(c.end)
        ends |= {m.start() for m in THAI_BLANK.finditer(text, start, end)}
        at = start
        for e in sorted(ends):
            while at < e and text[at].isspace():
                at += 1
            stop = e
            while stop > at and text[stop - 1].isspace():
                stop -= 1
            if stop > at:
                out.append((at, stop))
            at = e
    return out


def survey(documents: DataFrame) -> Corpus:
    """The counters of all documents; what reaches the driver is their fixed number."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mid, fin = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for pdf in batches:
            count((t for t in pdf["text"] if t), mid, fin)
        used = np.flatnonzero(mid + fin)
        yield pd.DataFrame({"slot": used, "mid": mid[used], "fin": fin[used]})

    rows = documents.select("text").where(F.col("text").isNotNull()).mapInPandas(scan, "slot bigint, mid bigint, fin bigint").groupBy("slot").agg(F.sum("mid").alias("mid"), F.sum("fin").alias("fin")).toPandas()
    mid, fin = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    mid[rows["slot"].to_numpy(np.int64)], fin[rows["slot"].to_numpy(np.int64)] = rows["mid"], rows["fin"]
    dots = [slot("sig", f"{m}|||{s}") for m in ("dot", "。", "!", "?", "।", "！", "？") for s in ("Latin", "Cyrillic", "Han", "Kana", "Hangul", "Deva", "Arabic")]
    ends, inner = sum(int(fin[s]) for s in dots), sum(int(mid[s]) for s in dots)
    return Corpus(mid, fin, max(0.02, 0.8 * ends / max(ends + inner, 1)))


def sampled(documents: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """The ``size`` distinct texts of the smallest hashes; only hashes are shuffled for all documents, and no task gets all texts of the sample."""
    texts = documents.select("text", F.xxhash64("text").alias("place")).where(F.col("text").isNotNull())
    least = texts.select("place").distinct().orderBy("place").limit(size)
    return texts.join(F.broadcast(least), "place", "left_semi").groupBy("place").agg(F.min("text").alias("text")).select("text")


def train(documents: DataFrame, corpus: Corpus) -> np.ndarray:
    """Weights from a bounded sample of distinct texts."""
    sample = sampled(documents)
    shared = documents.sparkSession.sparkContext.broadcast(corpus)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for t in pdf["text"] for r in labelled(t, shared.value)]
            yield pd.DataFrame({"x": pd.Series([r[0] for r in rows], dtype=object), "y": pd.Series([r[1] for r in rows], dtype="int32")})

    rows = sample.mapInPandas(scan, "x array<int>, y int").orderBy(F.xxhash64("x"), "y").limit(SAMPLE_ROWS).toPandas()
    return fit([list(r) for r in rows["x"]], rows["y"].to_numpy(float))


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos: one row a sentence."""
    corpus = survey(documents)
    weights = train(documents, corpus)
    shared = documents.sparkSession.sparkContext.broadcast((corpus, weights))

    @F.arrow_udf("array<struct<start_pos:int,end_pos:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter = Cutter(*shared.value)
        for texts in batches:
            flat, sizes = array("i"), np.zeros(len(texts) + 1, np.int32)
            for k, text in enumerate(texts.to_pylist(), 1):
                got = split(text, cutter)
                sizes[k] = len(got)
                for span in got:
                    flat.extend(span)
            spans = np.frombuffer(flat, np.int32).reshape(-1, 2)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start_pos", "end_pos"]))

    rows = documents.select("doc_id", F.explode(cut("text")).alias("s"))
    return rows.select("doc_id", "s.start_pos", "s.end_pos")
