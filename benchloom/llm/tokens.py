"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Texts are cut into words by the vocabulary's pattern.  The distinct words of a worker go
into a trie of bytes; a depth-first walk gives each node the last token of the encoding of
its prefix, so what words share is worked out once.  The last token of a prefix is the only
vocabulary entry that ends the prefix and is stable beside the last token of what precedes
it (two neighbours are stable if merging their bytes gives them back); following last tokens
backwards from a word's node reads off its ids.  The work on a word is linear in its length.

A worker keeps trie and ids for the words it has met and starts anew beyond a stated size,
so memory is bounded and no row leaves its partition: there is no shuffle.  Words of more than
``LONG`` bytes pass through the same states without becoming nodes, and are not kept.

Defined results.  Null and empty texts give an empty list; blank texts are encoded like any
other.  Strings of special tokens in a text are ordinary text.  Lone surrogates cannot occur in
Spark strings.  Repeated rows are encoded each.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Nodes of a trie, words with known ids, and pairs of neighbours that a worker keeps at most.
MAX_NODES, MAX_WORDS, MAX_PAIRS = 1_000_000, 500_000, 500_000
#: Bytes of a word up to which it becomes nodes of the trie.
LONG = 512


class TrieEncoder:
    """Ids of words by last-token states in a trie."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.tails = {t[i:] for t in self.ranks for i in range(len(t))}
        self.stable: dict[int, bool] = {}
        self.own: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last = [-1]
        self.words.clear()

    def merge(self, text: bytes) -> list[int]:
        """Plain merging of adjacent parts, lowest rank first; for the few bytes of one or two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def is_stable(self, a: int, b: int) -> bool:
        """Whether ``b`` can follow ``a`` in an encoding."""
        if (known := self.stable.get(a << 32 | b)) is None:
            if len(self.stable) >= MAX_PAIRS:
                self.stable.clear()
            known = self.stable[a << 32 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def is_own(self, a: int) -> bool:
        """Whether the bytes of ``a`` are encoded as ``a``."""
        if (known := self.own.get(a)) is None:
            known = self.own[a] = self.merge(self.bytes_of[a]) == [a]
        return known

    def last_token(self, word: bytes, end: int, states: array) -> int:
        """The last token of ``word[:end]``, given those of all shorter prefixes."""
        ends, n = [], 1
        while n <= end and (tail := word[end - n : end]) in self.tails:
            if (t := self.ranks.get(tail)) is not None:
                ends.append((n, t))
            n += 1
        for n, t in reversed(ends):
            if self.is_own(t) if n == end else self.is_stable(states[end - n], t):
                return t
        raise ValueError("a byte is missing from the vocabulary")

    def insert(self, word: str) -> list[int]:
        """The ids of a word; its prefixes join the trie unless it is a long one."""
        text, states = word.encode(), array("i", [-1])
        if len(text) > LONG:
            for end in range(1, len(text) + 1):
                states.append(self.last_token(text, end, states))
        else:
            node, child, last = 0, self.child, self.last
            for end, byte in enumerate(text, 1):
                if (nxt := child.get(node << 8 | byte)) is None:
                    nxt = child[node << 8 | byte] = len(last)
                    last.append(self.last_token(text, end, states))
                node = nxt
                states.append(last[node])
        ids, end = [], len(text)
        while end:
            ids.append(states[end])
            end -= len(self.bytes_of[states[end]])
        return ids[::-1]

    def cut(self, texts: Iterable[str | None]) -> Iterator[list[str]]:
        """The words of each text, while ``self.words`` has the ids of all of them."""
        words = self.words
        for text in texts:
            cut = self.split(text) if text else []
            if new := {w for w in cut if w not in words}:
                if len(self.last) > MAX_NODES or len(words) > MAX_WORDS:
                    self.clear()
                    new = set(cut)
                # Depth-first over new words: sorted order walks the trie that way.
                for w in sorted(new):
                    words[w] = self.insert(w)
            yield cut
            for w in new:
                if len(w) > LONG // 4:
                    del words[w]

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text."""
        words = self.words
        for cut in self.cut(texts):
            yield [i for w in cut for i in words[w]]

    def count_batch(self, texts: Iterable[str | None]) -> Iterator[int]:
        """How many ids each text has."""
        words = self.words
        for cut in self.cut(texts):
            yield sum(map(len, map(words.__getitem__, cut)))


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder for a vocabulary file; reused between batches and tasks."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def token_ids(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """array<int>: the ids of ``text``."""
    path = os.path.join(folder, name)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for texts in batches:
            flat, sizes = array("i"), np.zeros(len(texts) + 1, np.int32)
            for k, one in enumerate(e.encode_batch(texts.to_pylist()), 1):
                flat.extend(one)
                sizes[k] = len(one)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.frombuffer(flat, np.int32)))

    return ids(text)


def token_count(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """bigint: how many ids ``text`` has, without sending them back."""
    path = os.path.join(folder, name)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for texts in batches:
            yield pa.array(list(e.count_batch(texts.to_pylist())), pa.int64())

    return count(text)


def encode(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids."""
    return documents.select("doc_id", token_ids(F.col("text"), folder).alias("ids"))
