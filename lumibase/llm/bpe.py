"""Byte-level BPE by replaying the merges over a block of words at once.

The words of a block that the worker has not met yet lie side by side in one array of tokens. An inverted index
leads from the rank of a token pair to the positions of that pair. Ranks are taken in ascending order from a heap;
each position of the rank is merged, and only the pairs with its two neighbours enter the index anew. A merge can
bring up a pair of a lower rank; then the rest of the current rank waits until that one is done, so each word
passes through the very merges that it would see alone.

A text is split by the pattern; a worker remembers the ids of the words that recur. The corpus is so taken block by
block: a block is what a batch of texts has of words that its worker doesn't know. A merge never crosses a word, so the
ids are those of one replay over all words of the corpus. Such a replay over a table of all different words was left
out: their ids have to come back to every text, which shuffles the texts once and the words of each block twice.

Defined results: a null or empty text has no ids, and decodes to no bytes. Ids outside of the ranks can't be decoded
and raise a KeyError. Repeated rows, null ids and further columns are kept as they are, but for one that has the name
of the new column, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import Remembered, small_batches, text_or_empty

#: A worker remembers about so many words.
REMEMBERED = 300_000
#: White space as Unicode's White_Space property has it (fixed values).
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Ranks:
    """The rank file, and what this worker remembers of words."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        tokens = {rank: token for token, rank in self.rank.items()}
        laid = [tokens.get(rank, b"") for rank in range(max(tokens) + 1)]
        self.sizes = np.fromiter(map(len, laid), np.int64, len(laid))
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(laid), np.uint8)
        own = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.split = regex.compile(own).findall
        self.words = Remembered(REMEMBERED)
        #: Two neighbouring ranks, as one number -> the rank of both together.
        self.pairs = {}
        for token, rank in self.rank.items():
            for n in range(1, len(token)):
                a, b = self.rank.get(token[:n]), self.rank.get(token[n:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word, by all merges in the order of their ranks."""
        together = self.pairs.get
        byte = [self.rank[bytes([b])] for b in range(256)]
        token: list[int] = []
        after: list[int] = []
        starts = []
        for word in words:
            starts.append(len(token))
            token += [byte[b] for b in word]
            after += range(starts[-1] + 1, len(token))
            after.append(-1)
        before = [-1] * len(token)
        index: dict[int, list[int]] = {}
        for p, q in enumerate(after):
            if q >= 0:
                before[q] = p
                rank = together(token[p] << 32 | token[q])
                if rank is not None:
                    if rank in index:
                        index[rank].append(p)
                    else:
                        index[rank] = [p]
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for n, p in enumerate(places):
                q = after[p]
                if q < 0 or token[p] < 0 or together(token[p] << 32 | token[q]) != rank:
                    continue
                if heap and heap[0] < rank:
                    index[rank] = places[n:]
                    push(heap, rank)
                    break
                token[p], token[q] = rank, -1
                after[p] = right = after[q]
                left = before[p]
                if right >= 0:
                    before[right] = p
                    new = together(rank << 32 | token[right])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            push(heap, new)
                if left >= 0:
                    new = together(token[left] << 32 | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            push(heap, new)
        out = []
        for p in starts:
            ids = []
            while p >= 0:
                ids.append(token[p])
                p = after[p]
            out.append(ids)
        return out

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words; a word that is a token itself needs no merge."""
        new = []
        for word in self.words.unknown(words):
            raw = word.encode()
            rank = self.rank.get(raw)
            if rank is None:
                new.append((word, raw))
            else:
                self.words[word] = rank.to_bytes(4, "little")
        for (word, _), ids in zip(new, self.replay([raw for _, raw in new]), strict=True):
            self.words[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parted = [self.split(text) for text in texts]
        self.learn(set().union(*parted))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in parted]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, gathered from all tokens' bytes laid end to end."""
        at = np.frombuffer(ids, "<u4")
        if len(at) and (int(at.max()) >= len(self.sizes) or not self.sizes[at].all()):
            raise KeyError("an id is outside of the ranks")
        sizes = self.sizes[at]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[np.repeat(self.begins[at], sizes) + within].tobytes()


_RANKS: dict[tuple[str, str], Ranks] = {}


def ranks_of(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _RANKS:
        _RANKS[path, pattern] = Ranks(path, pattern)
    return _RANKS[path, pattern]


def _mapped(df: DataFrame, column: str, out: str, convert) -> DataFrame:
    """Replace one column by a binary one, batch by batch; a column that has the new one's name is left out."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (column, out)]
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{column}`"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` binary"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, own = batch.columns
            made = pa.array(convert(own.to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*others, made], names=[*(f.name for f in kept), out])

    return rows.mapInArrow(work, schema)


def encode(df: DataFrame, rank_file: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace the text by its ids: little-endian unsigned 32-bit integers in a binary column."""
    rows = df.withColumn(text_col, text_or_empty(text_col))
    return _mapped(rows, text_col, ids_col, lambda texts: ranks_of(rank_file, pattern).encode(texts))


def decode(df: DataFrame, rank_file: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids decode to no bytes."""
    rows = df.withColumn("_decoded_from", F.coalesce(F.col(ids_col), F.lit(b"")))

    def convert(all_ids):
        ranks = ranks_of(rank_file, pattern)
        return [ranks.decode(ids) for ids in all_ids]

    return _mapped(rows, "_decoded_from", bytes_col, convert)
