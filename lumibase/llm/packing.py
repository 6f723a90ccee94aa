"""Packing token sequences into bins of a fixed capacity by harmonic classes.

A remainder of ``n`` tokens belongs to class ``k = capacity // n``: it is longer than ``capacity / (k + 1)`` and no
longer than ``capacity / k``. A bin of class ``k`` takes exactly ``k`` such documents. What is then free is shorter
than any document of the class, so the head of the next one fills it to the last token, and its tail goes to the
class of its own length. Each worker fills the bins of its own partition; nothing is shuffled, and no worker waits
for another. At the end of a partition the open bins (at most one a class, so under ``2 * sqrt(capacity)`` bins)
are joined into full sequences; the last few tokens become sequences whose lengths are powers of two, which need no
padding.

Defined results: a null or empty text has the end id alone. A null id is kept. Repeated rows are packed each by
itself. An empty table gives no rows. Further columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import Remembered, small_batches, text_or_empty

#: A worker remembers about so many different words, and as many runs of letters.
REMEMBERED = 250_000
#: Longer words are encoded each time.
REMEMBERED_LENGTH = 48
#: Marks that may follow a word's letters; the splitter always parts them from letters.
MARKS = ".,;:!?#$%&*"


class WordIds(Remembered):
    """Word -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary's normaliser and splitter never join characters across a blank or a newline, so the ids of a text
    are those of its words, one after another. Likewise a run of letters and the marks behind it are encoded apart.
    New runs of letters are encoded many at a time: each is one word to the vocabulary, and its last id tells so."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        last = [i for token, i in self.encoder.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.encoder.get_vocab_size(), bool)
        self.ends[last] = True
        self.letters = Remembered(REMEMBERED)
        self.marks: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        parts = []
        for word in self.unknown(words):
            run = word.rstrip(MARKS)
            low = run.lower()
            if run.isalpha() and low.isalpha() and len(word) <= REMEMBERED_LENGTH:
                parts.append((word, low if run.isascii() else run, word[len(run) :]))
        new = list(self.letters.unknown({run for _, run, _ in parts}))
        for first in range(0, len(new), 1000):
            runs = new[first : first + 1000]
            ids = np.array(self.encoder.encode(" ".join(runs), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.letters.update((run, raw[a:b]) for run, a, b in zip(runs, [0, *ends], ends, strict=False))
            if len(ends) != len(runs):  # a run that is no single word to the vocabulary
                self.letters.update((run, self._encode(run)) for run in runs)
        for word, run, marks in parts:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[marks] = self._encode(marks)
            self[word] = self.letters[run] + self.marks[marks]

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.__getitem__, words)) for words in cut]


_WORDS: dict[str, WordIds] = {}


def words_of(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


class HarmonicBins:
    """The open bins of one worker. A piece is (document, start, ids); ``put`` gets (piece, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int, put):
        self.capacity, self.sequence, self.put = capacity, first_sequence, put
        self.open: dict[int, list] = defaultdict(list)
        self.filled: dict[int, int] = defaultdict(int)

    def _close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.put(piece, self.sequence, offset)
            offset += len(piece[2]) // 4
        self.sequence += 1

    def add(self, document, ids: memoryview) -> None:
        size, full = len(ids) // 4, self.capacity
        start = 0
        while size - start >= full:
            self._close([(document, start, ids[4 * start : 4 * (start + full)])])
            start += full
        while start < size:
            k = full // (size - start)
            pieces, gap = self.open[k], full - self.filled[k]
            take = size - start if len(pieces) < k else gap
            pieces.append((document, start, ids[4 * start : 4 * (start + take)]))
            self.filled[k] += take
            start += take
            if self.filled[k] == full:
                self._close(self.open.pop(k))
                del self.filled[k]

    def finish(self) -> None:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        left = sum(len(piece[2]) // 4 for piece in rest)
        self.open.clear()
        self.filled.clear()
        rest.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                document, start, ids = rest.pop()
                take = min(room, len(ids) // 4)
                pieces.append((document, start, ids[: 4 * take]))
                if 4 * take < len(ids):
                    rest.append((document, start + take, ids[4 * take :]))
                room -= take
            self._close(pieces)


def harmonic_pack(
    df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("text"))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(7)]
        id_arrow = None

        def put(piece, sequence: int, offset: int) -> None:
            (document, tokens), start, ids = piece
            for column, value in zip(columns, (document, start, len(ids) // 4, bytes(ids), tokens, sequence, offset), strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            kinds = [id_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            for column in columns:
                column.clear()
            return out

        # a worker numbers its sequences from its partition's number on, so that no two workers share one
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40, put)
        for batch in batches:
            words, id_arrow = words_of(vocabulary), batch.schema.field(0).type
            for document, ids in zip(batch.column(0).to_pylist(), words.of(batch.column(1).to_pylist()), strict=True):
                ids += end
                bins.add((document, len(ids) // 4), memoryview(ids))
            yield flush()
        if id_arrow is not None:
            bins.finish()
            yield flush()

    return rows.mapInArrow(work, schema)
