"""Sum-of-squares online packing.

A document's tokens (with its end id) are cut into full windows and a remainder.
Each remainder goes, in order of arrival, to the fill level that minimises the
sum of the squared counts of partially filled windows per level; the counts are
one array with an entry per level, so a placement is one vector expression. Each
input split packs on its own, without a shuffle; at its end the windows still open
are consolidated by cutting the emptiest to fill the fullest, so a split pads one
window at most.

Edge cases. Null or empty text is the end id alone. A document longer than the
window fills whole windows and leaves its remainder. Repeated rows are packed as
documents of their own; their pieces share doc_id. An empty table gives no
pieces. Sequences are padded to the window, except where the fill is a power of two.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._shared import as_texts, map_arrow
from ._tokenize import CHUNK_ENTRIES, word_bpe

# doc, start, ids (bytes), doc_tokens
Piece = tuple[object, int, bytes, int]


class SumOfSquares:
    """Packs pieces into windows; `add` and `close` yield finished windows as lists of pieces."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # partially filled windows per level; 0 and size stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(size)]

    def level_for(self, n: int) -> int:
        """The level to fill for a piece of n < size; 0 is a new window. Ties go to the fullest level."""
        size, counts = self.size, self.counts
        best, cost = 0, 2 * counts[n] + 1
        levels = np.flatnonzero(counts[1 : size - n + 1]) + 1
        if len(levels):
            after = np.where(levels + n < size, 2 * (counts[levels + n] - counts[levels]) + 2, 1 - 2 * counts[levels])
            at = len(levels) - 1 - int(np.argmin(after[::-1]))
            if after[at] <= cost:
                best = int(levels[at])
        return best

    def add(self, doc, ids: bytes) -> Iterator[list[Piece]]:
        size, total = self.size, len(ids) // 4
        at = 0
        while total - at >= size:
            yield [(doc, at, ids[4 * at : 4 * (at + size)], total)]
            at += size
        n = total - at
        if n:
            level = self.level_for(n)
            window = self.open[level].pop() if level else []
            if level:
                self.counts[level] -= 1
            window.append((doc, at, ids[4 * at :], total))
            if level + n == size:
                yield window
            else:
                self.open[level + n].append(window)
                self.counts[level + n] += 1

    def close(self) -> Iterator[list[Piece]]:
        """Consolidate what is open: pieces of the emptiest windows fill the fullest, cut where needed."""
        left = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        first, last = 0, len(left) - 1
        while first < last:
            room, window = self.size - left[first][0], left[first][1]
            while room and first < last:
                have, donor = left[last]
                doc, at, ids, total = donor.pop()
                n = len(ids) // 4
                take = min(n, room)
                window.append((doc, at + n - take, ids[4 * (n - take) :], total))
                if take < n:
                    donor.append((doc, at, ids[: 4 * (n - take)], total))
                left[last] = (have - take, donor)
                room -= take
                if not donor:
                    last -= 1
            if room == 0:
                yield window
                first += 1
            else:
                left[first] = (self.size - room, window)
        if first == last and left:
            yield left[first][1]
        self.open = [[] for _ in range(self.size)]
        self.counts[:] = 0


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False, cache_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """One row per piece of docs(doc_id, text).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (array<int>) if asked for. sequence_id is the split's number times
    2^32 plus the window's number in it, so a run over other splits names (and fills) sequences otherwise.
    cache_entries bounds the chunks whose ids a worker keeps: fewer take less memory and more time, the result is the same.
    """
    end = array("I", [end_id]).tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = word_bpe(tokenizer_path, cache_entries)
        packer = SumOfSquares(size)
        next_id = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal next_id
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                out.append((doc, start, n, zlib.crc32(ids), total, next_id, at, ids if with_ids else None))
                at += n
            next_id += 1

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[0] for r in out], doc_type)] + [pa.array([r[i] for r in out], pa.int64()) for i in range(1, 7)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(r[7], "<u4").astype(np.int32) for r in out], pa.list_(pa.int32())))
                names.append("ids")
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        doc_type = None
        for b in batches:
            doc_type = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), as_texts(b.column("text")), strict=True):
                for window in packer.add(doc, encoder.encode(text) + end):
                    emit(window)
            yield batch()
        if doc_type is not None:
            for window in packer.close():
                emit(window)
            yield batch()

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {id_type}, {SCHEMA}" + ", ids array<int>" * with_ids)
