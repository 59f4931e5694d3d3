"""Size-partitioned MinHash containment search, verified exactly.

Short test items are searched inside long documents. Words are lower-cased runs of
letters, digits and other scripts' characters; an item's set are its distinct shingles
of five words (an item of fewer words is one shingle of its own length).

Items are partitioned by set size, in powers of two; U is a partition's largest size. For each
partition a document is cut into blocks of U shingles, and each two neighbouring blocks are a
window with a MinHash signature; a passage of up to U shingles lies in one window whole. An
item of the least size, contained at the threshold, has a Jaccard similarity of at
least j with that window, so a partition's number of bands (of one row each) is the least b for
which 1 - (1 - j)^b reaches `recall`. An item that shares a band with a window is a
candidate, and is verified by exact containment of its shingles in the whole document's: nothing is reported
wrongly, and of items that lie in one passage all but 1 - recall are found. (A set scattered over
many windows can be missed; the tests measure recall against the exact result.)

Items are taken in blocks of at most `block_bytes` (a larger item is a block of its own). One block, the usual case,
is broadcast in a lazy plan; of several, each is held against all documents and its result written before
the next is read, so the driver holds one at a time. Repeated (item, text) rows are one item.

Edge cases. Null or empty items match nothing, null or empty documents match
nothing; both are absent from the result. Items with equal text are reported under
each item_id. Repeated documents repeat their rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import as_texts, discard, map_arrow, written
from ._shingles import mix, overlap, shingle_hashes, shingle_set, word_hashes

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_BITS = 20
_SHIFT = np.uint64(64 - _BITS)
_PIECE = 1 << 18  # signature cells that are made at once


def words_of(text: str) -> list[bytes]:
    return re.sub("[‐-‧ «»]", " ", text).lower().encode("utf-8", "replace").translate(_TO_SPACE).split() if not text.isascii() else text.lower().encode().translate(_TO_SPACE).split()


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    block_bytes: int = 32 << 20


def _bands(least: int, most: int, p: Params) -> int:
    """Bands for items of sizes least to most and windows of 2 * most shingles."""
    shared = math.ceil(p.threshold * least - 1e-9)
    j = shared / (2 * most + least - shared)
    return math.ceil(math.log(1 - p.recall) / math.log(1 - j)) if j < 1 else 1


def _multipliers(n: int) -> np.ndarray:
    """Odd multipliers, one for each band; times a mixed hash they order the shingles independently."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Partition:
    """Items of one shingle length and size class, and their signatures by band."""

    def __init__(self, part: int, items: list[tuple[int, np.ndarray]], params: Params):
        self.block = (1 << part) - 1
        self.rows = _multipliers(_bands(1 << (part - 1), self.block, params))[:, None]
        values = np.concatenate([(s * self.rows).min(axis=1) for _, s in items])
        owners = np.repeat([i for i, _ in items], len(self.rows))
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[values >> _SHIFT] = True

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that share a band with a window of the document, taken piece by piece (neighbours overlap by a block)."""
        out: set[int] = set()
        blocks = max(2, _PIECE // (self.block * len(self.rows)))
        for at in range(0, max(1, len(shingles) - self.block), (blocks - 1) * self.block):
            piece = shingles[at : at + blocks * self.block]
            mins = np.minimum.reduceat(piece * self.rows, np.arange(0, len(piece), self.block), axis=1)
            if mins.shape[1] > 1:
                mins = np.minimum(mins[:, :-1], mins[:, 1:])
            near = mins[self.bitmap[mins >> _SHIFT]]
            if len(near):
                low, high = np.searchsorted(self.values, near, "left"), np.searchsorted(self.values, near, "right")
                for i, j in set(zip(low.tolist(), high.tolist(), strict=True)):
                    out.update(self.owners[i:j].tolist())
        return out


class ItemIndex:
    """The signatures and full sets of one block of items."""

    def __init__(self, items: list[tuple], params: Params):
        self.params = params
        self.items = []  # (item_id, size partition, set)
        groups: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                s = shingle_set(words, params.shingle)
                groups.setdefault((min(params.shingle, len(words)), len(s).bit_length()), []).append((len(self.items), s))
                self.items.append((item_id, len(s).bit_length(), s))
        self.partitions: dict[int, list[_Partition]] = {}
        for (length, part), members in sorted(groups.items()):
            self.partitions.setdefault(length, []).append(_Partition(part, members, params))

    def search(self, text: str) -> list[tuple]:
        """(item, size partition, shared, size) of each item contained in the text."""
        words, found = words_of(text), []
        hashes = word_hashes(words)
        for length, partitions in self.partitions.items():
            if len(words) < length:
                continue
            shingles = shingle_hashes(hashes, length)
            candidates = set().union(*(p.candidates(shingles) for p in partitions))
            if not candidates:
                continue
            own = np.unique(shingles)
            for c in sorted(candidates):
                item_id, partition, s = self.items[c]
                shared = overlap(s, own)
                if shared >= self.params.threshold * len(s) - 1e-9:
                    found.append((item_id, partition, shared, len(s)))
        return found


def _blocks(items: DataFrame, params: Params) -> tuple[int, Iterator[list[tuple]]]:
    """How many bounded blocks the distinct items make, and the blocks, on the driver one at a time."""
    d = items.select("item_id", "text").where("text is not null").distinct()
    size = d.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint") + 64), F.lit(0))).first()[0]
    n = int(size // params.block_bytes) + 1

    def read() -> Iterator[list[tuple]]:
        for i in range(n):
            rows = (d if n == 1 else d.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)).collect()
            yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, () if r[0] is None else (r[0],), r[1]))

    return n, read()


RESULT = "size_partition int, n_shared bigint, n_item bigint, containment double"


def contained_items(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (row of docs(doc_id, text), item) with containment >= threshold."""
    sc = docs.sparkSession.sparkContext
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema["item_id"].dataType)
    n, blocks = _blocks(items, params)
    out = None
    for block in blocks:
        shared = sc.broadcast(block)

        def run(batches, shared=shared):
            index = ItemIndex(shared.value, params)
            for b in batches:
                at, rows = [], []
                for i, text in enumerate(as_texts(b.column("text"))):
                    for r in index.search(text):
                        at.append(i)
                        rows.append(r)
                cols = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], item_arrow)]
                cols += [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[2] / r[3] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "size_partition", "n_shared", "n_item", "containment"])

        part = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {id_type}, item_id {item_type}, {RESULT}")
        if n > 1:
            part = written(part, "contained")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    sc = docs.sparkSession.sparkContext
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    n, blocks = _blocks(items, params)
    before = None
    for block in blocks:
        shared = sc.broadcast(block)

        def run(batches, shared=shared):
            index = ItemIndex(shared.value, params)
            for b in batches:
                yield b.filter(pa.array([not index.search(t) for t in as_texts(b.column("text"))], pa.bool_()))

        docs = map_arrow(docs, run, schema)
        if n > 1:
            docs = written(docs, "decontaminated")
            shared.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs
