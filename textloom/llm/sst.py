"""Sorted-string-table shards of token ids.

File format (integers little-endian):

    data blocks   entries: shared key bytes u8, other key bytes u8, value bytes u32, key rest, value
    index block   per data block: first key (u8 length, bytes), offset u64, length u32, crc32 u32
    filter block  u32 bits, u8 hash functions, bit array (Bloom filter over the document keys)
    footer        index offset u64, filter offset u64, entries u64, tokens u64, id width u8, version u8, magic 8 bytes

Keys are 13 bytes in byte order: a null mark, the doc_id with its sign bit
flipped (big-endian), and a sequence number for repeated ids. The first key of a block is
whole, the others give the number of bytes shared with their predecessor. A value
is the document's first position in its shard (u64) and its ids, in 2 bytes each
if the vocabulary allows, else 4.

Documents are range-partitioned by (doc_id, hash of the text), so copies of one
id spread over shards; each task writes one file under a temporary name and
renames it, so a lost executor's task is just run again. Positions over all documents
come from a running sum over the shard manifest, one row per shard.

Edge cases. Null or empty text is the end id alone. A null doc_id sorts first.
Rows that repeat an id are entries of their own, in (text hash, text) order. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import BROADCAST_ROWS, as_texts, fresh_path, input_bytes, map_arrow
from ._tokenize import word_bpe

MAGIC = b"TLSST\x00\x00\x01"
_FOOTER = struct.Struct("<QQQQBB8s")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<QII")


def document_key(doc_id: int | None, sequence: int) -> bytes:
    if doc_id is None:
        return b"\x00" * 9 + struct.pack(">I", sequence)
    return b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1)) + struct.pack(">I", sequence)


def key_document(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom_positions(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Builds one shard in memory from entries in key order."""

    def __init__(self, block_bytes: int = 64 * 1024, width: int = 2, bits_per_key: int = 10):
        self.block_bytes, self.width, self.bits_per_key = block_bytes, width, bits_per_key
        self.out, self.at = [], 0
        self.block: list[bytes] = []
        self.block_size, self.first, self.last = 0, b"", b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.last and key <= self.last:
            raise ValueError("keys must ascend")
        if self.width == 2 and len(ids) and np.frombuffer(ids, "<u4").max() > 0xFFFF:
            raise ValueError("an id over 65535 needs a width of 4")
        value = struct.pack("<Q", self.tokens) + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids)
        shared = 0
        if self.block:
            while key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        if not self.keys or self.keys[-1] != key[:9]:
            self.keys.append(key[:9])
        self.tokens += len(ids) // 4
        self.entries = getattr(self, "entries", 0) + 1
        if self.block_size >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.index.append(struct.pack("<B", len(self.first)) + self.first + _INDEX.pack(self.at, len(data), zlib.crc32(data)))
            self.out.append(data)
            self.at += len(data)
            self.block, self.block_size = [], 0

    def finish(self) -> bytes:
        self._end_block()
        index_at = self.at
        index = b"".join(self.index)
        bits, hashes = max(64, len(self.keys) * self.bits_per_key), 7
        bitmap = np.zeros(bits, np.uint8)
        for k in self.keys:
            bitmap[_bloom_positions(k, bits, hashes)] = 1
        bloom = struct.pack("<IB", bits, hashes) + np.packbits(bitmap, bitorder="little").tobytes()
        footer = _FOOTER.pack(index_at, index_at + len(index), getattr(self, "entries", 0), self.tokens, self.width, 1, MAGIC)
        return b"".join([*self.out, index, bloom, footer])


class Reader:
    """Looks documents up in a shard: Bloom filter, then binary search in the sparse index, then one block.

    The shard is given whole, or as read(offset, length) with its size: then the footer, the index, the filter and
    single blocks are all that is read.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes], size: int | None = None):
        self.read = (lambda at, n: data[at : at + n]) if isinstance(data, bytes) else data
        size = len(data) if size is None else size
        index_at, bloom_at, self.entries, self.tokens, self.width, version, magic = _FOOTER.unpack(self.read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of this format")
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        tail = self.read(index_at, size - _FOOTER.size - index_at)
        at, bloom = 0, bloom_at - index_at
        while at < bloom:
            n = tail[at]
            self.first.append(tail[at + 1 : at + 1 + n])
            self.blocks.append(_INDEX.unpack_from(tail, at + 1 + n))
            at += 1 + n + _INDEX.size
        self.bits, self.hashes = struct.unpack_from("<IB", tail, bloom)
        self.bitmap = tail[bloom + 5 :]

    def block(self, i: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, first position in the shard, ids as unsigned 32-bit bytes) of one block."""
        at, n, crc = self.blocks[i]
        data = self.read(at, n)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < n:
            shared, rest, size = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            value = data[at : at + size]
            at += size
            ids = value[8:]
            yield key, struct.unpack_from("<Q", value)[0], np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.width == 2 else ids

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bitmap[p >> 3] >> (p & 7) & 1 for p in _bloom_positions(document_key(doc_id, 0)[:9], self.bits, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of a document."""
        if not self.may_hold(doc_id):
            return []
        low, found = document_key(doc_id, 0), []
        for i in range(max(0, bisect_right(self.first, low) - 1), len(self.blocks)):
            if self.first[i][:9] > low[:9]:
                break
            found += [np.frombuffer(ids, "<u4") for key, _, ids in self.block(i) if key[:9] == low[:9]]
        return found


def _put(uri: str, name: str, data: bytes) -> None:
    """Write a file in one step: under a temporary name, then renamed."""
    if "://" not in uri or uri.startswith("file:"):
        path = uri.removeprefix("file://").removeprefix("file:")
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def _opened(uri: str):
    """A file for reads in any order."""
    if "://" not in uri or uri.startswith("file:"):
        return open(uri.removeprefix("file://").removeprefix("file:"), "rb")  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


MANIFEST = "shard int, file string, entries bigint, tokens bigint, bytes bigint, first bigint, last bigint"


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, width: int | None = None, shard_bytes: int = 16 << 20) -> DataFrame:
    """Write docs(doc_id, text) as shards below `path`; returns the manifest, read back from `path`/manifest.

    doc_id is an integer. width: bytes of an id; by default 2 if the vocabulary and end_id allow, else 4.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    if width is None:
        width = 2 if max(word_bpe(tokenizer_path).tok.get_vocab_size() - 1, end_id) <= 0xFFFF else 4
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs.select("doc_id", "text")) // shard_bytes))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    d = d.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").select("doc_id", "text")
    end = array("I", [end_id]).tobytes()
    files = f"{path}/shards"

    def run(batches):
        encoder = word_bpe(tokenizer_path)
        writer = Writer(width=width)
        shard, last, sequence = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), as_texts(b.column("text")), strict=True):
                sequence = sequence + 1 if doc == last else 0
                last = doc
                writer.add(document_key(doc, sequence), encoder.encode(text) + end)
        if writer.keys:
            name, data = f"shard-{shard:08d}.sst", writer.finish()
            _put(files, name, data)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "entries": [writer.entries], "tokens": [writer.tokens], "bytes": [len(data)], "first": [key_document(writer.keys[0])], "last": [key_document(writer.keys[-1])]}, pa.schema([("shard", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("entries", "tokens", "bytes", "first", "last"))]))

    map_arrow(d, run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row per entry of the shards below `path`: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # one row per shard, however many documents it holds
    base = manifest.select("file", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    if not manifest.take(1):
        return spark.createDataFrame([], f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    content = spark.read.format("binaryFile").load(f"{path}/shards").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(key_document(k), at, len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None) for k, at, ids in Reader(data)]
                cols = [pa.array([name] * len(rows), pa.string())] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                names = ["file", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = map_arrow(content, run, "file string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    joined = rows.join(base, "file")
    return joined.select(F.col("doc_id").cast(id_type).alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """ids(doc_id) -> doc_id, ids (array<bigint>) of each entry of the distinct ids found in the shards below `path`.

    An id goes to the shards whose range in the manifest holds it (a null id to those that begin with one); there the
    footer, index and filter are read once, and of the data only the blocks that the filter and the index leave.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "bytes", "first", "last")
    wanted = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    inside = (F.col("doc_id").isNull() & F.col("first").isNull()) | ((F.col("doc_id") >= F.coalesce("first", F.lit(-(1 << 63)))) & (F.col("doc_id") <= F.col("last")))
    # the manifest is a row per shard; it is what grows slowest here
    placed = wanted.join(F.broadcast(manifest) if manifest.count() <= BROADCAST_ROWS // 10 else manifest, inside).repartition("file").sortWithinPartitions("file", "doc_id")

    def run(batches):
        name, reader, file = None, None, None
        for b in batches:
            docs, rows = [], []
            for shard, size, doc in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "doc_id")), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, _opened(f"{path}/shards/{shard}")

                    def read(at: int, n: int, file=file) -> bytes:
                        file.seek(at)
                        return file.read(n)

                    reader = Reader(read, size)
                for found in reader.get(doc):
                    docs.append(doc)
                    rows.append(found.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_arrow(placed.select("file", "bytes", "doc_id"), run, "doc_id bigint, ids array<bigint>")


def token_table(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Write the shards and read them back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "sst")
    write_shards(docs, path, tokenizer_path, end_id)
    return read_shards(spark, path, docs.schema["doc_id"].dataType.simpleString(), with_ids)
