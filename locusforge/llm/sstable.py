"""Token ids in sorted-string-table shards.

A shard is a file: data blocks, a sparse index block, a Bloom filter block and a footer, each ended by a newline byte.
(The newline is what Spark's text writer ends a row with. Through it, blocks reach any Hadoop file system under Spark's
commit protocol, so a lost executor leaves no half shard.)

    data block    zstd frame of: entries; entry = shared u8, rest u8, rest bytes of key, count u32, ids count * width
                  (shared: bytes of key in common with the previous entry of the block)
    index block   per data block: last key 8 bytes, offset u64, length u32
    Bloom block   bits; HASHES positions a key
    footer        documents u64, ids u64, index offset u64, index length u64, Bloom offset u64, Bloom length u64,
                  width u32, magic 4 bytes; fixed size, so it is found from the file's end

All numbers are little-endian, but keys: the id as a big-endian signed 64-bit number with the sign bit flipped, so that
byte order is number order. An id occurs as often as its rows do.

Defined cases: a null text is empty and has the end id only; a row with a null id has no key and is left out; rows that
share an id follow each other, ordered by the hash of their text; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pieces
from . import textarrays as ta
from .common import BROADCAST_ROWS, fresh_path
from .memo import Flat, Numbers, once

MAGIC = b"LFS1"
FOOTER = struct.Struct("<QQQQQQI4s")
INDEX = struct.Struct(">QQI")
#: Bytes of ids in a data block, and data blocks in a shard.
BLOCK_BYTES, SHARD_BLOCKS = 1 << 16, 96
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 0
#: Pieces remembered by a worker (some 100 bytes each), and pieces given to the library at once.
MEMORY, TOGETHER = 1_000_000, 1024
#: Two-byte characters that are all letters, by first byte.
LEADS = (*range(0xC3, 0xCB), 0xD0, 0xD1)


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _bloom_spots(keys: np.ndarray, bits: int) -> np.ndarray:
    h = ta.mix(keys)
    step = ta.mix(h) | np.uint64(1)
    return (h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom_holds(bloom: bytes, bits: int, doc_id: int) -> bool:
    spots = _bloom_spots(np.array([doc_id], np.int64).view(np.uint64), bits)[0].tolist()
    return all(bloom[s >> 3] >> (7 - (s & 7)) & 1 for s in map(int, spots))


class ShardWriter:
    """Turns (id, ids) in key order into the shard's blocks, each to be ended by a newline."""

    def __init__(self, width: int):
        self.width, self.pack = width, zstandard.ZstdCompressor(level=1).compress
        self.offset, self.index, self.keys, self.tokens = 0, [], [], 0
        self.entries, self.held, self.last = [], 0, b""

    def _sent(self, block: bytes) -> bytes:
        self.offset += len(block) + 1
        return block

    def add(self, doc_id: int, ids: bytes) -> Iterator[bytes]:
        key, shared = key_of(doc_id), 0
        if self.entries:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        self.entries += [bytes((shared, 8 - shared)), key[shared:], struct.pack("<I", len(ids) // self.width), ids]
        self.keys.append(doc_id)
        self.tokens += len(ids) // self.width
        self.held += len(ids) + 16
        self.last = key
        if self.held >= BLOCK_BYTES:
            yield self.flush()

    def flush(self) -> bytes:
        block = self.pack(b"".join(self.entries))
        self.index.append(INDEX.pack(int.from_bytes(self.last, "big"), self.offset, len(block)))
        self.entries, self.held = [], 0
        return self._sent(block)

    def close(self) -> Iterator[bytes]:
        if self.entries:
            yield self.flush()
        at = self.offset
        index = self._sent(b"".join(self.index))
        yield index
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        bloom[_bloom_spots(np.array(self.keys, np.int64).view(np.uint64), bits).astype(np.int64).ravel()] = True
        packed, where = np.packbits(bloom).tobytes(), self.offset
        packed = struct.pack("<Q", bits) + packed
        yield self._sent(packed)
        yield FOOTER.pack(len(self.keys), self.tokens, at, len(index), where, len(packed), self.width, MAGIC)


class Shard:
    """Reads a shard from its bytes (or anything sliced like bytes, such as a memory map)."""

    def __init__(self, data):
        self.data = data
        self.documents, self.tokens, at, n, where, m, self.width, magic = FOOTER.unpack(data[len(data) - FOOTER.size - 1 : len(data) - 1])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = [INDEX.unpack(data[i : i + INDEX.size]) for i in range(at, at + n, INDEX.size)]
        self.bits = struct.unpack("<Q", data[where : where + 8])[0]
        self.bloom = (where + 8, where + m)

    def block(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        _, at, n = self.index[i]
        raw = zstandard.ZstdDecompressor().decompress(self.data[at : at + n])
        key, i = b"", 0
        while i < len(raw):
            shared, rest = raw[i], raw[i + 1]
            key = key[:shared] + raw[i + 2 : i + 2 + rest]
            i += 2 + rest
            count = int.from_bytes(raw[i : i + 4], "little")
            yield id_of(key), np.frombuffer(raw, f"<u{self.width}", count, i + 4)
            i += 4 + count * self.width

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, doc_id: int) -> bool:
        return bloom_holds(self.data[self.bloom[0] : self.bloom[1]], self.bits, doc_id)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every entry of this key: Bloom filter, then binary search in the index, then one block (more only while the key repeats)."""
        if not self.may_hold(doc_id):
            return []
        found = []
        for i in range(bisect_left(self.index, int.from_bytes(key_of(doc_id), "big"), key=lambda x: x[0]), len(self.index)):
            here = [(k, v) for k, v in self.block(i) if k >= doc_id]
            found += [v for k, v in here if k == doc_id]
            if any(k > doc_id for k, _ in here):
                break
        return found


class ByteBPE:
    """The tokenizers library behind a memory of pieces; a text of uncommon characters or with a very long piece goes to the library whole. Pickles as the file's text; a worker makes it once."""

    def __init__(self, source: str):
        self.source, self.library, self.seen = source, None, None

    def __reduce__(self):
        return once, (ByteBPE, self.source)

    def _ready(self):
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
            self.width = 2 if self.library.get_vocab_size(True) <= 1 << 16 else 4
            self.kind = f"<u{self.width}"
            vocab = self.library.get_vocab(True)
            self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a letter of a byte-level token stands for a byte
            for token, i in vocab.items():
                self.bytes_of[i] = len(token)
        return self.library

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has). The first `spaced` pieces are a space and letters: they end where the next begins, whatever follows, so the library gets them by the thousand as one text, and the lengths of tokens tell them apart again."""
        size = (ends - starts)[:spaced]
        edge = np.concatenate([[0], np.cumsum(size)])
        whole = data[np.repeat(starts[:spaced] - edge[:-1], size) + np.arange(edge[-1])].tobytes()
        cut = [*range(0, spaced, TOGETHER), spaced]
        texts = [whole[edge[i] : edge[j]].decode() for i, j in zip(cut, cut[1:], strict=False)] if spaced else []
        n = len(texts)
        texts += [data[a:b].tobytes().decode() for a, b in zip(starts[spaced:].tolist(), ends[spaced:].tolist(), strict=True)]
        made = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(made) if made else np.zeros(0, self.kind)
        joined = flat[: sum(map(len, made[:n]))]
        last = np.searchsorted(np.cumsum(self.bytes_of[joined]), edge[1:]) + 1
        return flat, np.concatenate([np.diff(last, prepend=0), np.array([len(x) for x in made[n:]], np.int64)])

    def _numbers(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The number in memory of each distinct piece; pieces that aren't wanted get any."""
        if self.seen is None or len(self.seen) > MEMORY:
            self.seen, self.ids = Numbers(), Flat(self.kind)
        at = self.seen.find(keys)
        missing = np.flatnonzero((at < 0) & wanted)
        if len(missing):
            a = starts[missing]
            spaced = (ends[missing] - a > 1) & (data[a] == 0x20) & (pieces.classes(data[np.minimum(a + 1, len(data) - 1)]) == pieces.LETTER)
            missing = np.concatenate([missing[spaced], missing[~spaced]])
            self.ids.extend(*self._encode(data, starts[missing], ends[missing], int(spaced.sum())))
            at[missing] = self.seen.add(keys[missing])
        return np.maximum(at, 0)

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id."""
        library = self._ready()
        data, offs = pieces.raw(column)
        starts, ends = pieces.split_bytes(data, offs)
        first = np.searchsorted(starts, offs)
        odd = pieces.odd_texts(data, offs, LEADS) | pieces.long_texts(first, starts, ends)
        keys, sample, which = pieces.distinct(data, starts, ends)
        common = ~np.repeat(odd, np.diff(first))
        wanted = np.zeros(len(keys), bool)
        wanted[which[common]] = True
        # of pieces that common and odd texts share, the sample may lie in an odd one, whose bytes are the same
        numbers = self._numbers(data, keys, starts[sample], ends[sample], wanted)
        ids, total = self.ids.take(numbers[which[common]])
        place = np.concatenate([[0], np.cumsum(common)])[first]
        for i, (a, b) in enumerate(zip(place[:-1].tolist(), place[1:].tolist(), strict=True)):
            yield np.array(library.encode(column[i].as_py(), add_special_tokens=False).ids, self.kind) if odd[i] else ids[total[a] : total[b]]


def write(docs: DataFrame, tokenizer: ByteBPE, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards in ascending key order. Their names sort in that order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer._ready()
        writer, sent = None, 0
        end = np.array([END_ID], f"<u{tokenizer.width}").tobytes()
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                out = []
                for doc_id, ids in zip(part.column("id").to_pylist(), tokenizer.batch(part.column("text")), strict=True):
                    writer = writer or ShardWriter(tokenizer.width)
                    made = list(writer.add(doc_id, ids.tobytes() + end))
                    sent += len(made)
                    out += made
                    if sent == SHARD_BLOCKS:
                        out += writer.close()
                        writer, sent = None, 0
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
        if writer:
            tail = list(writer.close())
            yield pa.record_batch([pa.array(tail, pa.binary())], ["value"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    # a full shard is SHARD_BLOCKS blocks, index, Bloom filter and footer: the writer begins a new file there
    ordered.mapInArrow(blocks, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", SHARD_BLOCKS + 3).text(f"{path}/shards")
    _directory(docs.sparkSession, path).write.parquet(f"{path}/directory")


def _files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(shard, content) of all shards, or of those named."""
    where = f"{path}/shards" if names is None else [f"{path}/shards/{n}" for n in names]
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select(F.regexp_extract("path", "[^/]*$", 0).alias("shard"), "content")


def _directory(spark: SparkSession, path: str) -> DataFrame:
    """(shard, part, file, lo, hi, documents, tokens, bits, bloom): one row a shard, made from its footer, index and Bloom filter. part and file number the shards in key order."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                s = Shard(content.as_buffer().to_pybytes())
                part, file = (int(x) for x in re.match(r"part-(\d+)-.*?-c(\d+)", name).groups())
                lo, hi = next(s.block(0))[0], id_of(struct.pack(">Q", s.index[-1][0]))
                yield pa.record_batch([[name], [part], [file], [lo], [hi], [s.documents], [s.tokens], [s.bits], pa.array([bytes(s.data[slice(*s.bloom)])], pa.binary())], ["shard", "part", "file", "lo", "hi", "documents", "tokens", "bits", "bloom"])

    return _files(spark, path).mapInArrow(footers, "shard string, part long, file long, lo long, hi long, documents long, tokens long, bits long, bloom binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, local_start, n_tokens, ids_crc32) of every document, read from the files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("shard"), batch.column("content"), strict=True):
                ids, starts, counts, sums, at = [], [], [], [], 0
                for doc_id, tokens in Shard(content.as_buffer().to_pybytes()):
                    ids.append(doc_id)
                    starts.append(at)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    at += len(tokens)
                yield pa.record_batch([pa.array([name.as_py()] * len(ids)), *(pa.array(x, pa.int64()) for x in (ids, starts, counts, sums))], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return _files(spark, path).mapInArrow(parse, "shard string, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents. The directory tells the shards whose key range and Bloom filter admit an id; only those files are read (shards of at most SHARD_BLOCKS blocks), and in them the index and one block."""

    def admits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "lo", "hi", "bits", "bloom")), strict=True)
            yield pa.record_batch([pa.array([n for n, lo, hi, bits, bloom in rows if any(lo <= d <= hi and bloom_holds(bloom, bits, d) for d in doc_ids)], pa.string())], ["shard"])

    if not doc_ids:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    near = spark.read.parquet(f"{path}/directory").filter(F.col("hi") >= min(doc_ids)).filter(F.col("lo") <= max(doc_ids))
    names = [r.shard for r in near.mapInArrow(admits, "shard string").collect()]  # about one an id

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_buffer().to_pybytes())
                got = [(d, v) for d in doc_ids for v in shard.get(d)]
                yield pa.record_batch([pa.array([d for d, _ in got], pa.int64()), pa.array([v.astype(np.int64) for _, v in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, path, names).mapInArrow(find, "doc_id long, ids array<long>") if names else spark.createDataFrame([], "doc_id long, ids array<long>")


def load(path: str) -> ByteBPE:
    with open(path, encoding="utf-8") as f:
        return ByteBPE(f.read())


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in all shards before each. Sums within a part first, so that what is summed in one task has a row a part."""
    shards = spark.read.parquet(f"{path}/directory").select("shard", "part", "file", "tokens")
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    within = shards.withColumn("own", F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens"))
    return within.join(parts, "part").select("shard", (F.col("ahead") + F.col("own")).alias("before"))


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows as the files give them; the files stay in the shared folder, for they are the result."""
    spark = docs.sparkSession
    path = fresh_path(spark, "sstable")
    write(docs, load(tokenizer_path), path)
    rows = read(spark, path).join(F.broadcast(starts(spark, path)) if _small(spark, path) else starts(spark, path), "shard")
    return rows.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _small(spark: SparkSession, path: str) -> bool:
    """Whether the shards' starts may be broadcast: a name and a number each."""
    return spark.read.parquet(f"{path}/directory").count() <= BROADCAST_ROWS // 4
