"""Token ids in bit-packed files.

Documents are range-partitioned and sorted by doc_id; each partition encodes its texts
and writes them, in order, as segments.  A segment is one self-contained binary record
(a row of the shared folder's Parquet files) with whole documents in it:

    magic "SFTOK1", then little-endian: bits, ids per block, documents, ids (uint32 each),
    end position of each document (uint64 each), byte offset of each block from the first
    one and of their end (uint64 each), then the blocks

Each id takes ``bits`` bits, the fewest that hold the vocabulary's largest id; a block is
a run of them, low bit first, filled up to whole bytes.  Any range of ids is read by
unpacking just the blocks that hold it, all at once with numpy.

Defined cases: a null or empty text is the end id alone; null ids come first; rows that
repeat an id follow each other in order of their texts, null texts first; an empty
table writes no segment and reads back empty.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm import frames, tokens
from simforge.llm.words import slices

END = 0
MAGIC = b"SFTOK1"
#: Ids of a block, and ids after which a segment ends with the document it is in.
BLOCK_IDS, SEGMENT_IDS = 4096, 1 << 18

_SEGMENTS = "shard int, segment int, n_ids long, doc_ids array<long>, record binary"
_DOCS = "shard int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, low bit first, filled up with zeros to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]


def write_record(documents: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One segment of whole documents."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    packed = [pack_ids(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    ends = np.cumsum([len(x) for x in documents], dtype="<u8") if documents else np.zeros(0, "<u8")
    offsets = np.cumsum([0, *map(len, packed)], dtype="<u8")
    return b"".join([MAGIC, struct.pack("<4I", bits, block, len(documents), len(ids)), ends.tobytes(), offsets.tobytes(), *packed])


class Segment:
    """Random access to one record."""

    def __init__(self, record: bytes):
        if record[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        self.bits, self.block, n_docs, self.n_ids = struct.unpack_from("<4I", record, at := len(MAGIC))
        self.ends = np.frombuffer(record, "<u8", n_docs, at := at + 16).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(record, "<u8", n_blocks + 1, at := at + 8 * n_docs).astype(np.int64)
        self.record, self.at = record, at + 8 * (n_blocks + 1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end - 1 of the segment."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        a, b = begin // self.block, -(-end // self.block)
        if self.bits * self.block % 8:  # blocks don't join without gaps
            parts = [unpack_ids(self.record[self.at + self.offsets[i] : self.at + self.offsets[i + 1]], min(self.block, self.n_ids - i * self.block), self.bits) for i in range(a, b)]
            got = np.concatenate(parts)
        else:
            got = unpack_ids(self.record[self.at + self.offsets[a] : self.at + self.offsets[b]], min(b * self.block, self.n_ids) - a * self.block, self.bits)
        return got[begin - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = tokens.encoder(path), TaskContext.get().partitionId()
        bits = bits_for(max(encoder.size, end + 1))
        docs, doc_ids, n, segment = [], [], 0, 0

        def record() -> pa.RecordBatch:
            cols = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([n], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([write_record(docs, bits)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "segment", "n_ids", "doc_ids", "record"])

        for part in (x for batch in batches for x in slices(batch, limit=tokens.SLICE_BYTES)):
            found, at = encoder.encode(part["text"])
            for doc_id, a, b in zip(part["doc_id"].to_pylist(), at[:-1], at[1:]):
                docs.append(np.append(found[a:b], np.uint32(end)))
                doc_ids.append(doc_id)
                n += len(docs[-1])
                if n >= SEGMENT_IDS:
                    yield record()
                    docs, doc_ids, n, segment = [], [], 0, segment + 1
        if docs:
            yield record()

    return run


def write_tokens(docs: DataFrame, target: str, path: str | None = None, end: int = END) -> None:
    """Write the documents' segments, in ascending doc_id order over shards and segments."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(path or tokens.vocabulary_path(), end), _SEGMENTS).write.parquet(target)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, segment, doc_ids, record in zip(*(batch[c] for c in ("shard", "segment", "doc_ids", "record"))):
            found = Segment(record.as_py())
            starts = np.r_[0, found.ends[:-1]]
            ids = found.ids(0, found.n_ids).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, found.ends)]
            n = len(starts)
            cols = [pa.array([shard.as_py()] * n, pa.int32()), pa.array([segment.as_py()] * n, pa.int32()), doc_ids.values, pa.array(starts), pa.array(found.ends - starts), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "segment", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start over all shards, n_tokens and ids_crc32 of each document of the files."""
    files = spark.read.schema(_SEGMENTS).parquet(target)
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    places = sizes.withColumn("before", before).join(shards, "shard").select("shard", "segment", (F.col("before") + F.col("shard_start")).alias("first"))
    found = files.select("shard", "segment", "doc_ids", "record").mapInArrow(_read, _DOCS)
    return found.join(places, ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{frames.shared_dir(spark)}/simforge/tokens-{uuid.uuid4().hex}"
    write_tokens(frames.documents(spark, sf_dir), target)
    return read_tokens(spark, target)
