"""Token-ID output with a static range asymmetric numeral system (rANS).

All blocks share one frequency table (2^20 slots, every id that occurs has one at least). A block holds
whole documents and is coded by itself over interleaved lanes: lane l codes ids l, l + lanes, ..., with
64-bit states that renormalise by 32-bit words. Checkpoints inside a block keep all states and the place
in the words, so that a block can be decoded from several places at once; a CRC ends it.

Block layout, little-endian: magic `FLRA`, u32 version, u32 lanes, u32 documents, u64 ids, u32 crc of the
table, u32 checkpoints, u64 words; i64 doc_id, u8 doc_id-is-null and u32 ids of each document; u32 step,
u64 word and u64 states of each checkpoint; u32 words; u32 crc of all before. Blocks are rows of a Parquet
dataset, which Spark writes and commits in any store: a lost task's rows are written again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, scratch_path, small_batches
from .tokens import ENCODER_WORDS, encoder

MAGIC, VERSION = b"FLRA", 1
HEAD = struct.Struct("<4sIIIQIIQ")
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 1024
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
#: Ids of one output partition, and the most partitions (their id counts are gathered on the driver).
PART_IDS, MOST_PARTS = 4_000_000, 20_000
CHECKPOINT_STEPS = 256


class Table:
    """Static frequencies of ids, scaled to 2^SCALE."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.float64)
        used = np.nonzero(counts)[0]
        if len(used) > 1 << (SCALE - 1):
            raise ValueError("more distinct ids than the table has room for")
        freq = np.zeros(max(len(counts), 1), np.int64)
        if len(used):
            freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (1 << SCALE)).astype(np.int64))
            over = int(freq.sum()) - (1 << SCALE)
            for i in used[np.argsort(-freq[used], kind="stable")]:  # the most frequent take up the rounding
                take = min(over, freq[i] - 1) if over > 0 else over
                freq[i] -= take
                over -= take
                if not over:
                    break
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self.fill = int(np.argmax(freq))


def encode_block(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Table) -> bytes:
    """docs: (doc_id, number of ids) in order."""
    lanes = int(min(LANES, max(1, len(ids))))
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, table.fill, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    thirty_two, scale, room = np.uint64(32), np.uint64(SCALE), np.uint64(31 - SCALE + 32)
    words: list[np.ndarray] = []
    states: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        f = table.freq[grid[t]]
        full = x >= f << room
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> thirty_two, x)
        q = x // f
        x = (q << scale) + (x - q * f) + table.start[grid[t]]
        if t % CHECKPOINT_STEPS == 0:
            states[t] = x
    words.reverse()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    marks = sorted(states)
    out = [HEAD.pack(MAGIC, VERSION, lanes, len(docs), len(ids), table.crc, len(marks), int(before[-1]))]
    out.append(np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes() + np.array([n for _, n in docs], "<u4").tobytes())
    out += [struct.pack("<IQ", t, int(before[t])) + states[t].astype("<u8").tobytes() for t in marks]
    out += [w.tobytes() for w in words]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block read back. `ids(first, last)` decodes from checkpoint `first` up to checkpoint `last`."""

    def __init__(self, data: bytes, table: Table):
        body, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
        if zlib.crc32(body) != crc:
            raise ValueError("block checksum differs")
        magic, version, self.lanes, n_docs, self.n, table_crc, n_marks, n_words = HEAD.unpack_from(body)
        if magic != MAGIC or version != VERSION or table_crc != table.crc:
            raise ValueError("not a block of this format and table")
        self.table, at = table, HEAD.size
        self.doc_ids = np.frombuffer(body, "<i8", n_docs, at)
        self.null = np.frombuffer(body, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(body, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 13 * n_docs
        self.marks = []
        for _ in range(n_marks):
            self.marks.append((*struct.unpack_from("<IQ", body, at), np.frombuffer(body, "<u8", self.lanes, at + 12)))
            at += 12 + 8 * self.lanes
        self.words = np.frombuffer(body, "<u4", n_words, at)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint32)
        steps = -(-self.n // self.lanes)
        stop = steps if last is None or last >= len(self.marks) else self.marks[last][0]
        begin, at, x = self.marks[first]
        out = np.empty((stop - begin, self.lanes), np.uint32)
        mask, thirty_two, scale = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE)
        for t in range(stop - begin):
            slot = x & mask
            s = out[t] = self.table.symbol[slot]
            x = self.table.freq[s] * (x >> scale) + slot - self.table.start[s]
            low = np.nonzero(x < LOW)[0]
            x[low] = (x[low] << thirty_two) | self.words[at : at + len(low)]
            at += len(low)
        return out.reshape(-1)[: max(0, self.n - begin * self.lanes)]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, words: int = ENCODER_WORDS) -> None:
    """Encode every whole text of `docs` (doc_id long, text; others ignored) and write the dataset `path`.

    Subfolders: `blocks` (part, block, start, ids, data) in ascending doc_id order (nulls first; rows of one
    doc_id by a checksum of their ids) and `table` (id, count). Null and empty texts are the end id alone. Ids
    are made once and kept in the shared scratch folder between the counting and the coding pass. A worker
    remembers up to about `words` encoded words (memory against time; the ids are the same).
    """
    spark = docs.sparkSession
    small_batches(spark, 3000)
    kept = scratch_path(spark, "ids")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, words)
        if end_id >= 1 << (8 * enc.dtype.itemsize):
            raise ValueError("end id is too large for the tokenizer's ids")
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids, counts = enc.encode(b.column(1))
            raw, size = ids.tobytes(), enc.dtype.itemsize
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            rows = [raw[size * s : size * e] + end for s, e in zip(at, at[1:], strict=False)]
            yield pa.record_batch([b.column(0), pa.array([zlib.crc32(r) for r in rows], pa.int64()), pa.array(rows, pa.binary()), pa.array([size] * len(rows), pa.int32())], names=["doc_id", "tie", "ids", "size"])

    docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, tie long, ids binary, size int").write.option("compression", "zstd").parquet(kept)
    stored = spark.read.schema("doc_id long, tie long, ids binary, size int").parquet(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for size in (2, 4):
                raw = b"".join(r for r, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if s == size)
                more = np.bincount(np.frombuffer(raw, f"<u{size}"), minlength=len(total))
                more[: len(total)] += total
                total = more
        used = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "count"])

    # at most one row for each id of the vocabulary
    counted = stored.select("ids", "size").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    counted.coalesce(1).write.parquet(f"{path}/table")
    table = read_table(spark, path)
    total = int(spark.read.parquet(f"{path}/table").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    parts = max(1, min(MOST_PARTS, -(-total // PART_IDS)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start, held, docs_held, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            nonlocal block, start, held, docs_held, n
            data = encode_block(np.concatenate(held), docs_held, table)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "block", "start", "ids", "data"])
            block, start, held, docs_held, n = block + 1, start + n, [], [], 0
            return row

        for b in batches:
            for doc_id, raw, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, f"<u{size}")
                held.append(ids)
                docs_held.append((doc_id, len(ids)))
                n += len(ids)
                if n >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    dealt = stored.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "ids", "size").mapInArrow(code, "part int, block int, start long, ids long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    delete(spark, kept)


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["count"]
    return Table(counts)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of a dataset.

    ids_crc32 is of all its ids as little-endian u32; with_ids adds the ids as an array.
    """
    table = read_table(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    before, so_far = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("ids").alias("n")).collect(), key=lambda r: r["part"]):
        before[r["part"]], so_far = so_far, so_far + r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(data, table)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.lengths)
                begins = ends - block.lengths
                columns = [pa.array(block.doc_ids, mask=block.null), pa.array(begins + start + before[part]), pa.array(block.lengths), pa.array([zlib.crc32(ids[s:e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begins, ends[-1:]]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.select("part", "start", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, words: int = ENCODER_WORDS) -> DataFrame:
    """Write `docs` to the shared scratch folder and read the files back."""
    path = scratch_path(docs.sparkSession, "rans")
    write(docs, path, tokenizer, end_id, words)
    return read(docs.sparkSession, path)
