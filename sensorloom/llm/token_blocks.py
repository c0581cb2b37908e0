"""Token-ID output as patched frame-of-reference blocks.

``write_token_blocks`` tokenizes documents, sorts them by id over range partitions and writes one
dataset whose rows are *segments*: byte strings of this format (little-endian)::

    magic "PFR1" | n_docs u32 | n_ids u64 | n_blocks u32
    block starts u32 x n_blocks          offset of each block from the end of this index
    doc ids i64 x n_docs | null flags u8 x n_docs | ids per document u32 x n_docs
    blocks: minimum u32 | width u8 | n_exceptions u8 | packed 16*width bytes
            | exception positions u8 x n | exception values u32 x n

A block holds 128 ids, each less the block's minimum, packed at the width that fits the 90th
percentile; larger ones are patched from the exception list. A reader of one document decodes
only the blocks that the index gives for it. The dataset's files are Parquet, so any store that
Spark writes to will do, and a lost executor's files are written again by Spark's commit protocol.

Edge cases: a null or empty text has only the end id; a null doc_id sorts first; repeated rows
stay, ordered by a hash of their text; texts of any length are whole, in blocks of one segment; other
columns aren't read, whatever their names; an empty table gives an empty dataset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_slices, quoted, small_side, spread
from .tokenize import binary_rows, encoder

BLOCK = 128
#: Share of a block's values that must fit its packed width.
PERCENTILE = 0.9
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])
SEGMENT_SCHEMA = "shard int, segment int, ids_before long, n_docs int, n_ids long, payload binary"
TOKEN_SCHEMA = "shard int, doc_id long, shard_start long, ids binary"


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _squeeze(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values as rows of 16 * width bytes: the low ``width`` bits of each, in 64-bit words."""
    words = np.zeros((2 * width, len(values)), np.uint64)
    v = values.T.astype(np.uint64) & np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), 16 * width)


def _expand(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_squeeze``."""
    values = np.zeros((BLOCK, len(packed)), np.uint32)
    words = np.ascontiguousarray(packed).view("<u8").T.copy() if width else None
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[word + 1] << np.uint64(64 - shift)
        values[i] = v & mask
    return values.T


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(starts, bytes) of the blocks of a run of ids; the last one is filled up with its own first id."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.empty(0, np.int64), b""
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[(n_blocks - 1) * BLOCK]
    table = padded.reshape(n_blocks, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    at = int(PERCENTILE * BLOCK)
    width = _widths(np.partition(rest, at, axis=1)[:, at])
    over = (rest >> np.minimum(width, 31)[:, None].astype(np.uint32)) > (width >= 32)[:, None]
    n_over = over.sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_over
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = width, n_over
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[starts[rows][:, None] + 6 + np.arange(16 * w)] = _squeeze(rest[rows], int(w))
    row, place = np.nonzero(over)
    patches = starts + 6 + 16 * width
    out[spread(patches, n_over)] = place
    out[spread(patches + n_over, 4 * n_over)] = rest[row, place].astype("<u4").view(np.uint8)
    return starts, out.tobytes()


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks of ``data`` (uint8) that begin at ``starts``, 128 of each."""
    low = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    width, n_over = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    values = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        values[rows] = _expand(data[starts[rows][:, None] + 6 + np.arange(16 * w)], int(w))
    patches = starts + 6 + 16 * width
    place = data[spread(patches, n_over)].astype(np.int64)
    patch = np.ascontiguousarray(data[spread(patches + n_over, 4 * n_over)]).view("<u4")
    values[np.repeat(np.arange(len(starts)), n_over), place] = patch
    return (values + low[:, None]).reshape(-1)


def encode_segment(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = pack_blocks(ids)
    head = np.array([(b"PFR1", len(doc_ids), len(ids), len(starts))], _HEAD)
    keys = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    absent = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    return b"".join((head.tobytes(), starts.astype("<u4").tobytes(), keys.tobytes(), absent.tobytes(), lengths.astype("<u4").tobytes(), blocks))


class Segment:
    """A reader of one segment; blocks are decoded when asked for."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        if head["magic"] != b"PFR1":
            raise ValueError("not a segment of token blocks")
        docs, blocks, at = int(head["docs"]), int(head["blocks"]), _HEAD.itemsize
        self.n_ids = int(head["ids"])
        self.starts = np.frombuffer(data, "<u4", blocks, at)
        keys = np.frombuffer(data, "<i8", docs, at := at + 4 * blocks)
        absent = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
        self.lengths = np.frombuffer(data, "<u4", docs, at := at + docs).astype(np.int64)
        self.doc_ids = pa.array(keys, mask=absent.astype(bool))
        self.first = np.append(0, np.cumsum(self.lengths))
        self.body = np.frombuffer(data, np.uint8)[at + 4 * docs :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment, from the blocks that hold them."""
        low, high = start // BLOCK, -(-stop // BLOCK)
        return unpack_blocks(self.body, self.starts[low:high].astype(np.int64))[start - low * BLOCK : stop - low * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Tokenize whole texts, append ``end_id`` to each and write the segments to ``path`` in order of id.

    One shuffle: a range partitioning of the texts by id (then a hash of the text, so that one
    id with many rows doesn't fill one task).
    """
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = before = number = 0

        def closed() -> pa.RecordBatch:
            length, ids = np.concatenate(sizes), np.concatenate(parts)
            data = encode_segment(pa.concat_arrays(keys), length, ids)
            row = [[shard], [number], [before], [len(length)], [len(ids)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=[x.split()[0] for x in SEGMENT_SCHEMA.split(", ")])

        for part in byte_slices(batches, 1):
            size, ids = encode(part.column(1), end_id)
            until = np.cumsum(size)
            low = 0
            while low < len(size):
                base = int(until[low - 1]) if low else 0
                high = min(len(size), int(np.searchsorted(until - base, SEGMENT_IDS - held)) + 1)  # the document that fills the segment is its last
                keys.append(part.column(0).slice(low, high - low))
                sizes.append(size[low:high])
                parts.append(ids[base : int(until[high - 1])])
                held += len(parts[-1])
                low = high
                if held >= SEGMENT_IDS:
                    yield closed()
                    before, number, held = before + held, number + 1, 0
                    keys, sizes, parts = [], [], []
        if keys:
            yield closed()

    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("k"), F.col(quoted(text_col)).cast("string").alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc()]
    slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def read_token_blocks(segments: DataFrame) -> DataFrame:
    """(shard, doc_id, shard_start, ids) of every document: ids as little-endian uint32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row["payload"])
                whole, n = s.ids(0, s.n_ids).astype("<u4"), len(s.doc_ids)
                columns = [pa.array(np.full(n, row["shard"], np.int32)), s.doc_ids, pa.array(row["ids_before"] + s.first[:-1]), binary_rows(s.lengths, whole)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "shard_start", "ids"])

    return segments.select("shard", "ids_before", "payload").mapInArrow(run, TOKEN_SCHEMA)


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, ids of all shards before it); one row per written partition."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_before"))


def token_index(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the whole dataset, ``start`` counting the ids of all documents before."""
    tokens = read_token_blocks(segments).join(small_side(shard_starts(segments)), "shard")
    return tokens.select("doc_id", (F.col("shard_start") + F.col("shard_before")).alias("start"), "ids")
