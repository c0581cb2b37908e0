"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever it hits the last residue of the block size, so
piece borders depend on content alone and an edit changes only the pieces it touches. Each piece gives one
of 64 characters; the fingerprint holds the block size, its signature and that of the doubled
block size. The block size is 3 * 2^k, chosen so that the signature has 32 to 64 characters where the
text is long enough. Fingerprints are compared by edit distance of signatures of one block size.

Edge cases: a null text counts as empty, with the fingerprint ``3::``; a null id sorts first; rows of
one id follow each other in order of a hash of their text; one document alone is its own
next; very long texts are whole; other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_slices, materialize, mix64, quoted

ROLL = 7
LENGTH = 64
SMALLEST_BLOCK = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.frombuffer(ALPHABET.encode(), np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n - 1 of the piece hash's base (or of its inverse), modulo 2^64."""
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        factors = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        factors[0] = 1
        _powers[key] = np.cumprod(factors)
    return _powers[key][:n]


def _signature(ends: np.ndarray, n: int, prefix: np.ndarray) -> str:
    """One character per piece; pieces end before ``ends``, the last at n."""
    ends = ends[: LENGTH - 1]
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    begins = np.append(0, ends[:-1])
    piece = (prefix[ends] - prefix[begins]) * _power(n + 1, True)[begins]
    return _CODES[(mix64(piece) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """``block size:signature:signature of the doubled block size``."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    n = len(data)
    if not n:
        return f"{SMALLEST_BLOCK}::"
    padded = np.concatenate((np.zeros(ROLL - 1, np.uint64), data + np.uint64(1)))
    roll = np.zeros(n, np.uint64)
    for i in range(ROLL):
        roll = roll * np.uint64(0x2545F4914F6CDD1D) + padded[i : i + n]
    roll = (mix64(roll) >> np.uint64(32)).astype(np.uint32)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _power(n, False), out=prefix[1:])
    block = SMALLEST_BLOCK
    while block * LENGTH < n:
        block *= 2
    at = np.flatnonzero(roll % np.uint32(SMALLEST_BLOCK) == SMALLEST_BLOCK - 1)
    value = roll[at]

    def ends(size: int) -> np.ndarray:
        return at[value % np.uint32(size) == size - 1] + 1

    while block > SMALLEST_BLOCK and len(ends(block)) < LENGTH // 2:
        block //= 2
    return f"{block}:{_signature(ends(block), n, prefix)}:{_signature(ends(2 * block), n, prefix)}"


def edit_distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """Edit distances of many pairs of strings of 64 characters at most, by bit-parallel steps over all pairs."""
    if not xs:
        return np.empty(0, np.int64)
    x, y = (np.array([s.encode() for s in side], f"S{LENGTH}").view(np.uint8).reshape(-1, LENGTH) for side in (xs, ys))
    m, n = (np.array([len(s) for s in side], np.int64) for side in (xs, ys))
    one = np.uint64(1)
    last = np.where(m > 0, m - 1, 0).astype(np.uint64)
    up, down, score = np.full(len(xs), ~np.uint64(0)), np.zeros(len(xs), np.uint64), m.copy()
    for j in range(int(n.max(initial=0))):
        equal = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).reshape(-1)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(across | up), up & across
        live = j < n
        score += live * (((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64))
        more, less = (more << one) | one, less << one
        up, down = np.where(live, less | ~(vertical | more), up), np.where(live, more & vertical, down)
    return np.where(m == 0, n, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness, 0 to 1, of pairs of fingerprints: 1 if equal, 0 if their block sizes don't meet."""
    out = np.zeros(len(a))
    rows: list[int] = []
    xs: list[str] = []
    ys: list[str] = []
    for i, (p, q) in enumerate(zip(a, b)):
        if p == q:
            out[i] = 1.0
            continue
        (s, s1, s2), (t, t1, t2) = p.split(":"), q.split(":")
        s, t = int(s), int(t)
        for x, y in ((s1, t1), (s2, t2)) if s == t else ((s1, t2),) if s == 2 * t else ((s2, t1),) if t == 2 * s else ():
            rows.append(i)
            xs.append(x)
            ys.append(y)
    distance = edit_distances(xs, ys)
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(xs, ys)], float)
    np.maximum.at(out, np.array(rows, np.int64), 1.0 - distance / longest)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first ones of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PAIR = [pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in PAIR_SCHEMA.split(", ")]


def _rows(ids: list, texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own = [p if c == t else fingerprint(c) for c, t, p in zip(changed, texts, prints)]
    columns = (
        ids, [len(t) for t in texts], [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
        prints, own, likeness(prints, own), likeness(prints, next_prints),
    )
    return [pa.array(c, f.type) for c, f in zip(columns, _PAIR)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and its likeness to its edited text and to the next document by id.

    One range shuffle by id; a document's successor is the next row of its partition. The first and last rows of
    partitions are written apart and paired in a table of one row per partition.
    """
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("k"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc()]
    names = [f.name for f in _PAIR] + ["pid", "edge", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: tuple[list, list[str], list[str]] | None = None

        def edge(kind: str, key: int | None, text: str) -> pa.RecordBatch:
            columns = [pa.array([key], pa.int64()), *[pa.nulls(1, f.type) for f in _PAIR[1:]], pa.array([pid], pa.int32()), pa.array([kind]), pa.array([text])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in byte_slices(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            prints = [fingerprint(t) for t in texts]
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts, prints = held[0] + ids, held[1] + texts, held[2] + prints
            n = len(ids) - 1
            columns = _rows(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            yield pa.RecordBatch.from_arrays([*columns, pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
            held = (ids[-1:], texts[-1:], prints[-1:])
        if held is not None:
            yield edge("last", held[0][0], held[1][0])

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            columns = _rows(ids, texts, [fingerprint(t) for t in texts], following, [fingerprint(t) for t in following])
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_PAIR))

    done = materialize(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{PAIR_SCHEMA}, pid int, edge string, t string"), "fingerprints")
    # one row per partition: its first text, the next partition's first text, and the very first
    firsts = done.filter("edge = 'first'").select("pid", "t")
    by_pid = Window.orderBy("pid")
    following = firsts.select("pid", F.coalesce(F.lead("t").over(by_pid), F.first("t").over(by_pid)).alias("following"))
    tails = done.filter("edge = 'last'").select("doc_id", "t", "pid").join(following, "pid").select("doc_id", "t", "following")
    return done.filter("edge is null").select(*[f.name for f in _PAIR]).unionByName(tails.mapInArrow(border, PAIR_SCHEMA))
