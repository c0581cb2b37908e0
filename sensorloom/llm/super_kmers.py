"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash of the
``gram`` consecutive words within it; neighbouring windows mostly share one and travel together,
as one packed string (a super-k-mer), to the minimiser's bucket. Equal windows have equal
minimisers, so a bucket alone tells which documents hold a window.

1. Minimisers per document are counted (slim). Those of one document only need no bucket. The rest
   are sent to the tasks as a bit table of fixed size; a chance hit only costs a needless string.
2. Super-k-mers of repeated minimisers go to their bucket. There windows are sorted, equal ones are
   confirmed word by word, and each gets the smallest document id that has it.
3. Minimisers with more than ``HOT`` super-k-mers (mass copies) would fill one task. Their super-k-mers are first
   merged, equal ones into one that keeps the smallest id. Those of minimisers that still have more are cut again, where
   the minimiser of twice as many words changes, and travel to its bucket, merged and cut further while a bucket
   has too many; the last cut is into single windows, of which equal ones are one. What buckets find goes back from cut
   to cut, and then to the super-k-mers.
4. Words under a window that starts in a smaller document are removed, judged on the input.

Edge cases: null or empty texts have no words; texts shorter than a window lose nothing; a null doc_id
is no document to compare with (its words stay, and remove none); rows of one id don't remove
each other's words; very long texts are whole, in slices of documents; other columns aren't read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, coded, hash_distinct, hash_words, keyed_join, materialize, quoted, small_side, spread, window_hashes, words_of

WINDOW = 50
GRAM = 8
#: Super-k-mers of one minimiser (about 2 MB) beyond which they are merged and cut by longer minimisers.
HOT = 4096
#: Packed strings that Python handles at once.
SLICE_STRINGS = 8000
#: Bits of a table of minimisers: 16 for each, between these bounds.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive entries."""
    step = 1
    while 2 * step <= w:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = w - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def super_kmers(sizes: np.ndarray, words: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, first window, last window, minimiser) of the super-k-mers of documents given as words in a row."""
    ends = np.cumsum(sizes)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(words) < window:
        return none
    low = sliding_min(window_hashes(hash_words(words), gram), window - gram + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= ends[doc])
    if not len(at):
        return none
    new = np.append(True, (doc[at[1:]] != doc[at[:-1]]) | (low[at[1:]] != low[at[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    of = doc[at[first]]
    begin = (ends - sizes)[of]
    return of, at[first] - begin, at[last] - begin, low[at[first]]


def _packed(sizes: np.ndarray, words: pa.Array, of: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> Iterator[bytes]:
    """The words of super-k-mers, joined by single spaces."""
    data = _joined(sizes, words).cast(pa.binary()).to_pylist()
    length = pc.binary_length(words).to_numpy().astype(np.int64)
    until = np.cumsum(length + 1)  # where the word's space ends, in all words joined
    begin = (np.cumsum(sizes) - sizes)[of]
    before = np.append(0, until)
    low, high = before[begin + first] - before[begin], until[begin + last + window - 1] - 1 - before[begin]
    return (data[t][a:z] for t, a, z in zip(of.tolist(), low.tolist(), high.tolist()))


def _digest(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16).digest()


def _joined(sizes: np.ndarray, words: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), words), " ")


def _bit_table(minimisers: DataFrame) -> np.ndarray:
    """Bits of a table in which each minimiser (column m) is set; its size is bounded by MAX_BITS."""
    n = minimisers.count()
    bits = int(min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(n, 1) - 1).bit_length())))
    place = F.col("m").bitwiseAND(bits - 1)
    words = minimisers.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint64)


def _has(table: np.ndarray, m: np.ndarray) -> np.ndarray:
    place = m & np.uint64(len(table) * 64 - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _smallest(strings: pa.Array, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place in it, covered) of all windows of packed strings: covered if a smaller document has an equal one."""
    string, place, least = _least(strings, doc, window)
    return string, place, least < doc[string]


def _least(strings: pa.Array, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place in it, smallest id of a string with an equal window) of all windows of packed strings."""
    sizes, words = words_of(strings)
    ends = np.cumsum(sizes)
    exact, distinct = coded(words)
    h = hash_distinct(distinct)[exact]
    full = window_hashes(h, window)
    string = np.repeat(np.arange(len(strings)), sizes)[: len(full)]
    at = np.flatnonzero(np.arange(len(full)) + window <= ends[string])
    key, string = full[at], string[at]
    order = np.argsort(key, kind="stable")
    # equal hashes are confirmed word by word, by exact numbers of the words
    same = key[order][1:] == key[order][:-1]
    a, b = at[order][1:][same], at[order][:-1][same]
    for k in range(window):
        if (exact[a + k] != exact[b + k]).any():  # two texts with one hash: sort by the words themselves
            classes = exact
            step = 1
            while step < window:
                jump = min(step, window - step)
                pair = classes[: len(classes) - jump] * (int(classes.max()) + 1) + classes[jump:]
                classes = np.unique(pair, return_inverse=True)[1]
                step += jump
            key = classes[at]
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            break
    starts = np.flatnonzero(np.append(True, ~same)) if len(order) else np.empty(0, np.int64)
    owner = doc[string]
    least = np.empty(len(order), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(owner[order], starts), np.diff(np.append(starts, len(order))))
    return string, at - (ends - sizes)[string], least


def _by_bucket(batches: Iterator[pa.RecordBatch], closed: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``closed`` of whole buckets, several at a time; rows come sorted by bucket, their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= SLICE_STRINGS:
            every = pa.Table.from_batches(held)
            key = every.column(0).to_numpy()
            border = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if border:
                yield closed(every.slice(0, border))
                held = every.slice(border).to_batches()
    if held:
        yield closed(pa.Table.from_batches(held))


def covered_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(d, rk, first, last): windows by their start, in runs, whose words a smaller document has too."""
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("d"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("rk"), F.col(quoted(text_col)).cast("string").alias("t")).filter("d is not null")

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 2):
            of, _, _, m = super_kmers(*words_of(part.column(2)), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), part.column(0).take(pa.array(of))], names=["m", "d"])

    counted = slim.mapInArrow(minimisers, "m long, d long").groupBy("m").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.filter("a < z").select("m", "n"), "minimisers")
    table, hot_table = _bit_table(repeated), _bit_table(repeated.filter(F.col("n") > hot))
    shared = docs.sparkSession.sparkContext.broadcast((table, hot_table))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, many = shared.value
        for part in byte_slices(batches, 2):
            sizes, words = words_of(part.column(2))
            of, first, last, m = super_kmers(sizes, words, window, gram)
            chosen = np.flatnonzero(_has(some, m))
            of, first, last, m = of[chosen], first[chosen], last[chosen], m[chosen]
            strings, is_hot = list(_packed(sizes, words, of, first, last, window)), _has(many, m)
            digests = [_digest(x) if h else None for x, h in zip(strings, is_hot.tolist())]
            place = pa.array(of)
            columns = [pa.array(m.view(np.int64)), pa.array(digests, pa.binary()), pa.array(strings, pa.binary()), part.column(0).take(place), part.column(1).take(place), pa.array(first.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["m", "s", "packed", "d", "rk", "first"])

    rows = materialize(slim.mapInArrow(pack, "m long, s binary, packed binary, d long, rk long, first int"), "super-kmers")
    cold = rows.filter("s is null").select("m", "packed", "d", "rk", "first").repartition("m").sortWithinPartitions("m")

    def closed(rows: pa.Table) -> pa.RecordBatch:
        d = rows.column("d").to_numpy()
        string, place, covered = _smallest(rows.column("packed").combine_chunks(), d, window)
        at = np.flatnonzero(covered)
        return _runs(string[at], place[at], d, *(rows.column(c).to_numpy() for c in ("rk", "first")))

    spans = cold.mapInArrow(lambda batches: _by_bucket(batches, closed), SPAN_SCHEMA)
    hot_rows = rows.filter("s is not null").select("m", "s", "packed", "d", "rk", "first")
    return spans.unionByName(_hot_spans(hot_rows, window, gram, hot)) if hot_table.any() else spans


SPAN_SCHEMA = "d long, rk long, first int, last int"


def _runs(string: np.ndarray, place: np.ndarray, doc: np.ndarray, keys: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Covered windows (a string and a place in it, in order) as runs (d, rk, first, last) of their documents."""
    new = np.append(True, (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)) if len(place) else np.empty(0, bool)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(place)) - 1 if len(place) else low
    s = string[low]
    columns = (doc[s], keys[s], (first[s] + place[low]).astype(np.int32), (first[s] + place[high]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "rk", "first", "last"])


def _least_ids(strings: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(s, least): for each distinct string of (key, s, a, packed) the smallest ``a`` of a string with its window, window by window.

    Equal windows have one key. Strings of a key with more than ``hot`` of them are cut where the minimiser of ``gram``
    words changes, from ``window`` words on into single windows; equal cuts are merged, and looked up in turn.
    """
    crowded = materialize(strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key", F.lit(True).alias("crowded")), "hot-keys")
    marked = keyed_join(strings, crowded, "key", "left")

    def closed(rows: pa.Table) -> pa.RecordBatch:
        string, _, least = _least(rows.column("packed").combine_chunks(), rows.column("a").to_numpy(), window)
        ends = np.append(0, np.cumsum(np.bincount(string, minlength=rows.num_rows)))
        return pa.RecordBatch.from_arrays([rows.column("s").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(least))], names=["s", "least"])

    calm = marked.filter("crowded is null").select("key", "s", "a", "packed").repartition("key").sortWithinPartitions("key")
    found = calm.mapInArrow(lambda batches: _by_bucket(batches, closed), "s binary, least array<long>")
    if crowded.isEmpty():
        return found
    single = gram >= window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 2):
            sizes, words = words_of(part.column(2))
            if single:
                n = sizes - window + 1
                of, first = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
                digests = [_digest(x) for x in _packed(sizes, words, of, first, first, window)]
                key, packed = np.zeros(len(of), np.int64), [None] * len(of)
            else:
                of, first, last, key = super_kmers(sizes, words, window, gram)
                packed = list(_packed(sizes, words, of, first, last, window))
                digests = [_digest(x) for x in packed]
            place = pa.array(of)
            columns = [part.column(0).take(place), pa.array(first.astype(np.int32)), part.column(1).take(place), pa.array(digests, pa.binary()), pa.array(key.view(np.int64)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["s", "place", "a", "cut", "key", "packed"])

    cuts = materialize(marked.filter("crowded").select("s", "a", "packed").mapInArrow(cut, "s binary, place int, a long, cut binary, key long, packed binary"), "hot-cuts")
    if single:
        least = cuts.groupBy("cut").agg(F.array(F.min("a")).alias("least"))
    else:
        distinct = cuts.groupBy("cut").agg(F.first("key").alias("key"), F.min("a").alias("a"), F.first("packed").alias("packed"))
        distinct = materialize(distinct.withColumnRenamed("cut", "s"), "hot-strings")
        least = _least_ids(distinct, window, 2 * gram, hot).withColumnRenamed("s", "cut")
    back = keyed_join(cuts.select("s", "place", "cut"), materialize(least, "hot-cut-least"), "cut")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda x: x["least"]))
    return found.unionByName(back.groupBy("s").agg(whole.alias("least")))


def _hot_spans(rows: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(d, rk, first, last) of super-k-mers (m, s, packed, d, rk, first) of hot minimisers; s is the digest of ``packed``.

    No group is held by one task: equal super-k-mers and equal cuts are merged before each shuffle, and what
    they give comes back by joins that leave the rows of hot keys where they are.
    """
    strings = rows.groupBy("s").agg(F.first("m").alias("key"), F.min("d").alias("a"), F.first("packed").alias("packed"))
    per_string = materialize(_least_ids(materialize(strings, "hot-strings"), window, 2 * gram, hot), "hot-least")
    placed = keyed_join(rows.select("s", "d", "rk", "first"), per_string, "s").select("d", "rk", "first", "least")

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, rk, first = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            string, place = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
            at = np.flatnonzero(pc.list_flatten(lists).to_numpy() < d[string])
            yield _runs(string[at], place[at], d, rk, first)

    return placed.mapInArrow(covered, SPAN_SCHEMA)


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single spaces) per row of ``docs``."""
    window = options.get("window", WINDOW)
    spans = covered_windows(docs, id_col, text_col, **options).distinct()
    per_row = materialize(spans.groupBy("d", "rk").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "covered")
    per_row = per_row.select(F.col("d").alias("of_d"), F.col("rk").alias("of_rk"), "runs")
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("d"), F.col(quoted(text_col)).cast("string").alias("t")).withColumn("rk", F.xxhash64("t"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1):
            sizes, words = words_of(part.column(1))
            begin = np.cumsum(sizes) - sizes
            runs = part.column(2)
            n = pc.fill_null(pc.list_value_length(runs), 0).to_numpy().astype(np.int64)
            found = pc.list_flatten(runs)
            base = np.repeat(begin, n)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, base + found.field("first").to_numpy(), 1)
            np.add.at(edge, base + found.field("last").to_numpy() + window, -1)
            left = np.cumsum(edge[:-1]) == 0
            kept_sizes = np.diff(np.append(0, np.cumsum(left))[np.append(begin, len(words))])
            kept = words if left.all() else words.filter(pa.array(left))
            columns = [part.column(0), pa.array(sizes), pa.array(sizes - kept_sizes), _joined(kept_sizes, kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    joined = slim.join(small_side(per_row), (F.col("d") == F.col("of_d")) & (F.col("rk") == F.col("of_rk")), "left").select("d", "t", "runs")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")


def oracle(window: int = WINDOW) -> str:
    """The same for DuckDB over ``documents``."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d)
), least AS (
  SELECT g, min(doc_id) AS first FROM win GROUP BY g
), cov AS (
  SELECT rid, i FROM win JOIN least USING (g) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT rid, i + k AS pos FROM cov, range(0, {window}) r(k)
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
