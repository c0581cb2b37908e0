"""Ranked lexical search: each item's best documents, with what items have in common computed once.

1. Items are dealt into blocks of bounded bytes; the rest is per block, so that what tasks are sent stays small. A block's
   plan is a graph of sums. A term with its number of repeats in an item is a symbol; symbols that stand in exactly the
   same items are one. Each item lists its symbols by how many items hold them, and neighbours in that order that
   two or more items share become a new symbol, round by round, until no shared pair is left: sets of terms
   that items share, made of smaller shared sets.
2. One pass over all documents writes what each has of the block's terms, with its length; N, L and the documents of each term are
   counted from that.
3. A second, over these rows, fills the partial sums of the graph for some documents at once, each shared set once, adds up each
   item's last symbols, and keeps the task's best documents of each item. The best of all are ranked by item.

A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); it adds w * ((10^9 * tf) div (1000 * tf + 12 * m)), where m = 75 + (25 * n * N) div L,
n terms being in the document. All but the logarithm is 64-bit integer.

Edge cases: null texts have no terms; a document without terms counts nowhere; documents without an id count, but
aren't returned; rows with one id are documents each; items with one id are one item (null, too); an item without a term, or with no
document over 0, has no row; equal scores go by id, then by nothing that could be told apart; very long texts are whole; other columns aren't read;
empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_slices, materialize, quoted, translated, words_of

#: Bytes of the items of a block, about; a longer item is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of partial sums that a task holds at once.
SUM_BYTES = 32 << 20
#: Documents that a task sums up at once, at most.
SLICE_DOCS = 1024

#: Each ASCII byte as terms see it: letters in lower case, digits, else a space.
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(terms per text, all terms in a row)."""
    return words_of(translated(texts, _TERM_BYTES))


@dataclass
class SharedSums:
    """How items add up: symbol s < len(base) is ``repeats`` times a term; each later one is the sum of two or more before it.

    ``levels`` holds (new symbols, starts in ``parts``, parts) in an order in which parts come first; ``last`` are those of each item.
    """

    terms: np.ndarray
    repeats: np.ndarray
    parts: list[list[int]]
    last: list[list[int]]

    @property
    def size(self) -> int:
        return len(self.terms) + len(self.parts)

    def additions(self) -> int:
        """Sums of two numbers that one document takes."""
        return sum(len(p) - 1 for p in [*self.parts, *self.last] if p)


def shared_sums(items: list[dict[int, int]]) -> SharedSums:
    """The graph for items given as {term: repeats}."""
    symbols: dict[tuple[int, int], int] = {}
    holders: list[list[int]] = []
    for i, terms in enumerate(items):
        for pair in terms.items():
            s = symbols.setdefault(pair, len(symbols))
            if s == len(holders):
                holders.append([])
            holders[s].append(i)
    base, parts = len(symbols), []
    lists: list[list[int]] = [[] for _ in items]
    alike: dict[tuple[int, ...], list[int]] = {}
    for s, held in enumerate(holders):
        alike.setdefault(tuple(held), []).append(s)
    for held, same in alike.items():  # in exactly the same items: one symbol
        if len(same) > 1 and len(held) > 1:
            parts.append(same)
            same = [base + len(parts) - 1]
        for i in held:
            lists[i] += same
    while True:
        common = Counter(s for own in lists for s in own)
        for own in lists:
            own.sort(key=lambda s: (-common[s], s))
        pairs = Counter(p for own in lists for p in zip(own, own[1:]))
        made: dict[tuple[int, int], int] = {}
        merged = []
        for own in lists:
            out, at = [], 0
            while at < len(own):
                here = pairs[own[at], own[at + 1]] if at + 1 < len(own) else 0
                later = pairs[own[at + 1], own[at + 2]] if at + 2 < len(own) else 0
                if here > 1 and here >= later:
                    out.append((own[at], own[at + 1]))
                    at += 2
                else:
                    out.append(own[at])
                    at += 1
            merged.append(out)
        chosen = Counter(x for own in merged for x in own if isinstance(x, tuple))
        for pair, n in chosen.items():
            if n > 1:
                made[pair] = base + len(parts)
                parts.append(list(pair))
        if not made:
            break
        lists = [[s for x in own for s in (([made[x]] if x in made else x) if isinstance(x, tuple) else [x])] for own in merged]
    pairs_of = list(symbols)
    return SharedSums(np.array([t for t, _ in pairs_of], np.int64), np.array([q for _, q in pairs_of], np.int64), parts, lists)


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items (item_id, t) in blocks: of hash buckets, whose sizes reach the driver, as many as fit."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    buckets = max(1, 16 * -(-total // BLOCK_BYTES))
    if total <= BLOCK_BYTES:
        return [items]
    rows = items.withColumn("b", F.pmod(F.xxhash64("item_id"), F.lit(buckets)))
    out, held, room = [], [], BLOCK_BYTES
    for b, size in rows.groupBy("b").agg(F.sum(F.octet_length("t") + 64)).collect():
        if held and size > room:
            out, held, room = [*out, held], [], BLOCK_BYTES
        held, room = [*held, b], room - size
    return [rows.filter(F.col("b").isin(some)).drop("b") for some in [*out, held] if some]


def _matched(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with terms: how often each has those of the vocabulary, by place there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in byte_slices(batches, 1):
            sizes, words = terms_of(part.column(1))
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
            at = np.flatnonzero(place >= 0)
            cell, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * len(known) + place[at], return_counts=True)
            doc, term = np.divmod(cell, max(len(known), 1))
            some = np.flatnonzero(sizes)
            until = np.append(0, np.searchsorted(doc, some, "right")).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(until), pa.array(v.astype(np.int32))) for v in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(sizes[some].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _best(scores: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, ids, scores): the ``k`` best of each item, of entries in any order."""
    order = np.lexsort((ids, -scores, items))
    items, ids, scores = items[order], ids[order], scores[order]
    keep = np.arange(len(items)) - np.searchsorted(items, items) < k
    return items[keep], ids[keep], scores[keep]


def summed(sums: SharedSums, weights: np.ndarray, matched: pa.RecordBatch, total: int, length: int) -> np.ndarray:
    """Scores, items x documents, of some rows of ``_matched``."""
    n, terms, tf = (matched.column(i) for i in (1, 2, 3))
    doc = np.repeat(np.arange(len(n)), pc.list_value_length(terms).to_numpy())
    m = 75 + (25 * n.to_numpy() * total) // length
    term, tf = pc.list_flatten(terms).to_numpy().astype(np.int64), pc.list_flatten(tf).to_numpy().astype(np.int64)
    cells = np.zeros((len(weights), len(n)), np.int64)
    cells[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    values = np.empty((sums.size, len(n)), np.int64)
    values[: len(sums.terms)] = cells[sums.terms] * sums.repeats[:, None]
    for s, parts in enumerate(sums.parts, len(sums.terms)):
        np.sum(values[parts], axis=0, out=values[s])
    out = np.zeros((len(sums.last), len(n)), np.int64)
    for i, parts in enumerate(sums.last):
        if parts:
            np.sum(values[parts], axis=0, out=out[i])
    return out


def _ranked_block(docs: DataFrame, items: DataFrame, k: int, kind: str) -> DataFrame | None:
    """(item_id, doc_id, score): the best of each task for the items of a block."""
    spark = docs.sparkSession
    block = items.toArrow().combine_chunks()
    ids = block.column("item_id").combine_chunks() if block.num_rows else block.column("item_id")
    sizes, words = terms_of(block.column("t").combine_chunks()) if block.num_rows else (np.empty(0, np.int64), pa.array([], pa.string()))
    if not len(words):
        return None
    names = ids.dictionary_encode("encode")
    owner = np.repeat(names.indices.to_numpy(), sizes)
    table = words.dictionary_encode()
    cell, repeats = np.unique(owner.astype(np.int64) * len(table.dictionary) + table.indices.to_numpy(), return_counts=True)
    held: list[dict[int, int]] = [{} for _ in range(len(names.dictionary))]
    for c, q in zip(cell.tolist(), repeats.tolist()):
        held[c // len(table.dictionary)][c % len(table.dictionary)] = q
    sums = shared_sums(held)
    matched = materialize(_matched(docs, table.dictionary), "matched-terms")
    total, length = matched.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return None
    holding = np.zeros(len(table.dictionary), np.int64)
    for t, df in matched.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a row for each term of the block
        holding[t] = df
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((sums, weights, names.dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights, item_ids = shared.value
        step = max(1, min(SLICE_DOCS, SUM_BYTES // (8 * (2 * len(weights) + sums.size + len(sums.last)))))
        best = (np.empty(0, np.int64),) * 3
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                scores = summed(sums, weights, part, total, length)
                least = np.maximum(np.partition(scores, -k, axis=1)[:, -k] if len(part) > k else 1, 1)
                item, doc = np.nonzero(scores >= np.broadcast_to(least, len(scores))[:, None])
                found = item, part.column(0).to_numpy()[doc], scores[item, doc]
                items_, ids_, scores_ = (np.concatenate(x) for x in zip(best, found))
                best = _best(scores_, ids_, items_, k)
        yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(best[0])), pa.array(best[1]), pa.array(best[2])], names=["item_id", "doc_id", "score"])

    return matched.filter("doc_id is not null").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first."""
    kind = items.schema[item_col].dataType.simpleString()
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("t"))
    asked = items.select(F.col(quoted(item_col)).alias("item_id"), F.coalesce(F.col(quoted(item_text_col)).cast("string"), F.lit("")).alias("t"))
    found = [x for block in _blocks(asked) if (x := _ranked_block(slim, block, k, kind)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    """The same for DuckDB over ``documents`` and ``benchmark``."""
    terms = lambda table, key: f"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM {table}"
    return f"""
WITH d AS ({terms("documents", "doc_id")}), q AS ({terms("benchmark", "item_id")}),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
it AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(ts) AS t FROM q) GROUP BY ALL),
m AS (SELECT rid, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, s),
sc AS (SELECT item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM it JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0 AND doc_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
