"""MinHash near-dedup with DartMinHash signatures.

A document's shingles (five words) are weighted by how often it has them. Darts are thrown by hash on
the region of each element: a Poisson process over rank, the same for every document that has the
element, whose darts count up to the element's weight. Of the darts of a document each of K
coordinates keeps the earliest. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. The work is about K ln K darts per document besides one per shingle.

Near duplicates are texts with a similarity of ``threshold`` or more; classes are the connected groups.
1. Equal texts are one node. 2. Signatures are cut into bands; nodes of one band value form a bucket.
3. In each bucket every node is compared with one leader (exact similarity of the whole texts), not with
every other. 4. In buckets whose nodes are then in several classes those outside the largest class meet a few
other nodes of that class, as long as classes merge: a node meets few of one class whatever the number of buckets it shares with it. 5. In those still open the nodes outside the largest
class are held, in blocks of bounded bytes, against all nodes of other classes, each pair in one of its buckets
only. So each pair of a bucket is in one class or has been compared: no link is lost, and no bucket emits all of its
pairs. A text moves once per block of the nodes outside, not once per node. Classes are merged by spreading
minima with pointer jumping over Parquet tables, where a round's links are between the classes before it; nodes with many links are joined where their rows are.

Edge cases: a null text counts as empty; texts of one to four words have one shingle, the whole text;
texts without a word are near only to equal texts; a null id is the class id only of a class
that has no other; very long texts are whole; repeated rows are one node; other columns pass through whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, boxed, byte_slices, hash_words, keyed_join, materialize, mix64, quoted, small_side, unboxed, window_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: Rounds of leaders at most, what is open then is compared in blocks; leaders that a node meets of a class from the second round on.
LEADER_ROUNDS, LEADERS = 3, 6
#: Bytes of text of a block in these comparisons.
BLOCK_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    either = float(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs, k) of weighted sets given as rows (document, element, weight > 0).

    Documents without elements get zeros. The weight axis of an element is tiled in units; darts of
    the last unit count where they fall under the weight.
    """
    units = np.ceil(weight).astype(np.int64)
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    limit = np.minimum(1.0, np.repeat(weight, units) - unit)
    owner = np.repeat(doc, units)
    seed = mix64(np.repeat(element, units) + unit.astype(np.uint64) * _GOLDEN)
    mass = np.bincount(doc, weight, n_docs)
    signature = np.zeros((n_docs, k), np.uint64)
    reach = np.zeros(n_docs)
    np.divide(k * (np.log(k) + 3.0), mass, out=reach, where=mass > 0)
    pending = mass > 0
    while pending.any():
        rows = np.flatnonzero(pending[owner])
        rank, limit_of, alive = np.zeros(len(rows)), limit[rows], seed[rows]
        own, throw = owner[rows], 0
        best = np.full(n_docs * k, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(alive):
            throw += 1
            u = mix64(alive + np.uint64(throw * int(_GOLDEN) % (1 << 64)))
            rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            inside = rank <= reach[own]
            rank, limit_of, alive, own, u = rank[inside], limit_of[inside], alive[inside], own[inside], u[inside]
            v = mix64(u ^ _GOLDEN)
            under = (v >> np.uint64(32)).astype(np.float64) * 2.0**-32 < limit_of
            spot = own[under] * k + (v[under] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            np.minimum.at(best, spot, rank[under])
            darts.append((spot, rank[under], u[under]))
        spots, ranks, names = (np.concatenate(c) for c in zip(*darts))
        first = ranks == best[spots]
        signature.reshape(-1)[spots[first]] = names[first]
        done = np.isfinite(best).reshape(n_docs, k).all(axis=1)
        reach = np.where(pending & ~done, reach * 2, reach)  # a coordinate without dart: look further
        pending &= ~done
    return signature


def weighted_shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, element, weight) of all distinct shingles of some texts, by place and element."""
    sizes, words = words_of(texts)
    h = hash_words(words)
    ends = np.cumsum(sizes)
    windows = window_hashes(h, k)
    n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    until = np.cumsum(n)
    element = np.zeros(int(n.sum()), np.uint64)
    for begin, end, low, high in zip((ends - sizes).tolist(), ends.tolist(), (until - n).tolist(), until.tolist()):
        if end - begin >= k:
            element[low:high] = np.sort(windows[begin : end - k + 1])
        elif high > low:  # fewer words than a shingle has: one shingle, the text
            element[low] = window_hashes(h[begin:end], end - begin)[0] ^ np.uint64(end - begin)
    doc = np.repeat(np.arange(len(sizes)), n)
    first = np.flatnonzero(np.append(True, (element[1:] != element[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    return doc[first], element[first], np.diff(np.append(first, len(doc))).astype(float)


def bags_of(texts: pa.Array, k: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted elements, weights) of each text."""
    doc, element, weight = weighted_shingles(texts, k)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    return [(element[a:z], weight[a:z]) for a, z in zip(cut, cut[1:])]


def node_of(text: Column) -> Column:
    """A text's node: equal for equal texts."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def band_values(docs: DataFrame, text_col: str, bands: int, rows: int) -> DataFrame:
    """(node, bucket): the band values of each text that has a word."""
    slim = docs.select(node_of(F.col(quoted(text_col))).alias("node"), F.col(quoted(text_col)).cast("string").alias("t"))
    salts = mix64(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 1, 1 << 20):
            doc, element, weight = weighted_shingles(part.column(1))
            signature = dart_signatures(doc, element, weight, part.num_rows, bands * rows)
            some = np.unique(doc)
            value = np.zeros((len(some), bands), np.uint64)
            cut = signature[some].reshape(len(some), bands, rows)
            for r in range(rows):
                value = mix64(value * _GOLDEN + cut[:, :, r])
            value = mix64(value ^ salts)
            nodes = part.column(0).take(pa.array(np.repeat(some, bands)))
            yield pa.RecordBatch.from_arrays([nodes.cast(pa.binary()), pa.array(value.reshape(-1).view(np.int64))], names=["node", "bucket"])

    return slim.mapInArrow(run, "node binary, bucket long")


def _numbered(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each node, first place of each number)."""
    number = nodes.dictionary_encode().indices.to_numpy()
    return number, np.unique(number, return_index=True)[1]


def compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The classes (ca, cb), each once, of those pairs (a, b, ca, cb) of nodes whose whole texts are similar; ``a`` may be a leader of very many."""
    leaders = materialize(texts.join(pairs.select("a").distinct(), F.col("node") == F.col("a")).select("a", F.col("t").alias("ta")), "leader-texts")
    wide = keyed_join(pairs, leaders, "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 3):
            number, once = _numbered(part.column(0))
            leaders, others = bags_of(part.column(2).take(pa.array(once))), bags_of(part.column(3))
            keep = [similarity(leaders[i], other) >= threshold for i, other in zip(number.tolist(), others)]
            yield part.select([4, 5]).filter(pa.array(keep, pa.bool_()))

    return wide.select("a", "b", "ta", "tb", "ca", "cb").mapInArrow(run, "ca binary, cb binary").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each node of ``links`` (a, b) is connected to."""
    scratch = Scratch(links.sparkSession)
    both = scratch.table(links.union(links.select("b", "a")).distinct(), "links")
    label = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("class")), "labels")
    while True:
        near = keyed_join(both, label.select(F.col("node").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("m"))
        step = scratch.table(label.join(near, label["node"] == near["a"]).select("node", F.least("class", "m").alias("next"), "class"), "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = materialize(keyed_join(step, jump, "next", "left").select("node", F.coalesce("further", "next").alias("class"), F.col("class").alias("old")), "labels")
        if not moved.filter(F.col("class") != F.col("old")).limit(1).count():
            scratch.drop()
            return moved.select("node", "class")
        label = moved.select("node", "class")


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``classes`` (node, class) after ``links`` (ca, cb) between them; a node that isn't in it is a class of its own."""
    joined = connected(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if classes is None:
        return joined
    moved = keyed_join(classes, joined.select(F.col("node").alias("class"), F.col("class").alias("into")), "class", "left")
    own = joined.join(classes, "node", "left_anti")
    return materialize(moved.select("node", F.coalesce("into", "class").alias("class")).union(own.select("node", "class")), "classes")


def _similar_classes(x: pd.DataFrame, y: pd.DataFrame, bucket: int, threshold: float) -> set[tuple[bytes, bytes]]:
    """Different classes (of a, of b) of similar nodes, a of ``x`` and b of ``y``, whose first common bucket this is."""
    place, element, count = weighted_shingles(pa.array(y["t"], pa.string()))
    order = np.argsort(element, kind="stable")
    element, count, place = element[order], count[order], place[order]
    mass = np.bincount(place, count, len(y))
    classes = y["class"].to_numpy()
    # the open buckets of each y before this one, in rows: a pair that shares one of them is compared there
    sizes = np.array([len(b) for b in y["buckets"]])
    held, owner = np.concatenate(y["buckets"].to_list()), np.repeat(np.arange(len(y)), sizes)
    held, owner = held[held < bucket], owner[held < bucket]
    found = set()
    for own, buckets, (e, c) in zip(x["class"], x["buckets"], bags_of(pa.array(x["t"], pa.string()))):
        open_ = classes != own
        open_[owner[np.isin(held, buckets)]] = False
        if not open_.any():
            continue
        low, high = np.searchsorted(element, e), np.searchsorted(element, e, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(place[at], np.minimum(np.repeat(c, n), count[at]), len(y))
        found.update((own, k) for k in classes[open_ & (both >= threshold * (c.sum() + mass - both))])
    return found


def _open_links(open_: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Different classes (ca, cb) of similar nodes of one bucket.

    Nodes outside a bucket's largest class are held against all its nodes, in blocks by bytes; no pair of nodes is a
    row of its own.
    """
    own = open_.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # a node has BANDS buckets at most
    rows = open_.join(texts.select("node", "t"), "node").join(own, "node").withColumn("size", F.octet_length("t"))
    sizes = open_.join(texts.select("node", F.octet_length("t").alias("size")), "node").groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max_by(F.struct("class", "size"), F.struct("n", "class")).alias("top"), F.sum("size").alias("size")).select(
        "bucket", F.col("top.class").alias("largest"), F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("chunks"),
        F.ceil(F.greatest(F.col("size") - F.col("top.size"), F.lit(1)) / BLOCK_BYTES).cast("int").alias("blocks"),
    )
    rows = keyed_join(materialize(rows, "open-texts"), materialize(largest, "largest"), "bucket")
    spot = F.xxhash64("node")
    i, j = F.pmod(spot, F.col("blocks")).cast("int"), F.pmod(spot, F.col("chunks")).cast("int")
    kept = ("class", "t", "buckets")
    as_y = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("outer"), *kept)
    outside = rows.filter(F.col("class") != F.col("largest"))
    as_x = outside.select("bucket", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(True).alias("outer"), *kept)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["outer"]], group[~group["outer"]]
        found = _similar_classes(x, y, int(key[0]), threshold) if len(x) and len(y) else ()
        return pd.DataFrame(list(found), columns=["ca", "cb"])

    links = as_x.unionByName(as_y).groupBy("bucket", "i", "j").applyInPandas(run, "ca binary, cb binary")
    return links.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()


def _leader_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) to compare and their classes (ca, cb): at first each node with its bucket's leader, then those outside the largest class with some of it.

    Of one class a node meets LEADERS, whichever of its buckets they lead, first those that it shares most of these with.
    """
    if not turn:
        lead = materialize(open_.groupBy("bucket").agg(F.min("node").alias("a")), "leaders")
        return keyed_join(open_, lead, "bucket").filter(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"), F.col("a").alias("ca"), F.col("class").alias("cb")).distinct()
    counts = open_.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), *[F.min_by("node", F.xxhash64("node", F.lit(turn), F.lit(i))).alias(f"l{i}") for i in range(LEADERS)])
    top = counts.groupBy("bucket").agg(F.max_by(F.struct("class", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("leads")), F.struct("n", "class")).alias("top"))
    top = materialize(top.select("bucket", F.col("top.class").alias("largest"), F.col("top.leads").alias("leads")), "leaders")
    outside = keyed_join(open_, top, "bucket").filter(F.col("class") != F.col("largest"))
    met = outside.groupBy("node", "class", "largest").agg(F.flatten(F.collect_list("leads")).alias("leads"))  # a node has BANDS buckets at most
    ranked = F.array_sort(F.transform(F.array_distinct("leads"), lambda a: F.struct((-F.size(F.filter("leads", lambda x: x == a))).alias("n"), a.alias("a"))))
    return met.select(F.explode(F.slice(ranked, 1, LEADERS)["a"]).alias("a"), F.col("node").alias("b"), F.col("largest").alias("ca"), F.col("class").alias("cb"))


def near_classes(docs: DataFrame, text_col: str = "text", *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, class) of every node that has a near duplicate with another text; the class is its smallest node."""
    scratch = Scratch(docs.sparkSession)
    values = scratch.table(band_values(docs, text_col, bands, rows).distinct(), "bands")
    shared = values.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = scratch.table(values.join(shared, "bucket").select("bucket", "node"), "members")
    wanted = scratch.table(members.select("node").distinct(), "nodes")
    text = docs.select(node_of(F.col(quoted(text_col))).alias("node"), F.col(quoted(text_col)).cast("string").alias("t"))
    texts = scratch.table(text.join(small_side(wanted), "node").groupBy("node").agg(F.first("t").alias("t")), "texts")
    tried: DataFrame | None = None
    classes: DataFrame | None = None
    turn, last = 0, False
    while True:
        if classes is None:
            open_ = members.withColumn("class", F.col("node"))
        else:
            open_ = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
            open_ = scratch.table(open_.select("bucket", "node", "class"), "members")
            split = scratch.table(open_.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x != y").select("bucket"), "split")
            open_ = keyed_join(open_, split, "bucket")
        open_ = scratch.table(open_.select("bucket", "node", "class"), "open")
        if not open_.limit(1).count():
            break
        if last:
            new = scratch.table(_open_links(open_, texts, threshold), "similar")
        else:
            pairs = _leader_pairs(open_, turn)
            pairs = scratch.table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
            new = scratch.table(compared(pairs, texts, threshold), "similar")
        linked = new.limit(1).count() > 0
        if linked:
            classes = merged(classes, new)
        if last:
            break
        turn += 1
        last = not linked or turn == LEADER_ROUNDS
    result = materialize(members.select("node", F.col("node").alias("class")).limit(0) if classes is None else classes, "near-classes")
    scratch.drop()
    return result


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id) per row of ``docs``: the smallest id among equal and near-duplicate texts."""
    slim = materialize(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), node_of(F.col(quoted(text_col))).alias("node")), "doc-nodes")
    near = near_classes(docs, text_col, **options)
    nodes = slim.groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = materialize(nodes.join(near, "node", "left").select("node", "least", F.coalesce("class", "node").alias("class")), "placed")
    ids = materialize(placed.groupBy("class").agg(F.min("least").alias("class_id")), "class-ids")
    named = materialize(keyed_join(placed, ids, "class").select("node", "class_id"), "named")
    return keyed_join(slim, named, "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the smallest id stays (of repeated rows, one)."""
    near = near_classes(docs, text_col, **options)
    key, node = F.col(quoted(id_col)).cast("long"), node_of(F.col(quoted(text_col)))
    slim = materialize(docs.select(key.alias("k"), node.alias("node")), "doc-nodes")
    nodes = slim.groupBy("node").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    placed = materialize(nodes.join(near, "node", "left").select("node", "k", F.coalesce("class", "node").alias("class")), "placed")
    chosen = placed.groupBy("class").agg(F.min(F.struct(F.col("k").isNull(), "k", "node")).alias("s")).select(F.col("s.k").alias("of_k"), F.col("s.node").alias("of_node"))
    chosen = materialize(chosen, "chosen")
    kept = boxed(docs, k=key, node=node).join(small_side(chosen), F.col("k").eqNullSafe(F.col("of_k")) & (F.col("node") == F.col("of_node"))).select("row", "k", "node")
    twice = slim.groupBy("k", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return unboxed(kept.dropDuplicates(["k", "node"]) if twice else kept, docs.columns)
