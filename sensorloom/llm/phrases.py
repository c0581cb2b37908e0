"""Phrase collocations from a weighted graph of overlapping word pairs.

Per language, each place of a text gives one gram: the word there and the two after it, as far as its piece goes. A gram of three words
is an edge from the pair of its first two words to that of its last two; a shorter one says where pieces end. Grams are counted
once; all shorter counts are flows: a pair occurs as often as edges leave it, and once more for each piece that ends with it, and a
word as often as its pairs, and once more for each piece that it ends.

Most edges touch a pair that is too rare for a candidate. So hashes of all pairs are counted before, and those that may be frequent enough
are sent to the tasks as a bit table of fixed size: a gram stops before any other pair, as if its piece ended there. That changes
no count of a frequent phrase; a chance hit only costs a needless edge.

Edges that occur often enough are then compacted. Where all that enters a pair is one edge and all that leaves it is one edge, the
two are one path, and the pair has its weight. Edges find the first edge of their path by doubling their steps, in as many rounds as
the longest path has binary digits, each a join of equal sizes that is written. A path is a string of words with one weight:
pairs within it need no count of their own, and are part of a longer phrase as frequent as they are.

Candidates are the phrases of two and three words with ``least`` occurrences, each with its weakest cut. Products are exact decimals.

Edge cases: null texts are empty; a null language is ``und``; texts without words give nothing; very long texts and words are whole; repeated rows count
each; equal scores go by count, then by phrase; other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_slices, hash_distinct, materialize, mix64, quoted, translated
from .super_kmers import _bit_table as bit_table, _has as has_bit

#: Bytes of text, and words of which grams are counted at once.
SLICE_BYTES, SLICE_WORDS = 8 << 20, 1 << 20
#: Each ASCII byte as pieces see it: A-Z lower-cased, ends of pieces as line ends, tabs as spaces.
_PIECE_BYTES = np.array([b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)], np.uint8)


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(distinct words, codes, pieces) of ``size`` words in a row and the two after them, which begin the next slice."""
    texts = translated(texts, _PIECE_BYTES)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
    data = np.frombuffer(whole.buffers()[2], np.uint8) if len(texts) and whole.buffers()[2] else np.empty(0, np.uint8)
    word = (data != 32) & (data != 10)
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    piece = np.cumsum(data == 10)[begin]
    for at in range(0, len(begin), size):
        here = slice(at, at + size + 2)
        low, sizes = begin[here], end[here] - begin[here]
        offsets = np.append(0, np.cumsum(sizes))
        alone = data[np.repeat(low - offsets[:-1], sizes) + np.arange(offsets[-1])]
        words = pa.Array.from_buffers(pa.string(), len(low), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(alone)]).dictionary_encode()
        yield words.dictionary, words.indices.to_numpy().astype(np.int64), piece[here]


def _pair_hashes(distinct: pa.Array, code: np.ndarray, piece: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with the next one, whether that is in the same piece)."""
    seed = hash_distinct(pa.array([lang]))[0]
    h = hash_distinct(distinct)[code]
    return mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + seed), piece[1:] == piece[:-1]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Some texts of one language, from batches (lang, text)."""
    for part in byte_slices(batches, 1, SLICE_BYTES):
        langs = part.column(0).dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, part.column(1).filter(pc.equal(langs.indices, i))


def _likely_pairs(slim: DataFrame, least: int) -> np.ndarray:
    """A bit table of pairs that may occur ``least`` times: those that do are all in it, others by chance."""
    size = SLICE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            for distinct, code, piece in _slices(texts, size):
                if len(code) > 1:
                    h, same = _pair_hashes(distinct, code[: size + 1], piece[: size + 1], lang)
                    m, n = np.unique(h[same], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n)], names=["m", "n"])

    sums = slim.mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    return bit_table(materialize(sums.filter(F.col("n") >= least).select("m"), "likely-pairs"))


def _grams(slim: DataFrame, likely: np.ndarray) -> DataFrame:
    """(lang, gram, n) summed up by task: at each word, it and the two after it, up to the end of the piece or to a pair that isn't likely."""
    shared, size = slim.sparkSession.sparkContext.broadcast(likely), SLICE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            for distinct, code, piece in _slices(texts, size):
                n, kinds = min(size, len(code)), len(distinct) + 1
                h, same = _pair_hashes(distinct, code, piece, lang)
                pair = np.append(same & has_bit(shared.value, h), [False, False])
                padded = np.append(code + 1, [0, 0])
                second = np.where(pair[:n], padded[1 : n + 1], 0)
                third = np.where(pair[:n] & pair[1 : n + 1], padded[2 : n + 2], 0)
                key, count = np.unique((padded[:n] * kinds + second) * kinds + third, return_counts=True)
                parts = [distinct.take(pa.array(np.where(c > 0, c - 1, 0), mask=c == 0)) for c in (key // (kinds * kinds), key // kinds % kinds, key % kinds)]
                grams = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                for at in range(0, len(grams), 1 << 16):
                    some = grams.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(count[at : at + (1 << 16)])], names=["lang", "gram", "n"])

    return slim.mapInArrow(run, "lang string, gram string, n long")


def _first(phrase: str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _rest(phrase: str, k: int) -> Column:
    """All but the first ``k`` words."""
    return F.substring_index(phrase, " ", -k)


def counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, n) of phrases of one to three words with ``least`` occurrences, (lang, n) of all words)."""
    slim = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text_col)).cast("string").alias("t"))
    edges = _grams(slim, _likely_pairs(slim, least)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    spaces = F.length("gram") - F.length(F.translate("gram", " ", ""))
    node = F.struct(F.least(spaces + 1, F.lit(2)).alias("k"), _first("gram", 2).alias("phrase"))
    edge = F.struct(F.lit(3).alias("k"), F.col("gram").alias("phrase"))
    out = edges.select("lang", "n", F.explode(F.when((spaces == 2) & (F.col("n") >= least), F.array(node, edge)).otherwise(F.array(node))).alias("x"))
    # of pairs all that leaves and all that ends; words here only where no likely pair begins
    flows = materialize(out.groupBy("lang", "x.k", "x.phrase").agg(F.sum("n").alias("n")), "pair-flows")
    words = flows.filter("k < 3").groupBy("lang", _first("phrase", 1).alias("phrase")).agg(F.sum("n").alias("n"))
    words = materialize(words, "word-flows")
    kept = flows.filter((F.col("k") > 1) & (F.col("n") >= least)).unionByName(words.filter(F.col("n") >= least).select("lang", F.lit(1).alias("k"), "phrase", "n"))
    return kept, words.groupBy("lang").agg(F.sum("n").alias("n"))


def paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, words, n, first, last): compacted paths of edges (lang, phrase, n); ``first`` and ``last``: counts of their outer pairs (lang, phrase, n)."""
    source = pairs.select("lang", F.col("phrase").alias("source"), F.col("n").alias("first"))
    target = pairs.select("lang", F.col("phrase").alias("target"), F.col("n").alias("last"))
    rows = edges.select("lang", "phrase", "n", _first("phrase", 2).alias("source"), _rest("phrase", 2).alias("target"))
    rows = rows.join(source, ["lang", "source"]).join(target, ["lang", "target"])
    # numbers that a repeated task would give again
    rows = materialize(materialize(rows, "edges").withColumn("id", F.monotonically_increasing_id()), "numbered-edges")
    into = rows.filter(F.col("n") == F.col("last")).select("lang", F.col("target").alias("source"), F.col("id").alias("to"))
    steps = rows.filter(F.col("n") == F.col("first")).select("lang", "source", "id").join(into, ["lang", "source"]).select("id", "to", F.lit(1).cast("long").alias("steps"))
    steps = materialize(steps, "steps")
    while True:  # ``to`` is ``steps`` edges before; a first edge has none before it
        before = steps.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        steps = materialize(steps.join(before, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")), "steps")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    placed = rows.join(steps.select("id", "to", "steps"), "id", "left").withColumn("head", F.coalesce("to", "id"))
    inner = F.array_sort(F.collect_list(F.struct(F.coalesce("steps", F.lit(0)).alias("steps"), _rest("phrase", 1).alias("word"), "last")))
    grouped = placed.groupBy("lang", "head", "n").agg(inner.alias("inner"), F.max(F.when(F.col("steps").isNull(), F.col("source"))).alias("begin"), F.max(F.when(F.col("steps").isNull(), F.col("first"))).alias("first"))
    words = F.concat(F.split("begin", " "), F.transform("inner", lambda x: x["word"]))
    return grouped.select("lang", words.alias("words"), "n", "first", F.element_at("inner", -1)["last"].alias("last"))


def candidates(kept: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two and three words from their counts, without those that are parts of one half as frequent."""
    pairs, single = kept.filter("k = 2").select("lang", "phrase", "n"), kept.filter("k = 1").select("lang", "phrase", "n")
    path = materialize(paths(kept.filter("k = 3").select("lang", "phrase", "n"), pairs), "paths")
    at = F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i")
    # within a path each pair has the path's weight
    three = path.select("lang", "words", "n", "first", "last", at).select(
        "lang", F.expr("words[i - 1]").alias("w1"), F.expr("words[i]").alias("w2"), F.expr("words[i + 1]").alias("w3"), F.col("n").alias("a"),
        F.when(F.col("i") == 1, F.col("first")).otherwise(F.col("n")).alias("left"), F.when(F.col("i") == F.size("words") - 2, F.col("last")).otherwise(F.col("n")).alias("right"),
    )
    # outer pairs: parts of a longer phrase if one edge has half of them; inner ones always are
    ends = path.select("lang", F.explode(F.array(
        F.struct(F.concat_ws(" ", F.expr("words[0]"), F.expr("words[1]")).alias("phrase"), "n"),
        F.struct(F.concat_ws(" ", F.element_at("words", -2), F.element_at("words", -1)).alias("phrase"), "n"),
    )).alias("x")).select("lang", "x.phrase", "x.n")
    within = path.filter(F.size("words") > 3).select("lang", "n", F.col("words"), F.explode(F.sequence(F.lit(1), F.size("words") - 3)).alias("i"))
    within = within.select("lang", F.concat_ws(" ", F.expr("words[i]"), F.expr("words[i + 1]")).alias("phrase"), "n")
    longest = ends.unionByName(within).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    two = pairs.join(longest, ["lang", "phrase"], "left").filter(100 * F.coalesce("longer", F.lit(0)) < 50 * F.col("n"))
    two = two.select("lang", _first("phrase", 1).alias("w1"), _rest("phrase", 1).alias("w2"), F.lit(None).cast("string").alias("w3"), F.col("n").alias("a"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))
    rows = three.unionByName(two).withColumn("z", F.coalesce("w3", "w2"))
    rows = rows.join(single.select("lang", F.col("phrase").alias("w1"), F.col("n").alias("f1")), ["lang", "w1"])
    rows = rows.join(single.select("lang", F.col("phrase").alias("z"), F.col("n").alias("fz")), ["lang", "z"])
    score = lambda l, r: F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")
    rows = rows.withColumn("one", score("f1", "coalesce(right, fz)")).withColumn("two", F.when(F.col("w3").isNotNull(), score("left", "fz")))
    second = F.coalesce(F.col("two") < F.col("one"), F.lit(False))
    pick = lambda b, a: F.when(second, b).otherwise(a)
    return rows.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick(F.col("left"), F.col("f1")).alias("l"), pick(F.col("fz"), F.coalesce("right", "fz")).alias("r"), pick(F.col("two"), F.col("one")).alias("score"),
    )


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases; l and r: counts of the parts of the weakest cut."""
    kept, totals = counts(docs, least, text_col, lang_col)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = candidates(kept).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, top: int = 2000) -> str:
    """The same for DuckDB over ``documents``."""
    return f"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), w AS (
  SELECT lang, pid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p)
), x AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY pid ORDER BY i)
), f AS (
  SELECT lang, 1 AS k, w AS phrase, count(*) AS a FROM x GROUP BY ALL UNION ALL
  SELECT lang, 2, w || ' ' || w2, count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL
  SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), halves AS (
  SELECT *, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {least})
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, CAST((c.a::HUGEINT * c.a * 1000000) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM halves c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k = 3 AND a >= {least})
  ) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer x ON b.lang = x.lang AND b.phrase = x.phrase WHERE x.a IS NULL OR 100 * x.a < 50 * b.a
)
SELECT kept.lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM kept JOIN n ON kept.lang = n.lang
WINDOW o AS (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= {top}
"""
