"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's score is a logistic function of its words and their beginnings; a document's score
is the noisy-or of its sentences: 1 - product(1 - score). Only documents have labels, and the fit follows the
document's likelihood through the noisy-or, so that blame settles on the sentences that carry it; the
operator then names them.

The model is fitted on a sample of labelled documents bounded by ``SAMPLE_DOCS`` and ``SAMPLE_BYTES`` per label, drawn by a
seeded hash of the id; a text that no longer fits is passed over, none is cut. Class shares of all labelled rows correct for the drawing. Scoring is a
narrow pass over all documents.

Edge cases: null and empty texts have one empty sentence, scored by the bias alone; documents
without label are scored like others; without labels of both kinds the score is the label's share
(0 without any); of several labels of one id the largest counts, of several texts the smallest (each is scored);
labels without an id aren't learned from; ties go by id; very long texts are whole; other columns aren't read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_slices, materialize, quoted

#: Documents of each label that the model is fitted on, and bytes of their texts, at most.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 32 << 20
#: Bytes of a task's table of known words.
WORD_BYTES = 64 << 20
BUCKETS = 1 << 18
#: Beginnings of words that are features besides the word.
PREFIXES = (4, 5, 6)
#: A feature counts if this many documents of the sample have it.
MIN_DOCS = 6
EPOCHS = 200
RATE = 2.0
#: Penalty on weights, as so many documents' pull.
SPARSE_DOCS = 2.0
SEED = 8
_SENTENCE = re.compile(r"[.!?\n]+")
_TRIM = "\"'()[]{},;:-_*#$%&|<>"


def sentences(text: str | None) -> list[str]:
    """The sentences of a text that hold a word; one empty sentence if none does."""
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()] or [""]


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    import xxhash

    w = word.lower().strip(_TRIM)
    parts = [f"={w}", *[f"{w[:n]}~" for n in PREFIXES if len(w) > n]] if w else []
    return [xxhash.xxh64_intdigest(p) % BUCKETS for p in parts]


@dataclass
class Model:
    """Weights by bucket, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def word_weight(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


def fit(texts: list[str], labels: np.ndarray, importance: np.ndarray) -> Model:
    """The model of largest likelihood with sparse weights, by adaptive gradient steps over the whole sample."""
    number: dict[str, int] = {}  # words of the sample
    sizes, doc_of = array("i"), array("i")
    words = array("i")  # words of all sentences in a row
    for d, text in enumerate(texts):
        for s in sentences(text):
            own = set(s.split())
            words.extend(number.setdefault(w, len(number)) for w in own)
            sizes.append(len(own))
            doc_of.append(d)
    word, size, doc = (np.frombuffer(a, np.int32) if len(a) else np.empty(0, np.int32) for a in (words, sizes, doc_of))
    parts = [features(w) for w in number]
    width = np.array([len(f) for f in parts], np.int64)
    feature = np.array([f for fs in parts for f in fs], np.int32)
    of_word = np.repeat(np.arange(len(parts)), width)
    instance = np.repeat(np.arange(len(size), dtype=np.int32), size)
    n = len(texts)
    docs_with = np.zeros(BUCKETS)
    begin = np.cumsum(width) - width
    ends = np.searchsorted(doc[instance], np.arange(n + 1))
    for d in range(n):
        own = np.unique(word[ends[d] : ends[d + 1]])
        sized = width[own]
        found = np.unique(feature[np.repeat(begin[own] - np.cumsum(sized) + sized, sized) + np.arange(int(sized.sum()))])
        docs_with[found] += 1
    live = docs_with[feature] >= MIN_DOCS
    names, slot = np.unique(feature[live], return_inverse=True)
    of_word = of_word[live]
    w = np.zeros(len(names))
    bias = -8.0
    grown, grown_bias = np.full(len(names), 1e-2), 1e-2
    for _ in range(EPOCHS):
        of_words = np.bincount(of_word, w[slot], len(parts))
        z = np.clip(bias + np.bincount(instance, of_words[word], len(size)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))  # product(1 - p)
        pull = np.where(labels > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) * importance
        slope = pull[doc] * p
        by_word = np.bincount(word, slope[instance], len(parts))
        g = np.bincount(slot, by_word[of_word], len(names)) / n
        grown += g * g
        step = RATE / np.sqrt(grown)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSE_DOCS / n, 0)  # what explains a few documents only goes
        gb = slope.sum() / n
        grown_bias += gb * gb
        bias -= RATE * gb / np.sqrt(grown_bias)
    weights = np.zeros(BUCKETS)
    weights[names] = w
    return Model(weights, float(bias))


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text divides by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on documents whose label is known and that aren't held out."""
    own, label = F.col(quoted(id_col)), F.col(quoted(label_col))
    known = labels.filter(label.isNotNull() & own.isNotNull() & ~held_out(own)).groupBy(own.cast("long").alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(totals.values())
    if len(totals) < 2:
        share = totals.get(1, 0) / max(total, 1)
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    order = F.xxhash64(F.lit(SEED), "k")
    drawn = known.filter("y = 1").orderBy(order, "k").limit(SAMPLE_DOCS).unionByName(known.filter("y = 0").orderBy(order, "k").limit(SAMPLE_DOCS))
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("k"), F.col(quoted(text_col)).cast("string").alias("t"))
    # of several texts of one id the smallest counts; a fixed order makes reruns agree: 2 * SAMPLE_DOCS rows at most
    found = materialize(texts.join(F.broadcast(drawn), "k").groupBy("k", "y").agg(F.min("t").alias("t")), "labelled")
    left, taken = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in found.select("k", "y", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size")).orderBy(order, "k").collect():
        if r["size"] <= left[r["y"]]:
            left[r["y"]] -= r["size"]
            taken.append((r["k"],))
    chosen = docs.sparkSession.createDataFrame(taken, "k long")
    sample = found.join(F.broadcast(chosen), "k").toArrow().sort_by("k")
    y = np.array(sample.column("y").to_pylist(), float)
    seen = {c: max(float((y == c).sum()), 1.0) for c in (0, 1)}
    importance = np.where(y > 0, totals[1] / seen[1], totals[0] / seen[0]) * len(y) / total
    # labels are as dear as each other: the rarer one isn't drowned
    importance = np.sqrt(importance)
    return fit(sample.column("t").to_pylist(), y, importance)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences and the worst sentences (place, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    class Words(dict):
        held = 0  # bytes, about

        def __missing__(self, word: str) -> float:
            if self.held >= WORD_BYTES:
                self.clear()
                self.held = 0
            self.held += 150 + 4 * len(word)
            value = self[word] = shared.value.word_weight(word)
            return value

    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = Words().__getitem__, shared.value.bias
        for part in byte_slices(batches, 1):
            out: list[list] = [[], [], [], []]
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                z = np.array([bias + sum(map(weight, set(s.split()))) for s in sentences(text)])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                score = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
                worst = np.flatnonzero(p >= 0.5)
                for column, value in zip(out, (key, float(score), len(p), [{"sentence": int(i), "score": float(p[i])} for i in worst])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "score", "n_sentences", "offending"])

    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("t"))
    return slim.mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<sentence: int, score: double>>")
