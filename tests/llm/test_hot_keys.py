"""Hot groups: keyed joins, crowded minimisers, and line dedup whose sides are shuffled; recall of near-dedup."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import common, dart_minhash, line_templates, super_kmers

from .test_operators import brute_classes, brute_gone, brute_removal, prose


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("nulls", [0, 3, 20000])
def test_keyed_join(spark, monkeypatch, how, nulls):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    keys = [None] * nulls + [-1] * 15000 + [-2] * 5000 + [x % 400 for x in range(8000)]
    random.Random(4).shuffle(keys)
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long").repartition(8)
    one = spark.createDataFrame([(k, f"v{k}") for k in [-1, *range(0, 400, 2)]], "k long, v string")
    rows, one = common.materialize(rows, "rows"), common.materialize(one, "one")
    joined = common.keyed_join(rows, one, "k", how)
    known = {r["k"]: r["v"] for r in one.collect()}
    expected = Counter((k, n, known.get(k)) for n, k in enumerate(keys) if how == "left" or k in known)
    assert Counter((r["k"], r["n"], r["v"]) for r in joined.collect()) == expected
    sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 0.4 * sum(sizes)  # no task has a hot key, nor all nulls


def test_empty_sides(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2)], "k long, n long")
    none = spark.createDataFrame([], "k long, v string")
    assert sorted(tuple(r) for r in common.keyed_join(rows, none, "k", "left").select("n", "v").collect()) == [(1, None), (2, None)]
    assert common.keyed_join(rows.limit(0), none, "k", "left").count() == 0


def crowded_rows():
    """Passages of 70 words in many documents, each time beside other words, with a word changed, or cut short; and one word over and over."""
    r, rows = random.Random(9), []
    passages = [prose(900 + p, 70).split(" ") for p in range(3)]
    for i in range(60):
        words = list(passages[i % 3])
        if i % 4 == 1:
            words[r.randrange(70)] = f"changed{i}"
        if i % 4 == 2:
            words = words[r.randrange(15) : 70 - r.randrange(10)]
        rows.append((r.randrange(50), " ".join([prose(i, r.randrange(1, 30)), *words, prose(i + 100, r.randrange(1, 30))])))
    rows += [(100 + i, "same " * (49 + i) + prose(i, i)) for i in range(5)] + [(None, " ".join(passages[0])), (3, None), (4, "")]
    return rows


@pytest.mark.parametrize("hot", [0, 2, 8, 12])
def test_crowded_minimisers_are_cut(spark, monkeypatch, hot):
    rows = crowded_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met = []
    cut = super_kmers._least_ids
    monkeypatch.setattr(super_kmers, "_least_ids", lambda strings, window, gram, hot: met.append(gram) or cut(strings, window, gram, hot))
    got = sorted((tuple(x) for x in super_kmers.removal(docs, hot=hot).collect()), key=repr)
    assert got == brute_removal(rows)
    assert met[0] == 16 and (hot > 8 or met[:3] == [16, 32, 64])


def test_common_lines_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(i, "\n".join([f"All rights reserved by shop {i} of town", "Read more"][: 2 if i % 10 else 1] + [f"{prose(i, 6)}", f"Page {i}", ""])) for i in range(120)]
    rows += [(None, "Read more"), (200, None), (201, "")]
    docs = spark.createDataFrame([(*x, n) for n, x in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    got = {x["n"]: x["text"] for x in line_templates.drop_recurring(docs).collect()}
    gone = brute_gone(rows)
    assert len(gone) > 200
    for n, (_, text) in enumerate(rows):
        assert got[n] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (n, i) not in gone))


def test_near_dedup_finds_pairs_by_band_of_similarity(spark):
    """Documents whose id 20 divides against all of sf0.01, by exact similarity of every pair that shares a shingle."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in table.collect())
    bags = dart_minhash.bags_of(pa.array([t for _, t in rows], pa.string()))
    total = np.array([w.sum() for _, w in bags])
    doc = np.repeat(np.arange(len(rows)), [len(e) for e, _ in bags])
    element, weight = (np.concatenate(x) for x in zip(*bags))
    order = np.argsort(element, kind="stable")
    element, weight, doc = element[order], weight[order], doc[order]
    group = {r["doc_id"]: r["class_id"] for r in dart_minhash.classified(table).collect()}
    met, joined = Counter(), Counter()
    for q, (k, text) in enumerate(rows):
        if k % 20:
            continue
        own, own_weight = bags[q]
        low, high = np.searchsorted(element, own), np.searchsorted(element, own, "right")
        at = common.spread(low, high - low)
        both = np.bincount(doc[at], np.minimum(weight[at], np.repeat(own_weight, high - low)), len(rows))
        near = both / np.maximum(total + total[q] - both, 1e-300)
        for j in np.flatnonzero((near >= 0.5) & (np.arange(len(rows)) != q)).tolist():
            band = "over" if near[j] >= 0.8 else "under"
            met[band] += 1
            joined[band] += group[k] == group[rows[j][0]]
    assert met["over"] >= 5 and joined["over"] >= 0.9 * met["over"]
    assert joined["under"] <= 0.1 * met["under"]


def test_a_node_meets_few_of_a_class_in_all_its_buckets(spark):
    rows = [(k, f"m{i:02d}".encode(), b"m00") for k in range(10) for i in {0, *range(4 * k, 4 * k + 4)}] + [(k, b"x", b"x") for k in range(10)]
    open_ = spark.createDataFrame(rows, "bucket long, node binary, class binary")
    pairs = dart_minhash._leader_pairs(open_, 1).collect()
    assert len(pairs) == len({bytes(p["a"]) for p in pairs}) == dart_minhash.LEADERS
    assert {bytes(p["b"]) for p in pairs} == {b"x"} and b"m00" in {bytes(p["a"]) for p in pairs}  # m00 shares every bucket


def test_later_links_are_between_classes(spark, monkeypatch):
    given = []
    connect = dart_minhash.connected
    monkeypatch.setattr(dart_minhash, "connected", lambda links: given.append(links.count()) or connect(links))
    r = random.Random(4)
    base = prose(71, 120).split()
    rows = []
    for i in range(80):  # one group, of which leaders reach a part at a time
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(120)] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(x) for x in dart_minhash.classified(d).collect()), key=repr) == brute_classes(rows)
    assert len(given) > 1 and sum(given[1:]) < given[0]
