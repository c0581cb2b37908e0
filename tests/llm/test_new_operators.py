"""Byte-pair merges, phrases and ranked search on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sensorloom.llm import bpe, lexical, phrases

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, n string, `a.b` string"
WORDS = [a + b for a in ("tha", "ber", "lo", "mi", "qu") for b in ("n", "st", "rre", "o")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "", ".", ",")) for _ in range(n))


TEXTS = [
    (5, prose(1, 300), "en"), (3, None, "en"), (4, "", None), (9, prose(2, 80), None), (2, prose(2, 80), None), (8, " \t\n.,;", "en"), (1, "One one ONE é日本 x-1", "en"),
    (6, prose(4, 9000), "en"), (10, "same line here now\n" * 30, "de"), (11, prose(1, 300), "en"), (11, prose(1, 300), "en"), (None, prose(5, 70), "en"),
    (12, "a" * 30_000 + " <|endoftext|> 's \x00\u0085 \U0001f44d", "de"), (13, " ".join(f"w{i} x{i} y{i}" for i in range(40)), "und"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", 0, "i", "r", "n", "ab") for i, t, lang in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# byte-pair encoding


def slow_merges(symbols, merges):
    """The lowest-ranked pair, leftmost first, again and again."""
    symbols = list(symbols)
    while True:
        found = [(merges[pair][0], i) for i, pair in enumerate(a << 32 | b for a, b in zip(symbols, symbols[1:])) if pair in merges]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [merges[symbols[i] << 32 | symbols[i + 1]][1]]


def test_merges_by_queue():
    r = random.Random(2)
    for _ in range(300):
        merges, top = {}, 4
        for rank in range(12):
            pair = r.randrange(top) << 32 | r.randrange(top)
            if pair not in merges:
                merges[pair], top = (rank, top), top + 1
        s = [r.randrange(4) for _ in range(r.randint(0, 40))]
        assert bpe.merged(s, merges) == slow_merges(s, merges)


def test_ids_and_texts_as_the_library():
    library, e, r = Tokenizer.from_file(PATH), bpe.merge_encoder(PATH), random.Random(7)
    parts = ["a", "Bc", "é", "É", "ß", "\n", "\t", " ", "  ", ".", ",", "!", "<|endoftext|>", "'s", "1", "²", "\xa0", "\x1c", "中", "Σ", "_", "\r\n", "\U0001f44d\U0001f3fd"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(2000)] + ["ab" * 20_000, " " * 3000, None]
    texts += ["".join(map(chr, range(a, min(a + 300, 0xD800)))) for a in range(0, 0xD800, 300)]
    got = e.ids_of(pa.array(texts)).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    odd = [[r.randrange(50257) for _ in range(r.randint(0, 9))] for _ in range(2000)] + [None]
    assert e.texts_of(pa.array(odd, pa.list_(pa.int32()))).to_pylist() == [library.decode(x or [], skip_special_tokens=False) for x in odd]
    assert e.ids_of(pa.array([], pa.string())).to_pylist() == [] and len(e.units) <= bpe.UNITS


def test_encode_and_decode(docs, none):
    library = Tokenizer.from_file(PATH)
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in TEXTS)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in rows) == want
    kept = bpe.decode(docs.select("doc_id", "row", "`a.b`", pa_ids()), PATH, "tokens", "out")
    assert kept.columns == ["doc_id", "row", "a.b", "tokens", "out"] and {r["out"] for r in kept.collect()} == {'"#'}
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.decode(docs, PATH, "doc_id", "Text")
    with pytest.raises(ValueError):
        bpe.merge_encoder(public_tokenizers.path("word_bpe_49k.json"))


def pa_ids():
    from pyspark.sql import functions as F

    return F.array(F.lit(1), F.lit(2)).alias("tokens")


# phrases


def brute_phrases(rows, least, top):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(b >= least and 100 * b >= 50 * a for (other, q), b in f.items() if other == lang and len(q) == 3 and p in (q[:2], q[1:])):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, seen, ranked = sorted(out), Counter(), []
    for lang, score, a, p, left, right in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, total[lang], -score))
    return ranked


@pytest.mark.parametrize("least, top, words", [(10, 2000, 1 << 20), (2, 25, 1 << 20), (2, 2000, 50), (1, 2000, 1 << 20)])
def test_phrases(docs, monkeypatch, least, top, words):
    monkeypatch.setattr(phrases, "SLICE_WORDS", words)
    rows = [x for x in TEXTS if x[0] != 6] if least == 1 else TEXTS
    got = phrases.collocations(docs.filter("doc_id is null or doc_id <> 6") if least == 1 else docs, least, top).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, least, top)) and got


def test_rare_pairs_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, phrases.collocations(docs, 5).collect()))
    monkeypatch.setattr(phrases, "_likely_pairs", lambda slim, least: np.full(4, 2**64 - 1, np.uint64))  # every pair
    assert sorted(map(tuple, phrases.collocations(docs, 5).collect())) == want


def test_paths_are_whole(docs):
    kept, _ = phrases.counts(docs.filter("doc_id = 13").union(docs.filter("doc_id = 13")), 2)
    rows = phrases.paths(kept.filter("k = 3").select("lang", "phrase", "n"), kept.filter("k = 2").select("lang", "phrase", "n")).collect()
    assert [(" ".join(r["words"]), r["n"], r["first"], r["last"]) for r in rows] == [(TEXTS[-1][1], 2, 2, 2)]


def test_no_phrases(none):
    assert phrases.collocations(none).count() == 0


# ranked search

ITEMS = [(1, "than berst loo loo min"), (2, "than berst loo quo"), (3, None), (4, "é日本 ONE"), (5, "nowhere"), (None, "than berst loo"), (2, "min quo!quo"), (6, " ".join(WORDS) + " x 1")]


def brute_search(rows, items, k):
    terms = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    docs = [(i, Counter(ts), len(ts)) for i, t, _ in rows if (ts := terms(t))]
    total, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c, n in docs:
            m = 75 + (25 * n * total) // length
            score = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("k, slice_docs, block", [(20, 1024, 1 << 20), (2, 3, 1 << 20), (3, 2, 100)])
def test_search(spark, docs, monkeypatch, k, slice_docs, block):
    monkeypatch.setattr(lexical, "SLICE_DOCS", slice_docs)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    items = ITEMS if block > 100 else [x for x in ITEMS if x[0] != 2 or x[1].startswith("than")]
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_search(TEXTS, items, k)))


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_sums_are_shared():
    """Items with much in common take fewer additions than term by term, and every item adds up to its own terms."""
    r = random.Random(4)
    common = [r.sample(range(200), 12) for _ in range(4)]
    items = [{t: r.randint(1, 2) if t >= 100 else 1 for t in [*r.choice(common), *r.choice(common), *r.sample(range(200), 3)]} for _ in range(60)] + [{}]
    sums = lexical.shared_sums(items)
    assert sums.additions() < 0.6 * sum(max(len(x) - 1, 0) for x in items)
    terms = [Counter({int(t): int(q)}) for t, q in zip(sums.terms, sums.repeats)]
    for parts in sums.parts:
        assert all(p < len(terms) for p in parts)
        terms.append(sum((terms[p] for p in parts), Counter()))
    assert [dict(sum((terms[p] for p in last), Counter())) for last in sums.last] == items
