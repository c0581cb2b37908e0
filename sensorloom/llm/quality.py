"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``measured`` adds the counts of a text, ``judged`` the verdict. Both are narrow: no shuffle, no Python.
A rule compares a ratio of two counts with a limit, for texts of at least ``from_words`` words.

Edge cases: a null or empty text has no words and fails the base rule; ratios with a zero
denominator pass; repeated rows are judged each alike; texts of any length are whole; other columns pass
through whatever their names, and an added column whose name is taken gets an underscore more; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_SEPARATORS, boxed, fresh_names, quoted, unboxed

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "as", "with", "was", "on", "are", "by", "this", "be", "at", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
#: Words of a window for repeats within one text.
REPEAT_WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``count / per`` must lie within [low, high] for texts of ``from_words`` words or more."""

    name: str
    count: str
    per: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("word length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols to words", "n_symbols", "n_words", high=0.1),
    Rule("exclamation and question marks to words", "n_marks", "n_words", high=0.5),
    Rule("stop words to words", "n_stop_words", "n_words", low=0.02, from_words=50),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", high=0.5),
)


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` boxed, with the counts of COUNTS (long)."""
    docs = boxed(docs, text=F.col(quoted(text_col)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = "[^\\x20\\x09-\\x0D]"
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    parts = docs.withColumns({
        "__words": F.array_remove(F.split(text, WORD_SEPARATORS), ""),
        "__lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(worded)),
    })
    k = REPEAT_WINDOW
    words = F.col("__words")
    starts = F.sequence(F.lit(0), F.size(words) - k)
    hashed = parts.withColumn(
        "__windows",
        F.when(F.size(words) >= k, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>")),
    )
    windows = F.col("__windows")
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("__sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed))
    pairs = F.col("__sorted")
    # a window found twice or more stands beside its equal after sorting by hash
    found = F.array_sort(F.transform(
        F.filter(pairs, lambda p, i: (F.get(pairs, i + 1)["h"] == p["h"]) | ((i > 0) & (F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"] == p["h"]))),
        lambda p: p["i"],
    ))
    placed_only = sorted_.withColumn("__found", found)
    at = F.col("__found")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - p, F.lit(k)))),
        F.lit(0).cast("bigint"),
        lambda a, b: a + b,
    )
    lines = F.col("__lines")
    counts: dict[str, Column] = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.regexp_replace(text, WORD_SEPARATORS, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_marks": F.regexp_count(text, F.lit("[!?]")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # a filter on what a generator gives stays above it: pushed below, it would write the counts out over and over
    return placed_only.select("row", F.inline(F.array(F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]))))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS (long)."""
    names = fresh_names(docs.columns, COUNTS)
    return unboxed(_counted(docs, text_col), docs.columns, *[F.col(n).alias(own) for n, own in names.items()])


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True if all rules hold: the table as one expression."""
    good = F.lit(True)
    for r in rules:
        value, per = F.col(r.count), F.col(r.per)
        if r.low is not None:
            good &= (F.col("n_words") < r.from_words) | (per == 0) | (value >= r.low * per)
        if r.high is not None:
            good &= (F.col("n_words") < r.from_words) | (per == 0) | (value <= r.high * per)
    return good


def judged(docs: DataFrame, text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``docs`` with all counts, base_failed and kept."""
    names = fresh_names(docs.columns, (*COUNTS, "base_failed", "kept"))
    rows = _judged(docs, text_col, rules, min_words, max_repeat_percent)
    return unboxed(rows, docs.columns, *[F.col(n).alias(own) for n, own in names.items()])


def _judged(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return _counted(docs, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that all rules keep, with the columns they had."""
    return unboxed(_judged(docs, text_col).filter("kept"), docs.columns)


def oracle() -> str:
    """The same for DuckDB over ``documents``."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    checks = []
    for r in RULES:
        for limit, sign in ((r.low, ">="), (r.high, "<=")):
            if limit is not None:
                checks.append(f"(n_words < {r.from_words} OR {r.per} = 0 OR {r.count} {sign} CAST({limit} AS DOUBLE) * {r.per})")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + {REPEAT_WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, {REPEAT_WINDOW}) r(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks,
         len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(checks)}) AS kept FROM b
"""
