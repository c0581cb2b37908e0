"""Line dedup by a fixed-depth template tree, in DataFrame functions only.

A line counts with single spaces between its tokens; a token with a digit is the variable ``<*>``. The tree's leaf is
the token count and the ``DEPTH`` leading tokens. A leaf of fewer than ``min_docs`` documents joins the
largest of those that it gives with one leading token made variable, if that has ``min_docs`` documents. Within a leaf a
token stays fixed where a ``TOKEN_SHARE`` of the leaf's lines have it at its place, whatever the size of
the table; the other places are variable: that is the line's template. A template is recurring if ``min_docs``
documents have it, it keeps FIXED_WORDS words, and a ``fixed_share`` of the line's tokens without a digit.
Lines that recur without a variable, in ``exact_docs`` documents, are recurring too, however few tokens they
have. Recurring lines stay in the document with the smallest id that has them and go from all others.

Plan: one narrow pass gives each line's hashes, from which recurring lines and leaves are counted; only their lines
move on, and of these each distinct line once. What all lines of a leaf or a template need comes by
joins that leave the rows of hot keys where they are.

Edge cases: null text has no lines and stays null; lines without a word stay; rows of a null doc_id count
as one document, after all others; repeated rows lose the same lines; very long texts and lines are whole; ties
between leaves go to the earlier place; other columns pass through whatever their names, and an added
column whose name is taken gets an underscore more; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import boxed, fresh_names, keyed_join, materialize, quoted, small_side, unboxed

MIN_DOCS, EXACT_DOCS = 10, 5
MIN_TOKENS = 3
DEPTH = 4
TOKEN_SHARE = 0.25
FIXED_WORDS, FIXED_SHARE = 2, 0.6
_GAP = "[\\x20\\x09\\x0B-\\x0D]+"


def _spaced(line: Column) -> Column:
    """A line with single spaces."""
    # most lines have none of these: plain searches are cheaper than the replacement
    uneven = reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.when(uneven, F.regexp_replace(line, _GAP, " ")).otherwise(line))


def _masked(spaced: Column) -> Column:
    """``<*>`` for each token that holds a digit."""
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(spaced)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, rk, line, spaced, n, lead) of lines with a token; rk tells rows of one id apart."""
    rows = docs.select(
        F.col(quoted(id_col)).cast("long").alias("d"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("rk"),
        F.posexplode(F.split(F.col(quoted(text_col)).cast("string"), "\n")).alias("line", "raw"),
    )
    spaced = rows.select("d", "rk", "line", _spaced(F.col("raw")).alias("spaced")).filter("spaced != ''")
    n = F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1
    return spaced.select("d", "rk", "line", "spaced", n.alias("n"), _masked(F.substring_index("spaced", " ", DEPTH)).alias("lead"))


def _leaf() -> Column:
    return F.when(F.col("n") >= MIN_TOKENS, F.xxhash64("n", "lead"))


def _groups(keys: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, g): the leaf that the lines of each leaf belong to, for those with enough documents."""
    by_doc = materialize(keys.filter("leaf is not null").select("leaf", "d", "wild").distinct(), "leaf-docs")
    leaves = by_doc.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.first("wild").alias("wild"))
    leaves = materialize(leaves, "leaves")
    own = leaves.filter(F.col("n") >= min_docs).select("leaf", F.col("leaf").alias("g"))
    rare = leaves.filter(F.col("n") < min_docs).select("leaf", "n", F.posexplode("wild").alias("at", "w"))
    # documents of a joined leaf are counted only where enough lines could make it one
    likely = rare.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("w")
    rare = materialize(rare.join(likely, "w").select("leaf", "at", "w"), "rare-leaves")
    holders = keyed_join(by_doc, materialize(rare.select("leaf").distinct(), "rare-names"), "leaf").select(F.explode("wild").alias("w"), "d").distinct()
    enough = holders.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    joined = rare.join(materialize(enough, "joined-leaves"), "w").groupBy("leaf").agg(F.max_by("w", F.struct("n", -F.col("at"))).alias("g"))
    return own.unionByName(joined)


def _templates(kinds: DataFrame, fixed_share: float) -> DataFrame:
    """(kind, template) of the lines that keep enough fixed words, from (g, kind, masked, n)."""
    tokens = kinds.select("g", "n", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    support = materialize(tokens.groupBy("g", "at", "token").agg(F.sum("n").alias("n")), "token-counts")
    totals = materialize(support.filter("at = 0").groupBy("g").agg(F.sum("n").alias("total")), "leaf-counts")
    fixed = keyed_join(support, totals, "g").filter((F.col("n") >= TOKEN_SHARE * F.col("total")) & (F.col("token") != "<*>"))
    # 1 / TOKEN_SHARE tokens of a place at most
    patterns = materialize(fixed.groupBy("g").agg(F.collect_list(F.struct("at", "token")).alias("pattern")), "patterns")
    rows = keyed_join(kinds, patterns, "g").withColumn("tokens", F.split("masked", " "))
    kept = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.col("pattern"), F.struct(i.alias("at"), t.alias("token"))), t).otherwise(F.lit("<*>")))
    rows = rows.withColumn("kept", kept)
    words = F.size(F.filter("tokens", lambda t: t != "<*>"))
    stays = F.size(F.filter("kept", lambda t: t != "<*>"))
    return rows.filter((stays >= FIXED_WORDS) & (stays >= fixed_share * words)).select("kind", F.xxhash64("g", "kept").alias("template"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS, fixed_share: float = FIXED_SHARE) -> DataFrame:
    """(d, rk, line): the lines to drop."""
    lines = _lines(docs, id_col, text_col)
    part = F.split("lead", " ")
    wild = [F.xxhash64("n", F.lit(i), *[F.get(part, j) for j in range(DEPTH) if j != i]) for i in range(DEPTH)]
    wild = F.filter(F.array(*[F.when(F.col("n") > i, w) for i, w in enumerate(wild)]), lambda w: w.isNotNull())
    keys = materialize(lines.select("d", F.xxhash64("spaced").alias("h"), _leaf().alias("leaf"), F.when(F.col("n") >= MIN_TOKENS, wild).alias("wild")), "line-keys")
    exact = keys.select("h", "d").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).filter(F.col("n") >= exact_docs)
    exact = materialize(exact.select("h", F.col("first").alias("exact_first")), "exact")
    groups = materialize(_groups(keys, min_docs), "groups")
    mine = lines.select("d", "rk", "line", "spaced", F.xxhash64("spaced").alias("h"), _leaf().alias("leaf"))
    exact = exact.withColumn("is_exact", F.lit(True))
    by_leaf, by_line = small_side(groups), small_side(exact)
    if by_leaf is groups or by_line is exact:  # a shuffle to come: lines are written, so that those of hot keys can stay
        chosen = keyed_join(materialize(keyed_join(materialize(mine, "all-lines"), groups, "leaf", "left"), "grouped-lines"), exact, "h", "left")
    else:
        chosen = mine.join(by_leaf, "leaf", "left").join(by_line, "h", "left")
    chosen = chosen.filter("g is not null or is_exact")
    masked = F.when(F.col("g").isNotNull(), _masked(F.col("spaced")))
    chosen = materialize(chosen.select("d", "rk", "line", "g", masked.alias("masked"), "exact_first").withColumn("kind", F.when(F.col("g").isNotNull(), F.xxhash64("g", "masked"))), "lines")
    held = chosen.filter("g is not null")
    kinds = held.select("g", "kind", "masked", "d").distinct().groupBy("g", "kind", "masked").agg(F.count(F.lit(1)).alias("n"))
    templates = materialize(_templates(materialize(kinds, "line-kinds"), fixed_share), "templates")
    holders = keyed_join(materialize(held.select("kind", "d").distinct(), "kind-docs"), templates, "kind").select("template", "d").distinct()
    recurring = holders.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).filter(F.col("n") >= min_docs)
    gone = materialize(keyed_join(templates, materialize(recurring.select("template", "first"), "recurring"), "template").select("kind", "first"), "gone")
    later = lambda first: F.col(first).isNotNull() & (F.col("d").isNull() | (F.col("d") > F.col(first)))
    return keyed_join(chosen, gone, "kind", "left").filter(later("first") | later("exact_first")).select("d", "rk", "line")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, counts: bool = False, **options) -> DataFrame:
    """``docs`` without recurring lines; with ``counts`` also n_lines and n_dropped (long)."""
    rows = recurring_lines(docs, id_col, text_col, **options)
    gone = materialize(rows.groupBy("d", "rk").agg(F.collect_set("line").alias("gone")), "dropped")
    text = F.col(quoted(text_col)).cast("string")
    keyed = boxed(docs, k=F.col(quoted(id_col)).cast("long"), rk=F.xxhash64(text), text=text).join(
        small_side(gone.withColumnRenamed("rk", "of")), F.col("k").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("of")), "left",
    )
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    names, added = fresh_names(docs.columns, ("n_lines", "n_dropped")), []
    if counts:
        worded = F.size(F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        added = [F.coalesce(F.when(F.col("text").isNotNull(), worded), F.lit(0)).cast("long").alias(names["n_lines"]), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias(names["n_dropped"])]
    return unboxed(keyed, docs.columns, *added, **{text_col: kept})


def oracle() -> str:
    """The same for DuckDB over ``documents``."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), l AS (
  SELECT rid, doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS raw FROM d
), m AS (
  SELECT rid, doc_id, line, raw, trim(regexp_replace(raw, '{_GAP}', ' ', 'g'), ' ') AS spaced FROM l
), k AS (
  SELECT rid, doc_id, line, spaced, string_split(regexp_replace(spaced, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS ts FROM m WHERE spaced <> ''
), t AS (
  SELECT *, concat_ws(' ', len(ts), array_to_string(ts[1:{DEPTH}], ' ')) AS leaf FROM k WHERE len(ts) >= {MIN_TOKENS}
), leaves AS (
  SELECT leaf, any_value(ts[1:{DEPTH}]) AS lead, any_value(len(ts)) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY leaf
), wild AS (
  SELECT leaf, i, concat_ws(' ', n, i, array_to_string(list_transform(lead, lambda x, j: CASE WHEN j = i THEN '<?>' ELSE x END), ' ')) AS w
  FROM (SELECT *, unnest(range(1, least(n, {DEPTH}) + 1)) AS i FROM leaves WHERE docs < {MIN_DOCS})
), joined AS (
  SELECT w, count(DISTINCT doc_id) AS docs FROM wild JOIN t USING (leaf) GROUP BY w HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), groups AS (
  SELECT leaf, leaf AS g FROM leaves WHERE docs >= {MIN_DOCS}
  UNION ALL (SELECT leaf, w FROM wild JOIN joined USING (w) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY docs DESC, i) = 1)
), h AS (
  SELECT rid, doc_id, line, g, array_to_string(ts, ' ') AS masked, ts FROM t JOIN groups USING (leaf)
), kinds AS (
  SELECT g, masked, any_value(ts) AS ts, count(DISTINCT doc_id) AS n FROM h GROUP BY g, masked
), tok AS (
  SELECT g, masked, n, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS pos FROM kinds
), total AS (
  SELECT g, sum(n) AS total FROM kinds GROUP BY g
), fixed AS (
  SELECT g, pos, token FROM tok JOIN total USING (g) WHERE token <> '<*>' GROUP BY g, pos, token, total HAVING sum(n) >= {TOKEN_SHARE} * total
), tpl AS (
  SELECT tok.g, masked, string_agg(coalesce(fixed.token, '<*>'), ' ' ORDER BY tok.pos) AS template
  FROM tok LEFT JOIN fixed ON tok.g = fixed.g AND tok.pos = fixed.pos AND tok.token = fixed.token
  GROUP BY tok.g, masked HAVING count(fixed.token) >= {FIXED_WORDS} AND count(fixed.token) >= {FIXED_SHARE} * count(CASE WHEN tok.token <> '<*>' THEN 1 END)
), rec AS (
  SELECT g, template, min(doc_id) AS first FROM h JOIN tpl USING (g, masked) GROUP BY g, template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), exact AS (
  SELECT spaced, min(doc_id) AS first FROM k GROUP BY spaced HAVING count(DISTINCT doc_id) >= {EXACT_DOCS}
), gone AS (
  SELECT rid, line FROM h JOIN tpl USING (g, masked) JOIN rec USING (g, template) WHERE doc_id > first
  UNION SELECT rid, line FROM k JOIN exact USING (spaced) WHERE doc_id > first
), kept AS (
  SELECT m.rid, string_agg(CASE WHEN gone.line IS NULL THEN m.raw END, chr(10) ORDER BY m.line) AS text,
         count(CASE WHEN regexp_matches(m.raw, '[^\\x20\\x09-\\x0D]') THEN 1 END) AS n_lines, count(gone.line) AS n_dropped
  FROM m LEFT JOIN gone ON m.rid = gone.rid AND m.line = gone.line GROUP BY m.rid
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
