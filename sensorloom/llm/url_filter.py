"""URL filters: rules by host and path, then naive Bayes over the words of host and path.

A host's names are written together, so they are first cut into words: Viterbi over a unigram model that
counts all words of all pages. A word costs its share of all words; one that no page has, or a short one with less than
SHORT_SHARE of them, costs UNKNOWN / 10^(letters / 2), so that unknown names stay whole, and hosts are cut alike on tables of any size.

Multinomial naive Bayes then scores host words and path tokens. Seeds tell its classes: a page is one to block if its host has
an unwanted word, or if UNWANTED_SHARE of its visible words or more are unwanted ones. A seed can't vouch for itself: for each seed of
a host its pages are learned from without that word, so what the model knows are the words around seeds. Other pages are ones to allow, but for those
that a rule blocks, which say nothing about other hosts. All pages are counted.

Models are tables, without a bound on words or tokens: each distinct name, host and path form is looked up once, by
joins that leave the rows of hot keys where they are. Rules are column expressions; of those that fit,
the longest decides and the model isn't asked.

Edge cases: a null url, or one without ``://``, has an empty host and path: without a rule the model's share of
blocked pages alone decides; null html has no words; ties (a score of 0) allow; very long urls and pages are whole; repeated rows
are counted and judged each; other columns aren't read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_join, materialize, quoted

# Words that stand for unwanted pages.
UNWANTED_WORDS = (
    "ads", "adult", "advert", "adverts", "banner", "bet", "bets", "betting", "bingo", "casino", "casinos", "cheap", "dating", "escort", "free", "gamble", "gambling",
    "jackpot", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pill", "pills", "poker", "popup", "porn", "replica", "sex", "slots", "spam", "torrent", "tracker",
    "viagra", "warez", "win", "xxx",
)
UNWANTED_SHARE = 0.02
#: Longest word of a host, and longest one that must have a share of all words to be known.
LONGEST, SHORT = 20, 3
SHORT_SHARE = 1e-4
#: Probability of words that aren't known, before that of their letters.
UNKNOWN = 1e-6
#: Added to each token's count, so that a class without it doesn't rule it out.
SMOOTHING = 0.1

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def visible_words(html: Column) -> Column:
    """The words of a page's text, lower case, a to z."""
    text = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<[^>]*>", " "))
    return F.array_remove(F.split(text, "[^a-z]+"), "")


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over the visible text of all pages."""
    words = pages.select(F.explode(visible_words(F.col(quoted(html_col)))).alias("word"))
    return words.filter((F.length("word") >= 2) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def path_tokens(path: Column) -> Column:
    """Path parts as ``/part``, numbers as one token, in order of name."""
    parts = F.array_remove(F.split(F.lower(path), "[^a-z0-9]+"), "")
    return F.array_sort(F.transform(parts, lambda t: F.concat(F.lit("/"), F.regexp_replace(t, "[0-9]+", "0"))))


def prepared(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, tokens, rule, ruled, many): what the model reads of each page; many: of its visible words enough are unwanted."""
    url, words = F.col(quoted(url_col)), visible_words(F.col(quoted(html_col)))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    unwanted = F.size(F.filter("words", lambda w: w.isin(*UNWANTED_WORDS)))
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), words.alias("words"))
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "tokens": path_tokens(F.col("path")), "many": (unwanted > 0) & (unwanted >= UNWANTED_SHARE * F.size("words"))})
    return rows.select("page_id", "host", "path", F.array_join("tokens", " ").alias("form"), "tokens", "rule", "ruled", "many")


def segment(name: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The likeliest words of a name: ``known`` holds log probabilities of (start, letters), ``unknown`` that of any other word, before its letters."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = end - start
            value = best[start] + known.get((start, n), unknown - n * math.log(10) / 2)
            if value > best[end]:
                best[end], back[end] = value, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts, cut by the unigrams (word, n)."""
    total = words.agg(F.sum("n")).first()[0] or 1
    parts = materialize(hosts.select("host", F.posexplode(F.array_remove(F.split("host", "[^a-z0-9]+"), "")).alias("at", "name")), "host-parts")
    names = materialize(parts.select("name").distinct(), "names")
    starts = names.select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("start"))
    every = starts.filter(F.length("name") - F.col("start") >= 2).select(
        "name", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("name") - F.col("start")))).alias("letters"),
    )
    every = every.withColumn("word", F.expr("substring(name, start + 1, letters)"))
    share = F.when(F.length("word") <= SHORT, SHORT_SHARE).otherwise(0.0)
    found = keyed_join(every, words.filter(F.col("n") >= share * total), "word").groupBy("name").agg(F.collect_list(F.struct("start", "letters", "n")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, known in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(segment(name, {(k["start"], k["letters"]): math.log(k["n"] / total) for k in known or ()}, math.log(UNKNOWN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    segmented = materialize(names.join(found, "name", "left").select("name", "known").mapInArrow(cut, "name string, words array<string>"), "segmented")
    ordered = F.array_sort(F.collect_list(F.struct("at", "words")))
    return keyed_join(parts, segmented, "name").groupBy("host").agg(F.flatten(F.transform(ordered, lambda x: x["words"])).alias("words"))


@dataclass
class UrlModel:
    """Words of hosts (host, words), log odds of tokens (token, odds; block against allow), and those of all pages."""

    hosts: DataFrame
    odds: DataFrame
    prior: float


def train(rows: DataFrame, words: DataFrame) -> UrlModel:
    """Count the tokens of all prepared pages by class."""
    cut = host_words(rows.select("host").distinct(), words)
    hosts = materialize(cut.withColumn("seeds", F.size(F.filter(F.array_distinct("words"), lambda w: w.isin(*UNWANTED_WORDS)))), "host-words")
    classed = keyed_join(rows, hosts.select("host", "seeds"), "host", "left").withColumn("bad", (F.coalesce("seeds", F.lit(0)) > 0) | F.col("many"))
    classed = classed.filter(F.col("bad") | F.coalesce(F.col("ruled") != "block", F.lit(True)))
    sums = F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")
    by_host = classed.groupBy("host").agg(*sums)
    # a host's words once for each of its seeds, without that seed
    of_hosts = by_host.join(hosts, "host").select("bad", "good", "seeds", "words", F.posexplode("words").alias("at", "token"))
    masked = F.col("token").isin(*UNWANTED_WORDS) & (F.array_position("words", F.col("token")) == F.col("at") + 1)
    times = F.when(F.col("seeds") > 0, F.col("seeds") - masked.cast("int")).otherwise(1)
    by_form = classed.groupBy("form", "tokens").agg(*sums)
    tokens = of_hosts.select("token", (F.col("bad") * times).alias("bad"), "good").unionByName(by_form.select(F.explode("tokens").alias("token"), "bad", "good"))
    counts = materialize(tokens.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("bad + good > 0"), "token-counts")
    bad, good, kinds = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    pages_bad, pages_good = classed.agg(*[F.coalesce(x, F.lit(0)) for x in sums]).first()
    odds = F.log((F.col("bad") + SMOOTHING) / (bad + SMOOTHING * kinds + 1)) - F.log((F.col("good") + SMOOTHING) / (good + SMOOTHING * kinds + 1))
    return UrlModel(hosts.select("host", "words"), counts.select("token", odds.alias("odds")), math.log(pages_bad + 1) - math.log(pages_good + 1))


def judged(rows: DataFrame, model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score and host words, of prepared pages that the model was trained on."""
    total = F.round(F.sum("odds"), 9).alias("score")  # so that the order of adding up can't decide
    by_host = keyed_join(materialize(model.hosts.select("host", F.explode("words").alias("token")), "host-tokens"), model.odds, "token").groupBy("host").agg(total)
    by_host = materialize(model.hosts.join(by_host, "host", "left").select("host", "words", F.col("score").alias("host_score")), "host-scores")
    forms = materialize(rows.select("form", "tokens").distinct().select("form", F.explode("tokens").alias("token")), "form-tokens")
    by_form = materialize(keyed_join(forms, model.odds, "token").groupBy("form").agg(total.alias("form_score")), "form-scores")
    rows = keyed_join(keyed_join(rows, by_host, "host", "left"), by_form, "form", "left")
    score = F.lit(model.prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("form_score", F.lit(0.0))
    asked = F.when(score > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", asked).alias("verdict"), score.alias("score"), F.coalesce("words", F.array().cast("array<string>")).alias("host_words"))


def filtered(pages: DataFrame, **options) -> DataFrame:
    """All pages judged by rules and by a model of themselves."""
    html_col = options.get("html_col", "html")
    rows = materialize(prepared(pages, **options), "pages")
    return judged(rows, train(rows, materialize(unigrams(pages, html_col), "unigrams")))
