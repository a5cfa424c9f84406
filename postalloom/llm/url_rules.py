"""URL filters by association rules, in DataFrame expressions and Spark's FP-growth only.

A URL is a set of tokens: labels of its host, segments of its path, its ending and its query's keys. FP-growth
mines the token sets of the URLs labelled bad for those that stand in LEAST_ROWS of them at least; how many good URLs hold each
is counted next. A token set becomes a rule if it implies "bad" with enough confidence, if that is no chance
(LEAST_Z standard deviations above the share of bad URLs at large), and if no part of it is a rule. Rules are matched through an
inverted index that is a constant of the plan: a rule stands under its rarest token, so a URL looks at few
rules and no row is shuffled. Stated rules for hosts and paths go before mined ones.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no stated rule and is judged by its tokens; a null label is
left out. An empty URL has no tokens and is allowed. Very long URLs are read whole. Ties: of several mined rules that match, the first in
order of its text is named. Repeated rows are judged each, repeated labels count each. Clashing columns of the input are replaced where they
are named as the result's, else carried. An empty table gives an empty one; without labels there are no mined rules.
"""

from __future__ import annotations

import json
import math
from functools import partial

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.llm.common import UPPER, cut, join_hot, row, table

NAME = "op9_url_rules"

#: (verdict, host, path) of the contract.
STATED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A rule holds in so many bad URLs at least, and in this share of them.
LEAST_ROWS = 20
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Standard deviations that a rule's share of bad URLs lies above that of all labelled ones; five leave one chance rule in 3 million token sets.
LEAST_Z = 5.0
BUCKETS = 256
#: More rules than this don't fit a constant of the plan and are joined by their rarest token.
MOST_CONSTANT = 5_000

_CASES = sorted(STATED, key=lambda r: -len(r[1] + r[2]))
_FITS = [f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}') THEN" for _, host, start in _CASES]
#: The query by plain enumeration of the token sets of bad pages, level by level.
ORACLE = rf"""
WITH RECURSIVE rests AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '\A([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM rests),
cut_up AS (
  SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels,
         list_filter(list_transform(string_split(lower(path), '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')), lambda x: regexp_matches(x, '\p{{L}}')) AS segments,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: x <> '') AS pairs FROM parts),
worded AS (
  SELECT *, list_filter(flatten(list_transform(list_filter(list_concat(labels, segments), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]+[\p{{L}}\p{{N}}]')),
         lambda x: string_split_regex(x, '[^\p{{L}}\p{{N}}]+'))), lambda x: length(x) > 1) AS words FROM cut_up),
tokenised AS (
  SELECT page_id, host, path, list_sort(list_distinct(flatten([list_transform(labels, lambda x: 'h:' || x), list_transform(segments, lambda x: 'p:' || x),
         list_transform(words, lambda x: 'w:' || x), list_transform(pairs, lambda x: 'q:' || string_split(x, '=')[1])]))) AS items FROM worded),
rated AS (SELECT doc_id, quality = 0 OR coalesce(toxic, 0) = 1 AS bad FROM labels),
baskets AS (
  SELECT row_number() OVER () AS basket, items, bad
  FROM (SELECT items, try_cast(regexp_extract(path, '/([0-9]+)(?:[.][a-z]+)?/?$', 1) AS BIGINT) AS doc_id FROM tokenised) JOIN rated USING (doc_id) WHERE bad IS NOT NULL),
totals AS (SELECT avg(bad::INT) AS base, greatest({LEAST_ROWS}, ceil({MIN_SUPPORT} * count(*) FILTER (WHERE bad))) AS least FROM baskets),
singles AS (SELECT token FROM (SELECT unnest(items) AS token FROM baskets WHERE bad) GROUP BY token HAVING count(*) >= (SELECT least FROM totals)),
held AS (SELECT basket, token FROM (SELECT basket, unnest(items) AS token FROM baskets WHERE bad) JOIN singles USING (token)),
frequent(own, last) AS (
  SELECT [token], token FROM singles
  UNION ALL
  SELECT list_append(own, token), token FROM frequent JOIN held ON token > last JOIN baskets USING (basket) WHERE list_has_all(items, own)
  GROUP BY own, token HAVING count(*) >= (SELECT least FROM totals)),
counted AS (
  SELECT own, count(*) AS n, avg(bad::INT) AS share FROM frequent JOIN baskets ON list_has_all(items, own) GROUP BY own),
sure AS (
  SELECT own FROM counted, totals WHERE share >= {MIN_CONFIDENCE} AND share > base AND (share - base) * sqrt(n) >= {LEAST_Z} * sqrt(base * (1 - base))),
rules AS (SELECT own, array_to_string(own, ' & ') AS name FROM sure a WHERE NOT EXISTS (FROM sure b WHERE b.own <> a.own AND list_has_all(a.own, b.own))),
mined AS (SELECT items, min(name) AS mined FROM (SELECT DISTINCT items FROM tokenised) JOIN rules ON list_has_all(items, own) GROUP BY items)
SELECT page_id, host, path, CASE {" ".join(f"{fit} '{host}{start}'" for fit, (_, host, start) in zip(_FITS, _CASES, strict=True))} END AS rule,
       CASE {" ".join(f"{fit} '{says}'" for fit, (says, _, _) in zip(_FITS, _CASES, strict=True))} WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined
FROM tokenised LEFT JOIN mined USING (items)
"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest is tested first
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _prefixed(kind: str, x: Column) -> Column:
    return F.concat(F.lit(kind), x)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: labels of the host (h:), segments of the path (p:), words within either that join several (w:), keys of the query (q:).

    Digits are generalised, and a segment without a letter is none, so that a rule can't name a single page. Null: none.
    """
    host, path = split_url(url)
    parts = F.filter(F.transform(F.split(F.lower(path), "/"), lambda x: F.regexp_replace(x, r"[0-9]+", "#")), lambda x: x.rlike(r"\p{L}"))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    compound = F.filter(F.concat(labels, parts), lambda x: x.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]"))
    words = F.filter(F.flatten(F.transform(compound, lambda x: F.split(x, r"[^\p{L}\p{N}]+"))), lambda x: F.char_length(x) > 1)
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.element_at(F.split(x, "="), 1))
    kinds = {"h:": labels, "p:": parts, "w:": words, "q:": keys}
    named = [F.transform(found, partial(_prefixed, kind)) for kind, found in kinds.items()]
    return F.coalesce(F.array_distinct(F.concat(*named)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, least_rows: int = LEAST_ROWS, min_support: float = MIN_SUPPORT, least_z: float = LEAST_Z) -> list[tuple[list[str], int, int]]:
    """(tokens, bad rows, good rows) of the rules for "bad" from rows (url, bad), fewest tokens first.

    All labelled rows count. Token sets are counted, tested and pruned in Spark; only the rules reach the driver.
    """
    baskets = cut(labelled.where("bad is not null").select("bad", F.array_sort(tokens(F.col("url"))).alias("items")).groupBy("items").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good")))
    n = baskets.agg(F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n_good"), F.lit(0)).alias("good")).first()
    least = max(least_rows, math.ceil(min_support * n["bad"]))
    bad = baskets.where("n_bad > 0 and size(items) > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n_bad"))).select("items")
    rows = bad.count()
    if rows < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows).fit(bad)
    sets = cut(model.freqItemsets.select(F.array_sort("items").alias("own"), F.col("freq").alias("n_bad")))
    base = n["bad"] / (n["bad"] + n["good"])
    held = _held(baskets.where("n_good > 0").select("items", "n_good"), sets.select("own")).groupBy("own").agg(F.sum("n_good").alias("n_good"))
    counted = sets.join(held, "own", "left").select("own", "n_bad", F.coalesce("n_good", F.lit(0).cast("long")).alias("n_good"))
    both = F.col("n_bad") + F.col("n_good")
    share = F.col("n_bad") / both
    sure = cut(counted.where((share >= min_confidence) & ((share - base) * F.sqrt(both) >= least_z * math.sqrt(base * (1 - base))) & (share > base)))
    whole = _held(sure.select(F.col("own").alias("items")), sure.select("own")).where("own <> items").select(F.col("items").alias("own")).distinct()
    minimal = sure.join(whole, "own", "left_anti").collect()
    return sorted(((r["own"], r["n_bad"], r["n_good"]) for r in minimal), key=lambda r: (len(r[0]), r[0]))


def _held(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``baskets`` (items and others) with each of the ``sets`` (own) that they hold, through an inverted index by the sets' rarest tokens.

    A token that very many baskets hold is joined by broadcast, so no task gathers its baskets.
    """
    placed = baskets.withColumn("token", F.explode("items"))
    often = placed.groupBy("token").agg(F.count("*").alias("n"))
    named = sets.select("own", F.explode("own").alias("token")).join(often, "token", "left")
    rarest = named.groupBy("own").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "token")).alias("least"))
    posts = rarest.groupBy(F.col("least.token").alias("token")).agg(F.collect_list("own").alias("owns"), F.first("least.n").alias("n"))
    met = join_hot(placed, posts, ["token"], "n", ["items"]).where("owns is not null")
    found = met.select(*baskets.columns, F.explode("owns").alias("own"))
    return found.where(F.size(F.array_except("own", "items")) == 0)


def index(rules: list[list[str]]) -> dict[str, list[list[str]]]:
    """Rules under their rarest token, by the number of rules that name it."""
    named: dict[str, int] = {}
    for own in rules:
        for t in own:
            named[t] = named.get(t, 0) + 1
    out: dict[str, list[list[str]]] = {}
    for own in rules:
        out.setdefault(min(own, key=lambda t: (named[t], t)), []).append(own)
    return out


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def matched(pages: DataFrame, rules: list[tuple[list[str], int, int]], name: str = "mined") -> DataFrame:
    """``pages`` with the mined rule that the row's URL holds, its tokens joined by " & ", or null."""
    spark, column, owns = pages.sparkSession, tokens(F.col("url")), [r[0] for r in rules]
    if not rules:
        return pages.withColumn(name, F.lit(None).cast("string"))
    if len(rules) <= MOST_CONSTANT:
        posted = index(owns)
        names = sorted(posted)
        places = [r[0] for r in spark.createDataFrame([(t,) for t in names], "t string").select(_bucket(F.col("t"))).collect()]
        buckets: list[list] = [[] for _ in range(BUCKETS)]
        for t, b in zip(names, places, strict=True):
            buckets[b].append({"token": t, "rules": posted[t]})
        held = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<token:string,rules:array<array<string>>>>>")
        named = pages.withColumn("_tokens", column)
        fits = lambda t: F.flatten(F.transform(F.filter(F.get(held, _bucket(t)), lambda e: e["token"] == t), lambda e: F.filter(e["rules"], lambda r: F.size(F.array_except(r, F.col("_tokens"))) == 0)))
        hits = F.flatten(F.transform("_tokens", fits))
        return named.withColumn(name, F.array_min(F.transform(hits, lambda r: F.array_join(r, " & ")))).drop("_tokens")
    urls = cut(pages.where("url is not null").groupBy("url").agg(F.count("*").alias("times")))
    sets = spark.createDataFrame([(own,) for own in owns], "own array<string>")
    hits = _held(urls.select("url", "times", column.alias("items")), sets).groupBy("url").agg(F.first("times").alias("times"), F.min(F.array_join("own", " & ")).alias(name))
    return join_hot(pages, hits, ["url"], "times", [c for c in pages.columns if c != "url"]).select(*pages.columns, name)


def judged(pages: DataFrame, rules: list[tuple[list[str], int, int]]) -> DataFrame:
    """``pages`` with host, path, rule, verdict and mined: the stated rule's verdict, else block for URLs that a mined rule matches, else allow."""
    host, path = split_url(F.col("url"))
    made = ("host", "path", "rule", "verdict", "mined")
    placed = matched(pages.select(row(pages, *made), "url"), rules, "mined").withColumns({"host": host, "path": path})
    rule, verdict = stated_rule(F.col("host"), F.col("path"))
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return placed.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).select("row.*", *made)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose URL ends its path in the number of a labelled document; bad: low quality or toxic."""
    _, path = split_url(F.col("url"))
    number = F.expr("try_cast(regexp_extract(_path, '/([0-9]+)(?:[.][a-z]+)?/?$', 1) as bigint)")
    numbered = pages.select("url", path.alias("_path")).select("url", number.alias("doc_id")).where("doc_id is not null")
    rated = labels.select("doc_id", ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return numbered.join(rated, "doc_id").select("url", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, stated rule, verdict and the mined rule that matches."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine(labelled_pages(pages, table(spark, sf_dir, "labels")))
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined")
