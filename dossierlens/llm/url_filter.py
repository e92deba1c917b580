"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path together with literal tokens that any url it fits must contain. The
rarest of these, counted over the tokens of the table, is the key of the rule. The tokens of an url fetch the rules with
that key by an equi-join, and only those run their expression. All work is DataFrame functions; rules are a relation, so
thousands of them need no other plan, and no page is gathered with others.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end. Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. Of several fitting
rules the longest wins, then the first in order. Repeated rows are answered one by one; other columns pass through, columns
named like the outputs are replaced. Without rules every page is allowed.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPLIT = "[^a-z0-9]+"
# An index of up to this many rules is copied to the tasks; a longer one is joined by shuffling tokens.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """``rank`` 1 rules go before rank 0 rules; ``listed`` rules are named in the result."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple
    rank: int = 1
    listed: bool = True


def host_rule(name: str, verdict: str) -> UrlRule:
    """``host/path``: fits the host, its subdomains, and every path that begins with the rule's path."""
    host, slash, path = name.partition("/")
    # The last token of a path that does not end there may go on in the url, so it is no whole token of it.
    whole = f"{host} {path if not path[-1:].isalnum() else re.sub('[A-Za-z0-9]+$', '', path)}"
    return UrlRule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}",
                   tuple(t for t in re.split(SPLIT, whole.lower()) if t))


def word_rule(name: str, verdict: str, *tokens: str) -> UrlRule:
    """Fits urls in which the tokens stand beside each other, whatever separates them."""
    pattern = rf"(?i)(?:^|[^a-z0-9]){'[^a-z0-9]+'.join(map(re.escape, tokens))}(?:[^a-z0-9]|$)"
    return UrlRule(name, verdict, pattern, tokens, rank=0, listed=False)


# The contract's rules, then common marks of unwanted pages.
CONTRACT_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"),
                  host_rule("org/fr/", "allow"))
WORD_RULES = (word_rule("spam farm", "block", "spam", "farm"), word_rule("casino", "block", "casino"), word_rule("porn", "block", "porn"),
              word_rule("viagra", "block", "viagra"), word_rule("login", "block", "login"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _relation(spark, rules: tuple) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("number"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"),
                     F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.tokens)).alias("tokens"), F.lit(r.rank).alias("rank"),
                     F.lit(r.listed).alias("listed")) for k, r in enumerate(rules)]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def filter_urls(pages: DataFrame, rules: tuple = CONTRACT_RULES + WORD_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns plus host, path, rule (of listed rules, else null) and verdict."""
    outputs = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in outputs]
    split = pages.select(F.struct(*kept).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not rules:
        return split.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token")
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat("host", "path")), SPLIT), lambda t: t != ""))
    relation = _relation(pages.sparkSession, rules)
    literals = relation.select("number", F.explode("tokens").alias("token"))
    counts = (split.select(F.explode(words).alias("token")).join(literals.select("token").distinct(), "token", "left_semi")
              .groupBy("token").agg(F.count("*").alias("n")))
    rarest = (literals.join(counts, "token", "left").groupBy("number")
              .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    index = relation.join(rarest, "number").select("token", F.struct("rank", F.length("name").alias("length"), (-F.col("number")).alias("order"),
                                                                      "name", "verdict", "listed").alias("found"), "pattern")
    # The number only tells rows apart; it follows from the file split and the place in it, so a repeated task gives it again.
    tokens = split.withColumn("uid", F.monotonically_increasing_id()).withColumn("token", F.explode_outer(words))
    fetched = tokens.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token", "left")
    fits = F.when(F.expr("concat(host, path) rlike pattern"), F.col("found"))
    best = (fetched.groupBy("uid").agg(F.max(fits).alias("best"), F.first("row").alias("row"), F.first("host").alias("host"),
                                       F.first("path").alias("path")))
    return best.select("row.*", "host", "path", F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


ORACLE = r"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])(spam[^a-z0-9]+farm|casino|porn|viagra|login)([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
