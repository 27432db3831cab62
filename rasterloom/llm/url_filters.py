"""URL filters indexed by each rule's rarest literal token, with DataFrame functions only.

A rule is a host and a path; it fits the host and its subdomains where the path starts with
the rule's, and becomes one regular expression.  The rule is filed under the one of its
literal tokens (host labels, whole path segments) that the fewest URLs hold.  A token says
whether it stands in the host or in the path.  A URL's tokens fetch the candidate rules, only
those run their regular expression, and the longest wins.
URLs that no rule decides go to ``PATTERNS``, filed and fetched alike: a pattern needs all its
literal tokens, and tokens end wherever a pattern may have a boundary.  Tokens are counted over
all URLs, whatever the number of rules.

Up to ``LITERAL_RULES`` rules the index is a constant map within the plan: no join, no
shuffle.  Longer lists are joined by token.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no
rule; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LITERAL_RULES = 512
#: Heads of tokens.
HOST, PATH = "h:", "p:"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return r"^(?:[^/]*\.)?" + _quoted(self.name)

    @property
    def tokens(self) -> list[str]:
        whole = self.path.split("/")[1:-1]  # the last segment may be part of a longer one
        return [HOST + t for t in self.host.split(".") if t] + [PATH + t for t in whole if t]


class Pattern(NamedTuple):
    """A general rule of the method: words, joined by hyphens, between boundaries in the host or in the path."""

    action: str
    where: str
    words: str

    @property
    def name(self) -> str:
        return f"{self.where}:{self.words}"

    @property
    def pattern(self) -> str:
        """Without look-around, so that it means the same in SQL."""
        before = "^(?:[^/]*[^a-z0-9/])?" if self.where == "host" else "^[^/]*/(?s:.*[^a-z0-9])?"
        return before + self.words + "(?:[^a-z0-9]|$)"

    @property
    def tokens(self) -> list[str]:
        return [(HOST if self.where == "host" else PATH) + w for w in self.words.split("-")]


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Hosts that name themselves as spam, gambling or pornography, and paths that no text is expected under.
HOST_WORDS = "spam casino porn xxx ads adult viagra poker warez phishing malware link-farm content-farm click-farm free-bets free-money free-pills cheap-pills payday-loans sports-betting"
PATH_WORDS = "wp-login wp-admin cgi-bin xmlrpc phishing casino porn viagra payday-loans link-farm"
PATTERNS = (*[Pattern("block", "host", w) for w in HOST_WORDS.split()], *[Pattern("block", "path", w) for w in PATH_WORDS.split()])


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_~\- ])", r"\\\1", text)


def split_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr("substring(coalesce({0}, ''), instr(coalesce({0}, ''), '://') + 3)".format("url"))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.translate(F.regexp_extract(rest, r"^[^/]*", 0), C.UPPER, C.LOWER)
    return host, F.regexp_extract(rest, r"^[^/]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels and path segments as they are, and all words between boundaries of the patterns, each once."""

    def tokens(text: Column, separator: str, head: str) -> Column:
        words = F.split(F.translate(text, C.UPPER, C.LOWER), "[^a-z0-9]+", -1)
        return F.transform(F.concat(F.split(text, separator, -1), words), lambda t: F.concat(F.lit(head), t))

    return F.array_distinct(F.concat(tokens(host, r"\.", HOST), tokens(path, "/", PATH)))


def rarest(rules: Sequence[Rule | Pattern], counts: dict[str, int]) -> list[tuple[str, Rule | Pattern]]:
    """Each rule with the token it is filed under; a rule without a whole token cannot be filed and raises."""
    bare = [r.name for r in rules if not r.tokens]
    if bare:
        raise ValueError(f"rules without a whole token: {bare}")
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), r) for r in rules]


def _listed(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A list of the driver's as a table, read by the JVM from one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def token_counts(urls: DataFrame, rules: Sequence[Rule | Pattern]) -> dict[str, int]:
    """How many URLs hold each token of the rules: one aggregation whose size is that of the rule list."""
    tokens = sorted({t for r in rules for t in r.tokens})
    wanted = _listed(urls.sparkSession, [{"token": t} for t in tokens], "token string")
    wanted = F.broadcast(wanted) if len(tokens) <= C.BROADCAST_ROWS else wanted
    return {r["token"]: r["count"] for r in urls.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").count().collect()}


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Pattern] = PATTERNS, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Each row as struct ``row``, with host, path, rule, verdict and n_candidates (rules and patterns fetched)."""
    base = pages.select(F.struct("*").alias("row"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    urls = base.select("row", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", url_tokens(F.col("host"), F.col("path"))).withColumn("target", F.concat("host", "path"))
    counts = token_counts(urls.select("tokens"), [*rules, *patterns])
    if len(rules) <= LITERAL_RULES:
        entries: dict[str, list[Column]] = {}
        for token, r in rarest(rules, counts):
            entries.setdefault(token, []).append(F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.action).alias("action")))
        urls = urls.withColumn("candidates", _fetch(entries, "struct<length:int,name:string,pattern:string,action:string>"))
    else:
        urls = _joined(urls, rules, counts)
    fits = "filter(candidates, c -> regexp_like(target, c.pattern))"
    general: dict[str, list[Column]] = {}
    for token, p in rarest(patterns, counts):
        general.setdefault(token, []).append(F.struct(F.lit(p.name).alias("name"), F.lit(p.pattern).alias("pattern"), F.lit(p.action).alias("action")))
    urls = urls.withColumn("best", F.expr(f"array_max({fits})")).withColumn("general", _fetch(general, "struct<name:string,pattern:string,action:string>"))
    # of several patterns the first by name decides
    own = F.expr(f"array_min(filter(general, c -> regexp_like(translate(target, '{C.UPPER}', '{C.LOWER}'), c.pattern))).action")
    verdict = F.coalesce(F.col("best.action"), own, F.lit(default))
    return urls.select("row", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), (F.size("candidates") + F.size("general")).alias("n_candidates"))


def _fetch(entries: dict[str, list[Column]], kind: str) -> Column:
    """Array of the entries filed under any of the row's tokens."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    if not entries:
        return none
    index = F.create_map(*[x for t, rows in entries.items() for x in (F.lit(t), F.array(*rows))])
    return F.flatten(F.transform("tokens", lambda t: F.coalesce(F.element_at(index, t), none)))


def _joined(urls: DataFrame, rules: Sequence[Rule], counts: dict[str, int]) -> DataFrame:
    """Long rule lists: candidates by a join on the token, gathered per distinct URL."""
    spark = urls.sparkSession
    filed = rarest(rules, counts)
    rows = [{"token": t, "length": len(r.name), "name": r.name, "pattern": r.pattern, "action": r.action} for t, r in filed]
    index = _listed(spark, rows, "token string, length int, name string, pattern string, action string")
    distinct = urls.select("host", "path", "tokens").distinct()
    found = distinct.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
    gathered = found.groupBy("host", "path").agg(F.collect_set(F.struct("length", "name", "pattern", "action")).alias("found"))
    none = F.expr("cast(array() as array<struct<length:int,name:string,pattern:string,action:string>>)")
    return urls.join(gathered, ["host", "path"], "left").withColumn("candidates", F.coalesce("found", none)).drop("found")


def filter_urls(pages: DataFrame, **options) -> DataFrame:
    return judge(pages, **options).where("verdict = 'allow'").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(C.table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


_HOSTS, _PATHS = ("|".join(w.split()) for w in (HOST_WORDS, PATH_WORDS))
SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT h.*, (SELECT max({{'length': length(rhost || rpath), 'name': rhost || rpath, 'action': action}}) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM h)
SELECT page_id, host, path, best['name'] AS rule, CASE WHEN best IS NOT NULL THEN best['action']
  WHEN regexp_matches(host, '(^|[^a-z0-9])({_HOSTS})([^a-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]({_PATHS})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
