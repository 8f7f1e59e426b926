"""URL verdicts from host/path rules and from pattern rules indexed by their rarest literal token. DataFrame functions only.

Host/path rules: a rule fits its host and all its subdomains where the url's path starts with the rule's path; the
longest rule wins. A url that no such rule fits gets its verdict from pattern rules: each pattern is filed under its
rarest literal token (by the tokens' counts over all urls), a url's own tokens fetch candidates, and only these run
their regular expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): domain rules of the standard query.
DOMAIN_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: (pattern, literal tokens that every match holds as whole tokens): pattern rules of the standard query.
PATTERN_RULES = (
    (r"^[a-z]+://([^/]*\.)?spam-farm\.", ("spam", "farm")),
    (r"^[a-z]+://([^/]*\.)?cheap-pills\.", ("cheap", "pills")),
    (r"^[a-z]+://([^/]*\.)?casino-win\.", ("casino", "win")),
    (r"[/._-]adult[/._-]", ("adult",)),
    (r"[?&]utm_campaign=(ads|promo)(&|#|$)", ("utm", "campaign")),
    (r"/(login|signin)\.php([?#]|$)", ("php",)),
)
#: At most so many pattern rules (and host/path rules) are held as a constant of the plan; more become tables that are joined.
MAX_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    """A pattern and the literal tokens (lower-case runs of a-z and 0-9) which each of its matches contains."""

    pattern: str
    literals: tuple[str, ...]


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The url's distinct tokens: lower-cased runs of a-z and 0-9."""
    lower = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, "[^a-z0-9]+"), lambda t: t != ""))


def domain_rule(host: Column, path: Column, rules=DOMAIN_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are tried longest first (host, then path)."""
    ordered = sorted(rules, key=lambda r: (-(len(r[1]) + len(r[2])), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def literal_counts(urls: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many urls hold each literal token of the rules: at most as many rows as the rules have tokens come back."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    held = F.array_intersect(tokens_of(urls[url_col].cast("string")), F.array(*map(F.lit, wanted)))
    return {r["token"]: r["n"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[str]]:
    """Patterns by their rarest literal token; ties go to the smaller token. Patterns without a literal are under ''."""
    index: dict[str, list[str]] = {}
    for r in rules:
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r.pattern)
    return {k: sorted(v) for k, v in sorted(index.items())}


def any_pattern(url: Column, index: dict[str, list[str]]) -> Column:
    """Whether a candidate pattern of the url's tokens is found in it. The index is a constant array of hash buckets."""
    keyed = {k: v for k, v in index.items() if k}
    found = F.lit(False)
    for p in index.get("", []):
        found = found | url.rlike(p)
    if keyed:
        tokens = tokens_of(url)
        entries = F.map_from_arrays(F.array(*map(F.lit, keyed)), F.array(*(F.array(*map(F.lit, v)) for v in keyed.values())))
        held = F.array_intersect(tokens, F.array(*map(F.lit, keyed)))
        candidates = F.flatten(F.transform(held, lambda t: F.element_at(entries, t)))
        found = found | F.exists(candidates, lambda p: F.call_function("regexp_like", url, p))
    return F.coalesce(found, F.lit(False))


def suffixes_of(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitted_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, fitted) of the urls (url, host, path) that a rule (own, verdict, path) fits, for lists of any length.

    A url's host and the domains above it fetch the rules filed under them; the longest that fits is a partial aggregate.
    """
    met = urls.select("url", "path", F.explode(suffixes_of(F.col("host"))).alias("own")).join(rules.withColumnRenamed("path", "begin"), "own").where(F.expr("startswith(path, begin)"))
    first = F.min(F.struct((-(F.length("own") + F.length("begin"))).alias("size"), "verdict", "own", "begin"))
    return met.groupBy("url").agg(first.alias("r")).select("url", F.concat("r.own", "r.begin").alias("rule"), F.col("r.verdict").alias("fitted"))


def matched_by_table(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url) of those in which a pattern (token, pattern) filed under one of the url's tokens is found."""
    met = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(patterns, "token")
    return met.where(F.call_function("regexp_like", F.col("url"), F.col("pattern"))).select("url").distinct()


def judge_urls(pages: DataFrame, domain_rules=DOMAIN_RULES, pattern_rules=PATTERN_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    A null url, or one without ://, has an empty host and path, fits no rule and gets the default verdict, as no
    pattern is run on null. Repeated rows and null ids pass through. Other columns are not read. The counts of the
    rules' literals take one pass with a partial aggregate (its result is bounded by the rules). Up to MAX_RULES rules of
    a kind are held in the plan, and judging takes no shuffle. More rules are a table to which the distinct urls
    are joined by their domains and tokens; patterns without a literal are run on every url, as there is no other way.
    """
    spark = pages.sparkSession
    rules = tuple(r if isinstance(r, Rule) else Rule(r[0], tuple(r[1])) for r in pattern_rules)
    index = rule_index(rules, literal_counts(pages, url_col, rules))
    url = F.col("url")
    base = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    base = base.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    distinct = base.where("url IS NOT NULL").select("url", "host", "path").distinct()
    if len(domain_rules) > MAX_RULES:
        listed = spark.createDataFrame([(h, v, p) for v, h, p in domain_rules], "own string, verdict string, path string")
        base = base.join(fitted_by_table(distinct, listed), "url", "left").select("id", "url", "host", "path", "rule", "fitted")
    else:
        name, verdict = domain_rule(F.col("host"), F.col("path"), domain_rules)
        base = base.select("id", "url", "host", "path", name.alias("rule"), verdict.alias("fitted"))
    if len(rules) > MAX_RULES:
        filed = spark.createDataFrame([(t, p) for t, ps in index.items() if t for p in ps], "token string, pattern string")
        found = matched_by_table(distinct.select("url"), filed).withColumn("found", F.lit(True))
        base = base.join(found, "url", "left")
        blocked = F.coalesce(F.col("found"), any_pattern(url, {"": index.get("", [])}))
    else:
        blocked = any_pattern(url, index)
    pattern = F.when(blocked, F.lit("block")).otherwise(F.lit(default))
    return base.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("fitted")).otherwise(pattern).alias("verdict"))
