"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a row (rule, verdict) of a DataFrame, of one of two kinds.

Site rules, ``host`` or ``host/path``, fit the host and all its subdomains where the url's path starts
with the rule's (case kept, the host's A-Z lowered); the longest one that fits wins, of equally long ones
the one with the longer host, of one rule with two verdicts ``block``.

Pattern rules start with ``~`` and judge the url's address (what follows the first ``://``, or the whole
url without one; A-Z lowered): ``||`` at the start stands for the start of the host or of one of its
labels, ``|`` at either end for that end, ``*`` for any characters, ``^`` for one character that is no
letter a-z or digit, or the end; everything else for itself. They decide where no site rule fits: an
``allow`` pattern comes before any ``block`` pattern, and a url that nothing fits is allowed.

Method: a token is a run of a-z and 0-9. Literal tokens of a rule, those that stand between literal
separators or ends, must be tokens of every url that the rule fits. Tokens are counted over all urls, and
each rule is filed under its rarest one; a rule without any is filed under the empty token, which every
url has. Distinct urls are exploded into their distinct tokens, an equi-join with the index fetches
candidate rules, and only those run their regular expression. Spark sends the index to every task only
where it measures below its broadcast threshold; else both sides are shuffled by token, and the adaptive
join splits a frequent one. A url that fills a third of the table is judged once.

Null urls have an empty host and path, fit no rule and are allowed; so is the empty url. Repeated rows
(equal page ids too) are judged alike, each gets its row. Null or empty rules and null verdicts take no
part. Empty tables give empty results. New columns that clash with the table's get underscores; the rules'
names never meet the table's.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import fresh_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """(rule, verdict) as (number, rule, verdict, site, regex, tokens, rank): all in SQL functions, so a rule list may be large."""
    r = (rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict"))
              .filter((F.length("rule") > 0) & F.col("verdict").isin("allow", "block")).distinct())
    quoted = lambda c: F.regexp_replace(c, r"([\\.+?()\[\]{}$|^*])", r"\\$1")
    site = ~F.col("rule").startswith("~")
    # site rules
    host = lowered(F.regexp_extract("rule", "^[^/]*", 0))
    path = F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    site_regex = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host), F.when(path == "", F.lit("(?:/|$)")).otherwise(quoted(path)))
    open_end = path.rlike("[A-Za-z0-9]$")
    site_text = F.concat(host, lowered(path), F.when(open_end, F.lit("*")).otherwise(F.lit("")))
    # pattern rules
    body = lowered(F.substring("rule", 2, 1 << 30))
    start = F.regexp_extract(body, r"^\|{0,2}", 0)
    end = body.rlike(r"[^|]\|$")
    core = F.regexp_replace(F.regexp_replace(body, r"^\|{1,2}", ""), r"\|$", "")
    # a star at an open end says nothing, and would only make the search quadratic
    bare = F.when(start == "", F.regexp_replace(core, r"^\*+", "")).otherwise(core)
    bare = F.when(end, bare).otherwise(F.regexp_replace(bare, r"\*+$", ""))
    regex = F.regexp_replace(quoted(bare), r"\\\*", ".*")
    regex = F.regexp_replace(regex, r"\\\^", r"(?:[^a-z0-9]|\$)")
    pattern_regex = F.concat(F.lit("(?s)"), F.when(start == "||", F.lit(r"^(?:[^/?#]*\.)?")).when(start == "|", F.lit("^")).otherwise(F.lit("")),
                             regex, F.when(end, F.lit(r"\z")).otherwise(F.lit("")))
    pattern_text = F.concat(F.when(start == "", F.lit("*")).otherwise(F.lit("")), core, F.when(end, F.lit("")).otherwise(F.lit("*")))
    text = F.when(site, site_text).otherwise(pattern_text)
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0)))
    rank = F.struct(F.when(site, 2).when(F.col("verdict") == "allow", 1).otherwise(0).alias("kind"),
                    F.when(site, F.length("rule")).otherwise(0).alias("length"),
                    F.when(site, F.length(host)).otherwise(0).alias("host_length"), "verdict", "rule")
    return r.select("rule", "verdict", site.alias("site"), F.when(site, site_regex).otherwise(pattern_regex).alias("regex"),
                    tokens.alias("tokens"), rank.alias("rank"))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url, with the empty one."""
    found = F.array_distinct(F.regexp_extract_all(lowered(url), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.concat(F.array(F.lit("")), found)


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Compiled rules, each with its rarest literal ``token``; ``urls`` (column url) are the distinct ones."""
    compiled = compile_rules(rules)
    wanted = compiled.select(F.explode("tokens").alias("token"), "rank")
    counts = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (wanted.join(counts, "token", "left").groupBy("rank")
                    .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).select("rank", F.col("r.token").alias("token")))
    return (compiled.join(rarest, "rank", "left").select(F.coalesce("token", F.lit("")).alias("token"), "site", "regex", "rank"))


def judge_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule's rank (kind, length, host_length, verdict, rule) of each distinct url that a rule fits."""
    index = index_rules(urls, rules)
    url = F.col("url")
    parts = urls.select("url", F.concat(host_of(url), path_of(url)).alias("place"),
                        lowered(F.coalesce(after_scheme(url), url)).alias("address"), F.explode(url_tokens(url)).alias("token"))
    fits = F.when(F.col("site"), F.expr("place rlike regex")).otherwise(F.expr("address rlike regex"))
    return parts.join(index, "token").filter(fits).groupBy("url").agg(F.max("rank").alias("best"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with host, path, rule (the site rule that decided, else null) and verdict; and these columns' names."""
    names = fresh_names(pages.columns, ("host", "path", "rule", "verdict"))
    key = next(iter(fresh_names(pages.columns, ("judged_url",)).values()))
    best = next(iter(fresh_names([*pages.columns, key], ("judged_best",)).values()))
    urls = pages.select(F.col(f"`{url}`").alias("url")).filter(F.col("url").isNotNull()).distinct()
    won = judge_urls(urls, rules).select(F.col("url").alias(key), F.col("best").alias(best))
    out = pages.join(won, F.col(f"`{url}`") == F.col(key), "left")
    u, rank = F.col(f"`{url}`"), F.col(best)
    return out.withColumns({
        names["host"]: host_of(u), names["path"]: path_of(u),
        names["rule"]: F.when(rank["kind"] == 2, rank["rule"]),
        names["verdict"]: F.coalesce(rank["verdict"], F.lit("allow")),
    }).drop(key, best), names
