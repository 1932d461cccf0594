"""URL filters against every rule run on every url, and the index's choice of tokens."""
import random
import re

from pyspark.sql import functions as F

from shopsignal.llm import url_filter

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("example.com/en", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("b.com/", "block"), ("com/a/", "allow"), ("org", "block"), ("org", "allow"), ("example.org/A.b(", "allow"), ("", "block"), (None, "block"), ("x.y/", None),
         ("~||casino^", "block"), ("~*bets^", "block"), ("~|m.shop", "allow"), ("~/feed|", "block"), ("~^id=*&x$", "block"), ("~a+b.c", "block"), ("~zz", "maybe")]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host):]).group()


def pattern(text):
    text = lower(text)
    start = "||" if text.startswith("||") else "|" if text.startswith("|") else ""
    text = text[len(start):]
    end = text.endswith("|")
    text = text if start else text.lstrip("*")
    body = "".join({"*": ".*", "^": "(?:[^a-z0-9]|$)"}.get(c) or re.escape(c) for c in (text[:-1] if end else text))
    return re.compile({"||": r"^(?:[^/?#]*\.)?", "|": "^", "": ""}[start] + body + (r"\Z" if end else ""), re.S)


def slow(url, rules):
    host, path = split(url)
    best = None
    for rule, verdict in rules:
        if not rule or verdict not in ("allow", "block"):
            continue
        if not rule.startswith("~"):
            h, p = lower(re.match("[^/]*", rule).group()), rule[len(re.match("[^/]*", rule).group()):]
            if url is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
                best = max(best or (0,), (2, len(rule), len(h), verdict, rule))
        elif url is not None:
            address = lower(url.split("://", 1)[1] if "://" in url else url)
            if pattern(rule[1:]).search(address):
                best = max(best or (0,), (int(verdict == "allow"), 0, 0, verdict, rule))
    return host, path, best[4] if best and best[0] == 2 else None, best[3] if best else "allow"


def urls():
    rng = random.Random(7)
    hosts = ["example.com", "WWW.Example.com", "b.com", "a.b.com", "notexample.com", "example.net", "x.org", "org", "casino-win.net", "m.casino.org",
             "free-bets.com", "m.shop.net", "", "example.com:80", "é.example.com", "com"]
    paths = ["", "/", "/en/", "/en", "/english", "/EN/", "/es/1", "/a/b", "/A.b(c", "/x/feed", "/feed", "/a+b.c", "/a//b", "/en/casino/"]
    rest = ["", "?q=1", "#top", "?id=4&x$", "/feed", "?u=http://example.com/en/", "?FEED"]
    out = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(rest)}" for _ in range(600) for s in (rng.choice(["http://", "https://", "", "://", "a/b://"]),)]
    return out + [None, "", "://", " ", "http://" + "a.b-" * 30_000 + "com/en/", "http://example.com/en/" + "z" * 200_000] + ["http://b.com/a/"] * 300


def test_same_as_every_rule_on_every_url(spark):
    data = urls()
    pages = spark.createDataFrame([(i, u, "v", "p") for i, u in enumerate(data)], "page_id long, url string, verdict string, Path string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    out, names = url_filter.judge(pages, rules)
    assert out.columns == [*pages.columns, "host", "path_", "rule", "verdict_"]
    got = {r.page_id: (r.host, r[names["path"]], r.rule, r[names["verdict"]]) for r in out.collect()}
    assert len(got) == len(data)
    for i, u in enumerate(data):
        assert got[i] == slow(u, RULES), u


def test_rules_are_filed_under_their_rarest_literal_token(spark):
    pages = spark.createDataFrame([(f"http://h{i}.example.com/en/rare{i % 3}",) for i in range(50)] + [("http://x.org/rare9/en",)], "url string")
    rules = spark.createDataFrame([("example.com/en/", "block"), ("com/en/rare9", "block"), ("~*en", "block"), ("~||x.org/rare9^", "block")], "rule string, verdict string")
    token = {r["rank"]["rule"]: r.token for r in url_filter.index_rules(pages.distinct(), rules).collect()}
    # 'rare9' of the second may go on in a url, so it is no token there; '~*en' has no literal token at all
    assert token == {"example.com/en/": "com", "com/en/rare9": "com", "~*en": "", "~||x.org/rare9^": "org"}


def test_only_candidates_run_expressions_and_large_indexes_are_shuffled(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/en/{i}") for i in range(100)], "page_id long, url string")
    rules = spark.range(5000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".example.com/en/")).alias("rule"), F.lit("block").alias("verdict"))
    out, _ = url_filter.judge(pages, rules)
    assert out.filter("rule is not null").count() == 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, rules)[0].count() == 0
    pages = spark.createDataFrame([(1, "http://example.com/en/"), (1, "http://example.com/en/")], "page_id long, url string")
    assert [tuple(r)[2:] for r in url_filter.judge(pages, rules.limit(0))[0].collect()] == [("example.com", "/en/", None, "allow")] * 2
