"""Search by a table of terms against one regular expression after the other."""
import re

import pytest
from pyspark.sql import functions as F

from shopsignal.operators import targeting, term_search

PRODUCTS = [("1", "Small ring", "SHOES", "Brand#1"), ("2", "ring (large)", None, "Brand#12"), ("3", "R.I.N.G", "ring|rod", "Brand#2"), ("4", None, None, None),
            ("42", "a+b? c*", "50% off [new]", "ÉTÉ été"), ("007", "x", "xy", "tab\tline\nend"), ("5", "", " ", "rrriiinnnggg"), ("6", "ab" * 300, "q", "z")]
TERMS = ["ring", "RING", "ri", "r", "^small", "ring$", "r.n", "r.?i", "ri?n", "rin{1,2}g", "ri{0}n", "(ring|rod)", "ring|rod|zzz", "a\\+b", "\\[new\\]", "[rs]ing", "[^r]ing", "[]x]",
         "x*", ".*", "", "(?i)BRAND", "(?x)s m a l l", "brand#1", "brand#1$", "\\bring\\b", "\\d+%", "ÉTÉ", "été", "été|ring", "(r(i)n)g", "((a|b)+)c?", "tab.line", "(?s)tab.*end", "q{2}",
         "absent", "z|", "ring\\|rod", "c\\*", "(?:sm)all", "(?=ring)r", "(?!x)y", "r+i+n+g+", "42", " 42 ", "7", "007", "-42", "-0", "0042", "ab{3}", "a{1}b", "\\Qa+b\\E", "\\Qring|rod\\E"]


def catalogue(spark):
    return spark.createDataFrame([(i, a, b, c, 1) for i, a, b, c in PRODUCTS], "ProductID string, FamilyLevel2 string, Category string, FamilyLevel1 string, gram int")


def test_same_as_one_search_after_the_other(spark):
    p = catalogue(spark)
    terms = spark.createDataFrame([(t, 1) for t in TERMS + TERMS[:5] + [None]], "term string, text int")
    got = {}
    for r in term_search.search_terms(p, terms).collect():
        got.setdefault(r.term, []).append(r.ProductID)
    for t in TERMS:
        want = sorted(r.ProductID for r in targeting.product_search(p, t).collect())
        assert sorted(got.get(t, [])) == want, t
    assert set(got) <= set(TERMS)


def test_every_literal_is_in_every_match(spark):
    """What a term is filed under must be in each text that it matches."""
    df = spark.createDataFrame([(t,) for t in TERMS if not re.fullmatch(r"\s*-*[0-9]+\s*", t)], "term string")
    runs = {r.term: r.runs for r in df.select("term", term_search._literal_runs(F.col("term")).alias("runs")).collect()}
    assert runs["ri?n"] == [["r", "n"]] and runs["ring|rod|zzz"] == [["ring"], ["rod"], ["zzz"]] and runs["(ring|rod)"] == [[]] and runs["\\[new\\]"] == [["new"]]
    assert runs["(?x)s m a l l"] == [[]] and runs["rin{1,2}g"] == [["ri", "g"]]


def test_candidates_come_by_equi_join(spark):
    p, terms = catalogue(spark), spark.createDataFrame([(t,) for t in TERMS], "term string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", old):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            plan = term_search.search_terms(p, terms)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty_tables_and_bad_terms(spark):
    p, terms = catalogue(spark), spark.createDataFrame([("ring",)], "term string")
    assert term_search.search_terms(p.limit(0), terms).count() == 0
    assert term_search.search_terms(p, terms.limit(0)).count() == 0
    with pytest.raises(Exception, match="(?i)pattern|regex"):
        term_search.search_terms(p, spark.createDataFrame([("a**[",)], "term string")).collect()
