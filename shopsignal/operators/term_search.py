"""Catalogue search for a whole table of terms: an inverted index of n-grams, regular expressions as the check.

``targeting.product_search`` answers one term. Here every term of a table is answered at once with the
same meaning: case-insensitive regular-expression containment in the text fields, or an exact ProductID
where the term is a number. Distinct texts are exploded into their n-grams of one to three characters; of a
term's literal runs (what every match must contain) the rarest n-gram fetches candidate texts by an
equi-join, and only those run the expression. A top-level ``a|b`` is filed under each of its branches. A term
without any literal, like ``.*``, is filed under the empty n-gram, which every text has.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("FamilyLevel2", "Category", "FamilyLevel1")
BREAK = "\u0001"


def _folded(c: Column) -> Column:
    """A-Z lowered, as the expression's case-insensitive mode compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(text: Column) -> Column:
    """All n-grams of one to three characters of a text, and the empty one."""
    def of(n):
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))


def _literal_runs(term: Column) -> Column:
    """The branches of an expression at its top level, each as the array of texts that a match must contain.

    Everything that is not plainly a literal is taken as a break: escapes, classes, groups, what a quantifier makes
    optional, anchors and dots. Brackets that do not pair up leave nothing.
    """
    t = F.regexp_replace(term, r"\\(?s:.)", BREAK)
    t = F.regexp_replace(t, r"\[\^?\]?[^\]]*\]", BREAK)
    for _ in range(6):
        t = F.regexp_replace(t, r"\([^()]*\)", BREAK)
    # modes that drop blanks or fold more than A-Z leave no literal to rely on
    t = F.when(t.rlike(r"[()\[\]]") | term.rlike(r"\(\?[a-zA-Z-]*[xu]"), F.lit(BREAK)).otherwise(t)
    t = F.regexp_replace(t, f"[^{BREAK}]?(?:[?*]|\\{{[0-9,]*\\}})[?+]?", BREAK)
    t = F.regexp_replace(t, r"[.^$+]", BREAK)
    return F.transform(F.split(t, r"\|", -1), lambda b: F.filter(F.split(_folded(b), BREAK, -1), lambda x: x != ""))


def _needed_grams(runs: Column) -> Column:
    """For each branch the longest n-grams (at most three characters) of its runs; the empty one without any."""
    def of(run):
        n = F.least(F.length(run), F.lit(3))
        return F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))
    return F.transform(runs, lambda rs: F.when(F.size(rs) > 0, F.array_distinct(F.flatten(F.transform(rs, of)))).otherwise(F.array(F.lit(""))))


def _is_number(term: Column) -> Column:
    return F.trim(term).rlike(r"^-*[0-9]+$")


def catalogue_texts(products: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(ProductID, text): every distinct text that a product can be found by."""
    return products.select("ProductID", F.explode(F.array(*[F.col(f) for f in fields])).alias("text")).filter("text is not null").distinct()


def search_terms(products: DataFrame, terms: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(term, ProductID) for every term of ``terms`` (column term) and product that it finds.

    NULL terms and NULL texts find nothing; the empty term finds every text. Terms that are no valid
    expression raise an error, as one of them does in ``product_search``. Repeated terms count once.
    """
    asked = terms.select(F.col("term").cast("string").alias("term")).filter("term is not null").distinct()
    numbers = asked.filter(_is_number(F.col("term"))).select("term", F.trim(F.col("term")).alias("t"))
    as_id = F.concat(F.when(F.regexp_extract("t", "^-*", 0) == "-", F.lit("-")).otherwise(F.lit("")), F.regexp_extract("t", "^-*0*([0-9]+)$", 1))
    by_id = numbers.filter(F.col("t").rlike("^-?[0-9]+$")).select("term", F.when(as_id == "-0", F.lit("0")).otherwise(as_id).alias("ProductID")) \
                   .join(products.select("ProductID").distinct().hint("merge"), "ProductID").select("term", "ProductID")

    # the optimizer does not count the rows that an explode makes: exploded tables are merged, never broadcast
    by_product = catalogue_texts(products, fields)
    texts = by_product.select("text").distinct()
    grams = texts.select("text", F.explode(_grams(_folded(F.col("text")))).alias("gram"))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    words = asked.filter(~_is_number(F.col("term")))
    needed = words.select("term", F.posexplode(_needed_grams(_literal_runs(F.col("term")))).alias("branch", "grams")).select("term", "branch", F.explode("grams").alias("gram"))
    # an n-gram that no text has is the rarest of all, and fetches nothing
    rarest = needed.join(spread, "gram", "left").groupBy("term", "branch").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    keys = rarest.select("term", F.col("r.gram").alias("gram")).distinct()
    found = keys.join(grams.hint("merge"), "gram").filter(F.expr("text rlike concat('(?i)', term)")).select("term", "text").distinct()
    return found.join(by_product.hint("merge"), "text").select("term", "ProductID").unionByName(by_id).distinct()
