"""Persona-routed, stock-filtered top-N recommendations for every client in one batch.

Every candidate is a row (client, tier, pos, product): tier 0 = the route's primary list
(in its order, after the stock filter), tier 1 = the fallback pool (popular then trending,
stock-filtered, first occurrence). The final list keeps each product's first occurrence
and takes the first N by (tier, pos). A client needing backfill has m < N primary items,
and at most m of the first N distinct pool items can repeat them, so the first N distinct
stocked pool items per country always suffice: the pool is per country (bounded), never
per client × catalogue.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.operators.numeric import materialize, top_k
from shopsignal.operators.sequences import GLOBAL

STATIC_PERSONAS = [K.NO_TRANSACTIONS, "No Transactions (New)", K.VERY_FREQUENT]
ANY_COUNTRY = "\u0000any"   # stock region of clients without a clean sale: stock anywhere


def route_column(persona=None):
    """Routing order of the original conductor: static, inactive, loyal/top, mid-freq blend, fallback."""
    persona = F.col("Persona") if persona is None else persona
    return (F.when(persona.isin(*STATIC_PERSONAS), "static")
             .when(persona.contains("Inactive"), "inactive")
             .when(persona.contains("Loyal") | persona.contains("Top"), "loyal")
             .when(persona.contains("Mid Freq"), "blend")
             .otherwise("fallback"))


def available_products(stocks: DataFrame) -> DataFrame:
    """(Region, ProductID) in stock. A client's region is its country when it has a clean sale,
    else ANY_COUNTRY: the set per client is this relation joined on the region, never stored."""
    # exploded, not two scans and a union: stock that lies by product is not exchanged
    regions = F.explode(F.array("StoreCountry", F.lit(ANY_COUNTRY)))
    return stocks.filter(F.col("Quantity") > 0).select(regions.alias("Region"), "ProductID").distinct()


def client_context(persona_df: DataFrame, last: DataFrame, route_overrides: dict | None = None) -> DataFrame:
    """Per client: persona, route, stock region and last purchase (product, family).

    ``route_overrides`` maps persona names to a route ("static", "inactive", "loyal",
    "blend", "fallback"), e.g. to send mid-frequency personas to the blend route.
    """
    ctx = persona_df.select("ClientID", "Persona").join(last, "ClientID", "left")
    region = F.when(F.col("LastDate").isNotNull(), F.col("LastClientCountry")).otherwise(F.lit(ANY_COUNTRY))
    route = route_column()
    if route_overrides:
        m = F.create_map(*[F.lit(x) for kv in route_overrides.items() for x in kv])
        route = F.coalesce(m[F.col("Persona")], route)
    return ctx.withColumn("Region", region).withColumn("Route", route)


def pool_by_region(popular: DataFrame, trending: DataFrame, stock_regions: DataFrame, n: int) -> DataFrame:
    """First n distinct stocked products of popular-then-trending, per stock region."""
    pool = (popular.select("ProductID", (F.col("Rank")).alias("pos"))
            .unionByName(trending.select("ProductID", (F.col("Rank") + 1_000_000).alias("pos"))))
    stocked = pool.join(only_listed(stock_regions, pool), "ProductID")
    first = stocked.groupBy("Region", "ProductID").agg(F.min("pos").alias("pos"))
    return top_k(first, ["Region"], [F.col("pos"), F.col("ProductID")], n, rank_col="_pr").drop("_pr")


def only_listed(stock_regions: DataFrame, lists: DataFrame) -> DataFrame:
    """The stock of listed products: the semi-join goes below the distinct of the regions, so other products are never multiplied
    or exchanged."""
    return stock_regions.join(lists.select("ProductID").distinct(), "ProductID", "left_semi")


def finalize(primary: DataFrame, ctx: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """primary: (ClientID, pos, ProductID) already stock-filtered. Dedupe first-wins,
    backfill from the region pool, keep n."""
    tier0 = primary.select("ClientID", F.lit(0).alias("tier"), "pos", "ProductID")
    # the pool has at most n rows per stock region (a country): a proven bound, broadcast it
    tier1 = (ctx.select("ClientID", "Region").join(F.broadcast(pool), "Region")
                .select("ClientID", F.lit(1).alias("tier"), "pos", "ProductID"))
    cand = tier0.unionByName(tier1)
    first = cand.groupBy("ClientID", "ProductID").agg(F.min(F.struct("tier", "pos")).alias("_o"))
    ranked = top_k(first, ["ClientID"], [F.col("_o.tier"), F.col("_o.pos"), F.col("ProductID")], n)
    return ranked.select("ClientID", "Rank", "ProductID")


def _stock_filter(cands: DataFrame, ctx: DataFrame, stock_regions: DataFrame) -> DataFrame:
    """Keep candidates in stock in the client's region (order-preserving semi-join)."""
    with_region = cands.join(ctx.select("ClientID", "Region"), "ClientID")
    return with_region.join(stock_regions, ["Region", "ProductID"], "left_semi").drop("Region")


def stocked_lists(lists: DataFrame, key: str, stock_regions: DataFrame, n: int) -> DataFrame:
    """First ``n`` stocked products of each key's list (key, pos, ProductID) per stock region.

    A list's products are distinct and a client is shown n, so n per (region, key) are enough;
    clients join these short lists, never a whole rule or product list.
    """
    stocked = lists.join(only_listed(stock_regions, lists), "ProductID").select("Region", key, "pos", "ProductID")
    return top_k(stocked, ["Region", key], [F.col("pos"), F.col("ProductID")], n, rank_col="_of").drop("_of")


def inactive_primary(ctx: DataFrame, popular: DataFrame, stock_regions: DataFrame, n: int) -> DataFrame:
    lists = stocked_lists(popular.filter(F.col("FamilyLevel2").isNotNull()).select("FamilyLevel2", F.col("Rank").alias("pos"), "ProductID"),
                          "FamilyLevel2", stock_regions, n)
    c = ctx.filter(F.col("Route") == "inactive").select("ClientID", "Region", F.col("LastFamilyLevel2").alias("FamilyLevel2"))
    return c.join(lists, ["Region", "FamilyLevel2"]).select("ClientID", "pos", "ProductID")


def _rule_lists(rules: DataFrame) -> DataFrame:
    """Consequents per antecedent in rule order (lift desc, consequent) with a position."""
    from pyspark.sql import Window
    w = Window.partitionBy("antecedent").orderBy(F.round("lift", 6).desc(), F.col("consequent"))
    # the window runs on the (small) rule table: one row per frequent ordered pair
    return rules.withColumn("pos", F.row_number().over(w)).select("antecedent", "pos", F.col("consequent").alias("ProductID"))


def loyal_primary(ctx: DataFrame, rules: DataFrame, stock_regions: DataFrame, n: int) -> DataFrame:
    lists = stocked_lists(_rule_lists(rules), "antecedent", stock_regions, n)
    c = ctx.filter(F.col("Route") == "loyal").select("ClientID", "Region", F.col("LastProductID").alias("antecedent"))
    return c.join(lists, ["Region", "antecedent"]).select("ClientID", "pos", "ProductID")


def recommendations(persona_df: DataFrame, last: DataFrame, popular: DataFrame, trending: DataFrame,
                    rules: DataFrame, stocks: DataFrame, top_n: int = 5, route_overrides: dict | None = None,
                    similar: DataFrame | None = None, markov_top: DataFrame | None = None,
                    routes: Sequence[str] | None = None) -> DataFrame:
    """All clients, routed by persona: static / inactive / loyal / fallback. The blend route
    is not reachable with the persona names; ``route_overrides`` can send personas to it, in
    which case ``similar`` and ``markov_top`` supply its Prod2Vec and Markov lists. With ``routes`` the clients of
    those routes alone; lists that none of them is shown are not made."""
    ctx = client_context(persona_df, last, route_overrides)
    if routes is not None:
        ctx = ctx.filter(F.col("Route").isin(*routes))
    # one row per client, read by every route and the backfill: written once
    ctx = materialize(ctx, "clients")
    regions = available_products(stocks)
    pool = pool_by_region(popular, trending, regions, top_n)
    primary = ctx.select("ClientID", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("ProductID")).limit(0)
    asked = lambda route: routes is None or route in routes
    if asked("inactive"):
        primary = primary.unionByName(inactive_primary(ctx, popular, regions, top_n))
    if asked("loyal"):
        primary = primary.unionByName(loyal_primary(ctx, rules, regions, top_n))
    if asked("blend") and route_overrides and "blend" in route_overrides.values():
        primary = primary.unionByName(blend_primary(ctx, similar, markov_top, popular, rules, regions, n=top_n))
    recs = finalize(primary, ctx, pool, top_n)
    return recs.join(ctx.select("ClientID", "Persona", "Route"), "ClientID")


def blend_primary(ctx: DataFrame, similar: DataFrame | None, markov_top: DataFrame | None, popular: DataFrame,
                  rules: DataFrame, regions: DataFrame, k: int = 10, n: int = 5, strict: bool = False) -> DataFrame:
    """Blend-route primary list: interleave Prod2Vec[i], Markov[i], Assoc[i] (each
    stock-filtered, then renumbered). Markov predicts families; each predicted family is
    expanded to its best stocked popular product in the client's region. ``strict`` takes predicted
    families for product ids, as the original does, so that they contribute nothing. A client is shown
    ``n``, so the first ``n`` stocked consequents of a rule list are enough."""
    from pyspark.sql import Window
    mid = ctx.filter(F.col("Route") == "blend")
    sources = []
    if similar is not None:
        sources.append(mid.select("ClientID", F.col("LastProductID").alias("ProductID0"))
                       .join(similar.filter(F.col("Rank") <= k).select(F.col("ProductID").alias("ProductID0"),
                                                                       F.col("SimilarProductID").alias("ProductID"),
                                                                       F.col("Rank").alias("pos")), "ProductID0")
                       .select("ClientID", "pos", "ProductID"))
    else:
        sources.append(None)
    if markov_top is not None and not strict:
        fam_best = popular.select("FamilyLevel2", "ProductID", F.col("Rank").alias("_prank"))
        # a country without a row for the state falls back to the Global matrix, if it is given
        top = markov_top.filter(F.col("Rank") <= k).select("Country", "State", "NextState", F.col("Rank").alias("pos"))
        known = top.select("Country", "State").distinct().withColumn("_known", F.lit(True))
        asked = (mid.select("ClientID", "Region", F.col("LastClientCountry").alias("Country"), F.col("LastFamilyLevel2").alias("State"))
                    .join(known, ["Country", "State"], "left")
                    .withColumn("Country", F.when(F.col("_known"), F.col("Country")).otherwise(F.lit(GLOBAL))).drop("_known"))
        mk = (asked.join(top, ["Country", "State"])
                 .join(fam_best, F.col("NextState") == F.col("FamilyLevel2"))
                 .join(regions, ["Region", "ProductID"], "left_semi"))
        sources.append(mk.groupBy("ClientID", "pos").agg(F.min_by("ProductID", F.col("_prank")).alias("ProductID")))
    else:
        sources.append(None)
    lists = stocked_lists(_rule_lists(rules), "antecedent", regions, n)
    sources.append(mid.select("ClientID", "Region", F.col("LastProductID").alias("antecedent"))
                   .join(lists, ["Region", "antecedent"]).select("ClientID", "pos", "ProductID"))
    parts = []
    for order, src in enumerate(sources):
        if src is None:
            continue
        kept = _stock_filter(src, mid, regions)
        w = Window.partitionBy("ClientID").orderBy("pos", "ProductID")
        # per-client lists are bounded (≤ k, or ≤ n rules)
        parts.append(kept.withColumn("_i", F.row_number().over(w)).select(
            "ClientID", (F.col("_i") * 10 + order).alias("pos"), "ProductID"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recs_blend(ctx: DataFrame, similar: DataFrame, markov_top: DataFrame, popular: DataFrame,
               rules: DataFrame, stocks: DataFrame, top_n: int = 5, k: int = 10,
               trending: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The blend route for every mid-frequency persona (what the route would return if the
    routing reached it), backfilled from the pool."""
    mid = materialize(ctx.filter(F.col("Persona").contains("Mid Freq")).withColumn("Route", F.lit("blend")), "clients")
    regions = available_products(stocks)
    pool = pool_by_region(popular, trending if trending is not None else popular.limit(0), regions, top_n)
    primary = blend_primary(mid, similar, markov_top, popular, rules, regions, k, top_n, strict)
    recs = finalize(primary, mid, pool, top_n)
    return recs.join(mid.select("ClientID", "Persona"), "ClientID")


def recs_enriched(recs: DataFrame, products: DataFrame, clients: DataFrame, stocks: DataFrame) -> DataFrame:
    """Rank, product details (defaults when unknown) and stock units in the client's own country
    (of the client table, so clients without a sale have one too)."""
    info = products.select("ProductID", F.col("FamilyLevel2").alias("Product"), "Category",
                           F.col("FamilyLevel1").alias("SportFamily"), F.col("Universe").alias("Gender"))
    stock = stocks.groupBy("StoreCountry", "ProductID").agg(F.sum("Quantity").alias("_q"))
    out = (recs.join(info, "ProductID", "left")
               .join(clients.select("ClientID", F.col("ClientCountry").alias("StoreCountry")), "ClientID", "left")
               .join(stock, ["StoreCountry", "ProductID"], "left"))
    return out.select("ClientID", "Rank", "ProductID",
                      F.coalesce("Product", F.lit("Unknown")).alias("Product"),
                      F.coalesce("Category", F.lit("N/A")).alias("Category"),
                      F.coalesce("SportFamily", F.lit("N/A")).alias("SportFamily"),
                      F.coalesce("Gender", F.lit("N/A")).alias("Gender"),
                      F.coalesce("_q", F.lit(0)).cast("bigint").alias("Stock"))
