"""The query catalog: one DataFrame per operator of the inventory, over whole tables.

Every output is normalised the same way as its SQL oracle: timestamps as
'yyyy-MM-dd HH:mm:ss' text, decimals as DOUBLE, doubles rounded to 6 places.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsignal.functions import constants as K
from shopsignal.operators import audiences, bi, baskets, calendar, customers, features, products, quarantine, recommend, sequences, similarity, sketches, targeting, term_search
from shopsignal.operators.features import AMOUNT, DATE
from shopsignal.functions.scalar import round6
from shopsignal.operators.numeric import materialize, shared_folder
from shopsignal.plans.context import Ctx, context
from shopsignal.plans import storage
from shopsignal.sources import csv_files

ROW_KEY = ["BasketID", "LineNo", "ClientID", "ProductID", "StoreID", AMOUNT, "Quantity"]

QUERIES: dict[str, Callable[[Ctx], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = round6(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def build_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(QUERIES[name](context(spark, sf_dir)))


# ---------------------------------------------------------------- A. scans / sources
@query("load_transactions")
def q_load_transactions(x: Ctx):
    return x.t.transactions


@query("dataset_metadata")
def q_dataset_metadata(x: Ctx):
    return bi.dataset_metadata(x.master, x.clients, x.products)


@query("persona_samples")
def q_persona_samples(x: Ctx):
    return bi.persona_samples(x.persona_enriched)


# ---------------------------------------------------------------- B. cleaning / features
@query("dedup_transactions")
def q_dedup(x: Ctx):
    from shopsignal.operators.cleaning import dedup_transactions
    return dedup_transactions(x.t.transactions)


@query("valid_transactions")
def q_valid(x: Ctx):
    from shopsignal.operators.cleaning import valid_transactions
    return valid_transactions(x.t.transactions)


@query("clean_products")
def q_clean_products(x: Ctx):
    return x.products


@query("clean_clients")
def q_clean_clients(x: Ctx):
    return x.clients.select("ClientID", "ClientSegment", "ClientCountry", "ClientGender",
                            "HasEmail", "HasPhone", "HasContact")


@query("master_join")
def q_master_join(x: Ctx):
    return x.master.select(*ROW_KEY, DATE, *features.PRODUCT_COLS[1:], *features.CLIENT_COLS[1:], "StoreCountry")


@query("calendar_features")
def q_calendar(x: Ctx):
    return x.master.select(*ROW_KEY, "Year", "Month", "Quarter", "DayOfWeek", "DayOfMonth", "IsWeekend", "Season",
                           "IsWinter", "IsSpring", "IsSummer", "IsFall", "IsQ1", "IsQ2", "IsQ3", "IsQ4")


@query("retail_events")
def q_events(x: Ctx):
    return x.master.select(*ROW_KEY, "IsBlackFriday", "IsCyberMonday", "IsChristmasSeason", "IsNewYearSeason",
                           "IsBackToSchool", "IsSummerSale", "IsHoliday")


@query("sporting_events")
def q_sporting(x: Ctx):
    return x.master.select(*ROW_KEY, "IsMajorSportingEvent")


#: the fixed calendar with the fixture's country names instead of codes, so that limited events fire
FIXTURE_COUNTRIES = {"FR": "NATION_6", "DE": "NATION_7", "GB": "NATION_23", "UK": "NATION_23", "US": "NATION_24"}


@query("sporting_events_named")
def q_sporting_named(x: Ctx):
    events = [(a, b, [FIXTURE_COUNTRIES.get(c, c) for c in cs]) for a, b, cs in K.SPORTING_EVENTS]
    return x.master.withColumn("IsMajorSportingEvent", features.sporting_event_flag(events)).select(
        *ROW_KEY, "ClientCountry", "IsMajorSportingEvent")


def fixture_calendar(x: Ctx) -> DataFrame:
    """The ``events`` table as an event calendar: one event a row, up to 23 days long, for two nations or for all."""
    e = x.spark.read.parquet(f"{x.sf_dir.rstrip('/')}/events.parquet").select("event_id", "user_id", "event_type")
    hours = F.col("event_id") * 37 % 57_000
    nation = lambda k: F.concat(F.lit("NATION_"), (F.col("user_id") * k % 25).cast("string"))
    start = F.lit("2018-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours.cast("int"))
    return e.select(F.col("event_id").cast("long").alias("EventID"), start.alias("start"),
                    (start + F.make_dt_interval((F.col("user_id") % 24).cast("int"), F.lit(5))).alias("end"),
                    F.when(F.col("event_type") == "error", F.array(F.lit("All"), nation(1))).otherwise(F.array(nation(1), nation(7))).alias("countries"))


@query("calendar_events")
def q_calendar_events(x: Ctx):
    """Sales against a calendar table of thousands of events."""
    return calendar.add_calendar_events(x.master.select(*ROW_KEY, DATE, "ClientCountry"), fixture_calendar(x)).select(
        *ROW_KEY, "ClientCountry", "Events", "FirstEvent", "IsMajorSportingEvent")


@query("price_features")
def q_price(x: Ctx):
    return features.add_price_features(x.master).select(
        *ROW_KEY, "PricePerUnit", "AvgPricePerUnit", "IsPotentialDiscount", "DiscountPercentage", "IsPremiumPurchase")


@query("bulk_purchases")
def q_bulk(x: Ctx):
    return features.add_price_features(x.master).select(*ROW_KEY, "TypicalQuantity", "IsBulkPurchase")


@query("cross_border")
def q_cross_border(x: Ctx):
    return features.add_cross_border(x.master).select(*ROW_KEY, "IsCrossBorder", "IsLocalPurchase")


@query("days_since_last")
def q_days_since_last(x: Ctx):
    return features.add_days_since_last(x.master.select(*ROW_KEY, DATE)).select(*ROW_KEY, DATE, "DaysSinceLastPurchase")


@query("pareto_revenue")
def q_pareto(x: Ctx):
    return features.add_pareto(x.master.select(*ROW_KEY, DATE)).select(
        *ROW_KEY, "CumulativeRevenue", "IsTop20PercentRevenue")


@query("trend_noise_filter")
def q_noise(x: Ctx):
    return products.noise_filter(x.master).select(*ROW_KEY, "PricePerUnit")


@query("final_features")
def q_final_features(x: Ctx):
    return bi.final_features(x.master, x.rfm).select(
        *ROW_KEY, "Recency", "Frequency", "RFM_Score", "IsAtRisk", "ProductTotalRevenue", "ProductSalesVelocity",
        "IsTopProduct", "FavoriteCategory", "IsFavoriteCategory", "IsCrossSellOpportunity")


# ---------------------------------------------------------------- D. customers
@query("rfm_base")
def q_rfm_base(x: Ctx):
    return customers.rfm_base(x.master)


@query("rfm_scores")
def q_rfm_scores(x: Ctx):
    return x.rfm.select("ClientID", "Recency", "Frequency", "TotalSpent", "RecencyScore", "FrequencyScore",
                        "MonetaryScore", "RFM_Score")


@query("rfm_segments")
def q_rfm_segments(x: Ctx):
    return x.rfm.select("ClientID", "CustomerLifetimeDays", "PriceVolatility", "IsHighValue", "IsFrequentBuyer",
                        "IsRecentBuyer", "IsAtRisk")


@query("favorite_category")
def q_favorite(x: Ctx):
    return customers.favorite_category(x.master)


@query("personas")
def q_personas(x: Ctx):
    return x.personas.select("ClientID", "ClientSegment", "ClientCountry", "TransactionCount", "Persona")


@query("persona_distribution")
def q_persona_dist(x: Ctx):
    return customers.persona_distribution(x.personas)


@query("persona_enriched")
def q_persona_enriched(x: Ctx):
    return x.persona_enriched.select("ClientID", "Persona", "TransactionCount", "TotalSpent", "LastDate",
                                            "TotalUnits", "Recency", "FavoriteCategory", "AvgOrderValue")


@query("affinity_matrix")
def q_affinity(x: Ctx):
    return customers.affinity_matrix(x.master).select(
        "ClientID", "FamilyLevel1", "CategorySpend", "PurchaseCount", "TotalSpend", "DaysSinceLastPurchase",
        "ShareOfWallet", "AffinityScore")


@query("propensity_family")
def q_propensity(x: Ctx):
    return customers.propensity(customers.affinity_matrix(x.master)).select(
        "ClientID", "FamilyLevel1", "TotalSpend", "DaysSinceLastPurchase", "PropensityScore")


@query("propensity_country")
def q_propensity_country(x: Ctx):
    return customers.propensity(customers.affinity_matrix(x.master, by_country=True)).select(
        "StoreCountry", "ClientID", "FamilyLevel1", "TotalSpend", "DaysSinceLastPurchase", "PropensityScore")


@query("propensity_cross_sell")
def q_cross_sell(x: Ctx):
    """The whole list of every product (``customers.cross_sell_campaign`` gives the best clients of each alone)."""
    return customers.propensity_cross_sell(x.master, x.products, x.products).select("ProductID", "ClientID", "PropensityScore", "DaysSinceLastPurchase")


@query("propensity_cross_sell_search")
def q_cross_sell_search(x: Ctx):
    """Whole lists for the products that the search finds."""
    targets = targeting.product_search(x.t.products, SEARCH_TERM)
    return customers.propensity_cross_sell(x.master, x.products, targets).select("ProductID", "ClientID", "PropensityScore", "DaysSinceLastPurchase")


@query("propensity_cross_sell_country")
def q_cross_sell_country(x: Ctx):
    """A campaign for the products that the search finds: the target table is a parameter."""
    targets = targeting.product_search(x.t.products, SEARCH_TERM)
    return customers.propensity_cross_sell_country(x.master, x.products, targets).select(
        "StoreCountry", "ProductID", "ClientID", "PropensityScore", "DaysSinceLastPurchase")


@query("last_purchase")
def q_last(x: Ctx):
    return x.last


# ---------------------------------------------------------------- D/E. products
@query("product_features")
def q_product_features(x: Ctx):
    return products.product_features(x.master)


@query("product_tiers")
def q_product_tiers(x: Ctx):
    return products.product_tiers(products.product_features(x.master)).select(
        "ProductID", "ProductTotalRevenue", "ProductSalesVelocity", "IsTopProduct", "IsFastMover")


@query("trending_scores")
def q_trending(x: Ctx):
    return x.trend_scores.select("StoreID", "StoreCountry", "ProductID", "recent_score", "seasonal_score",
                                 "FamilyLevel1", "PricePerUnit", "FinalScore")


@query("global_trends")
def q_global_trends(x: Ctx):
    return x.popular.select("ProductID", "FinalScore", "FamilyLevel2", "Rank")


@query("store_trending_recs")
def q_store_trending(x: Ctx):
    return products.store_trending_recs(x.trend_scores, x.t.stores).select(
        "StoreID", "TargetCountry", "Source", "Rank", "ProductID", F.col("FamilyLevel1").alias("Family"),
        F.col("PricePerUnit").alias("Price"), F.col("FinalScore").alias("Score"))


@query("approx_quantiles")
def q_approx_quantiles(x: Ctx):
    """Sketched quantiles of sales, merged from one sketch a country, with their measured rank error against the bound (twice the
    published one, which holds 99% of the time)."""
    sales = x.master.select("StoreCountry", F.col(AMOUNT).cast("double").alias("Amount"), F.col("Quantity").cast("double").alias("Quantity"))
    ps = [0.1, 0.2, 0.4, 0.5, 0.6, 0.8, 0.99]
    whole = sketches.merged(sketches.sketches(sales, ["StoreCountry"], ["Amount", "Quantity"]), [], ["Amount", "Quantity"])
    row = whole.select(*[sketches.quantiles(c, ps).alias(c) for c in whole.columns]).first()
    found = {c: dict(zip(ps, row[c])) for c in whole.columns if row[c] is not None}
    errors = sketches.measured_rank_errors(sales, found)
    return errors.select("Column", "P", "Rows", (F.col("RankError") <= 2 * sketches.rank_error()).alias("WithinBound"))


@query("product_catalog")
def q_product_catalog(x: Ctx):
    return bi.product_catalog(x.master)


# ---------------------------------------------------------------- D/H. baskets
@query("baskets")
def q_baskets(x: Ctx):
    return bi.basket_summary(x.master)


@query("assoc_rules_family")
def q_rules_family(x: Ctx):
    return x.rules_family


@query("assoc_rules_product")
def q_rules_product(x: Ctx):
    return x.rules_product


@query("assoc_rules_product_min2")
def q_rules_product_min2(x: Ctx):
    return baskets.association_rules(x.master, "ProductID", min_count=2)


@query("assoc_rules_fp_growth")
def q_rules_fp_growth(x: Ctx):
    """The same rules by another method."""
    return baskets.rules_by_pattern_growth(x.master, "ProductID", min_count=2)


@query("rule_targets")
def q_rule_targets(x: Ctx):
    return baskets.rule_targets(baskets.association_rules(x.master, "ProductID", min_count=2))


@query("bundles_wide")
def q_bundles_wide(x: Ctx):
    return baskets.bundles_wide(x.rules_family)


@query("bundle_products")
def q_bundle_products(x: Ctx):
    return baskets.bundle_products(x.rules_family, x.t.products, x.t.stocks)


@query("store_top_products")
def q_store_top(x: Ctx):
    return baskets.store_top_products(x.master)


@query("store_bundles")
def q_store_bundles(x: Ctx):
    return baskets.store_bundles(x.master, x.rules_family).select(
        "StoreID", "Rank", "antecedent", "consequent", "lift", "confidence")


@query("client_cross_sell")
def q_client_cross_sell(x: Ctx):
    return baskets.client_cross_sell(x.last, x.rules_family, x.master, x.t.stocks, x.clients)


# ---------------------------------------------------------------- D/E/F. sequences
@query("markov_transitions")
def q_markov(x: Ctx):
    return x.markov


@query("markov_topk")
def q_markov_topk(x: Ctx):
    return sequences.markov_topk(x.markov)


@query("client_sequences")
def q_sequences(x: Ctx):
    return x.sequences.select("ClientID", "Position", "ProductID")


@query("prod2vec_vocab")
def q_vocab(x: Ctx):
    return sequences.vocabulary(x.sequences)


@query("prod2vec_vectors")
def q_vectors(x: Ctx):
    return x.embeddings.select("ProductID", F.size("embedding").alias("dim"),
                               F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v).alias("sq_norm"))


def fixture_vectors(x: Ctx) -> DataFrame:
    """The embeddings table as product vectors: vec_id is the ProductID."""
    emb = x.spark.read.parquet(f"{x.sf_dir.rstrip('/')}/embeddings.parquet")
    return emb.select(F.col("vec_id").cast("string").alias("ProductID"), F.col("embedding").cast("array<double>").alias("embedding"))


@query("prod2vec_lookup")
def q_lookup(x: Ctx):
    return sequences.embedding_lookup(x.products, fixture_vectors(x), 64).select(
        "ProductID", "known", F.size("embedding").alias("dim"), F.get("embedding", F.lit(0)).alias("first"))


@query("prod2vec_lookup_vectors")
def q_lookup_vectors(x: Ctx):
    """Whole vectors, a row per component; zeros for products outside the vocabulary."""
    return sequences.embedding_lookup(x.products, fixture_vectors(x), 64).select("ProductID", "known", F.posexplode("embedding").alias("Component", "Value"))


@query("prod2vec_quality")
def q_vector_quality(x: Ctx):
    """Invariants of the trained vectors: one for each product of the vocabulary, of 32 finite components, none of them all zeros."""
    v = x.embeddings
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e6))
    vocabulary = sequences.vocabulary(x.sequences)
    return v.agg(F.count(F.lit(1)).alias("Vectors"), F.countDistinct("ProductID").alias("Products"), F.min(F.size("embedding")).alias("LeastDim"),
                 F.max(F.size("embedding")).alias("MostDim"), F.count_if(~finite).alias("NotFinite"), F.count_if(F.forall("embedding", lambda c: c == 0)).alias("Zero")) \
        .withColumn("OutsideVocabulary", v.join(vocabulary, "ProductID", "left_anti").agg(F.count(F.lit(1))).scalar())


@query("similar_products")
def q_similar(x: Ctx):
    return sequences.similar_products(fixture_vectors(x), 5)


@query("similar_products_lsh")
def q_similar_lsh(x: Ctx):
    """By hashing at any size: at least four signs, though on a table this small every pair would be cheaper."""
    return similarity.similar_by_hash(fixture_vectors(x), 5, min_bits=4)


@query("similar_products_lsh_quality")
def q_similar_lsh_quality(x: Ctx):
    vectors = fixture_vectors(x)
    found = similarity.neighbour_recall(similarity.similar_by_hash(vectors, 5, min_bits=4), sequences.similar_products(vectors, 5))
    return found.select("Products", "Covered", (F.col("Recall") >= 0.9).alias("RecallReached"))


@query("markov_global")
def q_markov_global(x: Ctx):
    return x.markov_global


@query("cosine_topk")
def q_cosine(x: Ctx):
    emb = x.spark.read.parquet(f"{x.sf_dir.rstrip('/')}/embeddings.parquet")
    return sequences.cosine_topk(emb, "vec_id", "embedding", 5).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("neighbor_vec_id").cast("bigint").alias("neighbor_id"),
        "similarity", "Rank")


# ---------------------------------------------------------------- G. recommendations
def _recs(x: Ctx, routes: list[str] | None = None) -> DataFrame:
    return recommend.recommendations(x.personas, x.last, x.popular, x.trending, x.rules_product, x.t.stocks, routes=routes)


@query("recommendations")
def q_recommendations(x: Ctx):
    return _recs(x).select("ClientID", "Persona", "Route", "Rank", "ProductID")


@query("available_product_set")
def q_available_set(x: Ctx):
    """The set itself: what clients of a region can be shown; ANY for clients without a sale."""
    regions = recommend.available_products(x.t.stocks)
    return regions.select(F.when(F.col("Region") == recommend.ANY_COUNTRY, "ANY").otherwise(F.col("Region")).alias("Region"), "ProductID").distinct()


@query("available_products")
def q_available(x: Ctx):
    regions = recommend.available_products(x.t.stocks)
    return regions.groupBy("Region").agg(F.count(F.lit(1)).alias("n_products")).select(
        F.when(F.col("Region") == recommend.ANY_COUNTRY, "ANY").otherwise(F.col("Region")).alias("Region"), "n_products")


@query("recs_static")
def q_recs_static(x: Ctx):
    return _recs(x, ["static", "fallback"]).select("ClientID", "Persona", "Rank", "ProductID")


@query("recs_inactive")
def q_recs_inactive(x: Ctx):
    return _recs(x).filter(F.col("Route") == "inactive").select("ClientID", "Persona", "Rank", "ProductID")


@query("recs_loyal")
def q_recs_loyal(x: Ctx):
    return _recs(x).filter(F.col("Route") == "loyal").select("ClientID", "Persona", "Rank", "ProductID")


@query("recs_blend")
def q_recs_blend(x: Ctx):
    ctx = recommend.client_context(x.personas, x.last)
    mid_last = ctx.filter(F.col("Persona").contains("Mid Freq")).select(F.col("LastProductID").alias("ProductID"))
    sim = sequences.similar_products(fixture_vectors(x), 10, queries=mid_last)
    markov = sequences.markov_topk(x.markov.unionByName(x.markov_global), 10)
    return recommend.recs_blend(ctx, sim, markov, x.popular, x.rules_product, x.t.stocks, trending=x.trending).select(
        "ClientID", "Persona", "Rank", "ProductID")


@query("recommendation_cards")
def q_cards(x: Ctx):
    return bi.recommendation_cards(_recs(x), x.view(bi.first_rows(x.clean)))


@query("recs_enriched")
def q_recs_enriched(x: Ctx):
    return recommend.recs_enriched(_recs(x), x.t.products, x.clients, x.t.stocks)


# ---------------------------------------------------------------- H. targeting
SEARCH_TERM = "ring"   # catalog search parameter of the registered search queries


def _matches(x: Ctx):
    return targeting.product_search(x.t.products, SEARCH_TERM)


@query("product_search")
def q_product_search(x: Ctx):
    return _matches(x)


@query("product_search_id")
def q_product_search_id(x: Ctx):
    return targeting.product_search(x.t.products, " 42 ")


def fixture_terms(x: Ctx) -> DataFrame:
    """Search terms made of the catalogue: words, two-letter and anchored ones, expressions, brands, types and product numbers."""
    p = x.t.products
    w = p.select(F.explode(F.split("FamilyLevel2", " ")).alias("w")).distinct()
    forms = F.array(F.col("w"), F.left("w", F.lit(2)), F.concat(F.lit("^"), "w"), F.concat(F.left("w", F.lit(1)), F.lit(".*"), F.right("w", F.lit(2))),
                    F.concat(F.left("w", F.lit(2)), F.lit("?"), F.substring("w", 3, 99)), F.concat(F.lit("(zz|"), "w", F.lit(")+$")),
                    F.concat(F.lit("["), F.left("w", F.lit(1)), F.lit("X]"), F.substring("w", 2, 99)), F.concat("w", F.lit("|PROMO|^Brand#1.$")))
    words = w.select(F.explode(forms).alias("term"))
    values = p.select(F.explode(F.array("Category", "FamilyLevel1", F.concat(F.lit(" "), "ProductID", F.lit(" ")))).alias("term")).distinct()
    return words.unionByName(values)


@query("search_terms")
def q_search_terms(x: Ctx):
    return term_search.search_terms(x.t.products, fixture_terms(x))


@query("search_audience")
def q_search_audience(x: Ctx):
    return targeting.audience_size(_matches(x), targeting.buyers_by_family(x.master), _client_feats(x))


@query("buyers_by_family")
def q_buyers(x: Ctx):
    return targeting.buyers_by_family(x.master)


@query("search_targets_simple")
def q_search_simple(x: Ctx):
    m = targeting.product_search(x.t.products, SEARCH_TERM, fields=("FamilyLevel2", "Category"))
    return targeting.search_targets_simple(m, x.master, x.personas)


def _client_feats(x: Ctx):
    return customers.client_features(x.persona_enriched, x.rfm)


@query("search_targets")
def q_search_targets(x: Ctx):
    t = targeting.search_targets(_matches(x), targeting.buyers_by_family(x.master), _client_feats(x))
    return t.select("ClientID", "Persona", "TransactionCount", "TotalSpent", "Recency", "RFM_Score",
                    "FavoriteCategory", "TargetScore", "Rank")


@query("search_target_personas")
def q_search_personas(x: Ctx):
    return targeting.search_target_personas(_matches(x), targeting.buyers_by_family(x.master), _client_feats(x))


@query("reverse_rule_targets")
def q_reverse_rules(x: Ctx):
    rules = materialize(baskets.association_rules(x.master, "ProductID", min_count=2), "rules")      # read twice
    return targeting.reverse_rule_targets(rules, x.master, x.personas)


def _index_bits(x: Ctx) -> DataFrame:
    return audiences.buyer_bitmaps(targeting.buyers_by_family(x.master), ["Kind", "Key"], audiences.number_clients(x.clients))


@query("buyer_counts")
def q_buyer_counts(x: Ctx):
    return audiences.sizes(_index_bits(x), ["Kind", "Key"], "Buyers")


@query("search_audiences")
def q_search_audiences(x: Ctx):
    return audiences.search_audiences(term_search.search_terms(x.t.products, fixture_terms(x)), x.t.products, _index_bits(x))


@query("rule_audiences")
def q_rule_audiences(x: Ctx):
    rules = materialize(baskets.association_rules(x.master, "ProductID", min_count=2), "rules")      # read several times
    return audiences.rule_audiences(rules, audiences.buyer_bitmaps(targeting.sales_under_rules(rules, x.master), ["ProductID"], audiences.number_clients(x.master)))


@query("stock_pivot")
def q_stock_pivot(x: Ctx):
    return targeting.stock_pivot(_matches(x), x.t.stocks, x.t.products)


@query("stock_pivot_wide")
def q_stock_pivot_wide(x: Ctx):
    long = targeting.stock_pivot(_matches(x), x.t.stocks, x.t.products)
    return bi.pivot_wide(long, ["ProductID", "Product"], "StoreCountry", "Quantity", bi.country_columns(x.t.stocks))


# ---------------------------------------------------------------- I. BI roll-ups
@query("kpi_headline")
def q_kpi(x: Ctx):
    return bi.kpi_headline(x.master)


@query("country_kpis")
def q_country_kpis(x: Ctx):
    return bi.country_kpis(x.master)


@query("strategy_matrix")
def q_strategy(x: Ctx):
    return bi.strategy_matrix(x.spark, x.personas)


@query("family_persona_revenue")
def q_fam_persona(x: Ctx):
    return bi.family_persona_revenue(bi.with_persona(x.master, x.personas))


def _insights(x: Ctx):
    return bi.country_insights(x.master, x.personas, x.t.stocks)


@query("country_insights")
def q_insights(x: Ctx):
    return _insights(x)


@query("store_country_insights")
def q_store_insights(x: Ctx):
    return bi.country_insights(x.master, x.personas, x.t.stocks, by="StoreCountry")


@query("country_playbook")
def q_playbook(x: Ctx):
    return bi.country_playbook(_insights(x), x.spark)


@query("persona_reach")
def q_reach(x: Ctx):
    return bi.persona_reach(bi.with_persona(x.master, x.personas))


@query("persona_advice")
def q_advice(x: Ctx):
    return bi.persona_advice(bi.persona_reach(bi.with_persona(x.master, x.personas)))


@query("revenue_by_country")
def q_rev_country(x: Ctx):
    return bi.revenue_by_country(x.master)


@query("top_categories")
def q_top_categories(x: Ctx):
    return bi.top_categories(x.master)


@query("category_country_matrix")
def q_cat_country(x: Ctx):
    return bi.category_country_matrix(x.master)


@query("category_country_wide")
def q_cat_country_wide(x: Ctx):
    return bi.pivot_wide(bi.category_country_matrix(x.master), ["Category"], "StoreCountry", "Revenue", bi.country_columns(x.t.stocks))


@query("store_metrics")
def q_store_metrics(x: Ctx):
    return bi.store_metrics(x.master)


@query("overstock")
def q_overstock(x: Ctx):
    return bi.overstock(x.t.stocks, x.t.products)


@query("stock_health")
def q_stock_health(x: Ctx):
    return bi.stock_health(x.t.stocks)


@query("country_trending")
def q_country_trending(x: Ctx):
    return bi.country_trending(x.trend_scores, x.t.products).select(
        "StoreCountry", "Source", "Rank", "ProductID", "Product", "Category", "SportFamily", "Gender",
        "FinalScore", "recent_score", "seasonal_score")


@query("client_360")
def q_client_360(x: Ctx):
    return bi.client_360(x.spark, x.persona_enriched, x.rfm)


@query("dimension_values")
def q_dims(x: Ctx):
    return bi.dimension_values(x.master, x.t.stores)


# ---------------------------------------------------------------- A. parse / materialise
@query("parse_dates")
def q_parse_dates(x: Ctx):
    """Dates of the sale view written as text with and without UTC offsets and some unparseable
    values, parsed back: offsets are dropped keeping wall time, bad text becomes NULL (quarantined)."""
    from shopsignal.sources.schemas import parse_sale_dates
    tx = x.t.transactions
    text = F.when(F.col("LineNo") % 7 == 0, F.lit("not a date")).otherwise(F.concat(
        F.date_format(DATE, "yyyy-MM-dd HH:mm:ss"),
        F.when(F.col("LineNo") % 3 == 0, "+00:00").when(F.col("LineNo") % 3 == 1, "+02:00").otherwise("")))
    parsed = parse_sale_dates(tx.withColumn(DATE, text))
    return parsed.select(*ROW_KEY, DATE, F.col(DATE).isNull().cast("int").alias("IsQuarantined"))


def _raw_text_sales(x: Ctx) -> DataFrame:
    """The sale view as a raw feed would give it: dates as text, some of them bad or missing, some amounts and quantities off."""
    tx = x.t.transactions
    n = F.col("LineNo")
    key = F.pmod(F.col("BasketID").cast("long"), F.lit(23))
    text = F.when(key == 5, F.lit(None).cast("string")).when(n == 7, F.lit("31/31/2024")).otherwise(F.date_format(DATE, "yyyy-MM-dd HH:mm:ss"))
    amount = F.when(key == 6, -F.col(AMOUNT)).when(key == 7, F.lit(None)).otherwise(F.col(AMOUNT)).cast("decimal(18,2)")
    qty = F.when(key == 8, F.lit(0)).when(key == 9, F.lit(None)).otherwise(F.col("Quantity")).cast("int")
    return tx.withColumns({"DateText": text, AMOUNT: amount, "Quantity": qty}).withColumn(DATE, F.expr("try_cast(DateText AS TIMESTAMP_NTZ)"))


@query("quarantine_counts")
def q_quarantine(x: Ctx):
    """Counters of the pass, beside what the quarantine table holds."""
    s = quarantine.split(_raw_text_sales(x), shared_folder(x.spark, "quarantine"), "DateText")
    counts = x.spark.createDataFrame([(k, v) for k, v in s.counts.items()], "Reason string, Counted long")
    stored = s.rejected.groupBy("Reason").agg(F.count(F.lit(1)).alias("Stored")).unionByName(
        s.clean.agg(F.count(F.lit(1)).alias("Stored")).withColumn("Reason", F.lit("accepted")))
    return counts.join(stored, "Reason", "left").select("Reason", "Counted", F.coalesce("Stored", F.lit(0)).alias("Stored"))


@query("quarantine_rows")
def q_quarantine_rows(x: Ctx):
    s = quarantine.split(_raw_text_sales(x), shared_folder(x.spark, "quarantine"), "DateText")
    return s.rejected.select(*ROW_KEY, "DateText", "Reason")


# ---------------------------------------------------------------- A. CSV files
def _csv_folder(x: Ctx) -> str:
    """The five retail tables as gzip CSV files, with two broken lines a store among the sales."""
    folder = shared_folder(x.spark, "retail-csv")
    t = x.t
    sales = t.transactions.select("ClientID", "ProductID", "StoreID", F.date_format(DATE, "yyyy-MM-dd HH:mm:ss").alias(DATE), AMOUNT, "Quantity", "BasketID")
    for name, df in (("transactions", sales), ("clients", t.clients), ("products", t.products), ("stores", t.stores), ("stocks", t.stocks)):
        csv_files.write_csv(df, folder, name)
    line = F.explode(F.array(F.concat("StoreID", F.lit(",too few")), F.concat(F.lit("1,2,3,4,5,6,7,8,"), "StoreID")))
    t.stores.select(line.alias(",".join(sales.columns))).write.mode("append").option("header", True).option("quote", "").option("sep", "\t") \
        .option("compression", "gzip").csv(f"{folder}/transactions")
    return folder


@query("csv_transactions")
def q_csv_transactions(x: Ctx):
    return csv_files.read_retail(x.spark, _csv_folder(x)).tables.transactions


@query("csv_broken_lines")
def q_csv_broken(x: Ctx):
    return csv_files.read_retail(x.spark, _csv_folder(x)).broken


@query("csv_clients")
def q_csv_clients(x: Ctx):
    return csv_files.read_retail(x.spark, _csv_folder(x)).tables.clients.drop("Age")


@query("csv_precomputed")
def q_csv_precomputed(x: Ctx):
    """Precomputed tables through gzip CSV files: the client cards read back, and the optional table that is not there."""
    folder = shared_folder(x.spark, "precomputed-csv")
    cards = _client_feats(x).select("ClientID", "Persona", "ClientCountry", "TransactionCount", round6("TotalSpent").alias("TotalSpent"), "Recency", "RFM_Score", "FavoriteCategory")
    csv_files.write_csv(cards, folder, "client_features")
    found = csv_files.read_precomputed(x.spark, folder, {
        "client_features": cards.schema, "country_trending": "StoreCountry string, ProductID string, FinalScore double"})
    return found["client_features"].withColumn("Trending", found["country_trending"].agg(F.count(F.lit(1))).scalar())


@query("materialize")
def q_materialize(x: Ctx):
    from shopsignal.plans.materialize import materialize
    return materialize(x)


@query("country_refresh")
def q_country_refresh(x: Ctx):
    """Sales stored by country, then refreshed after one country's amounts have doubled: contents, and what was rewritten."""
    sales = x.master.filter(F.col("StoreCountry").isNotNull()).select("StoreCountry", "BasketID", "LineNo", "ClientID", "ProductID", AMOUNT, "Quantity")
    sales = materialize(sales, "sales-with-country")      # both refreshes read them twice: they meet their stores once
    first = x.t.stores.agg(F.min("StoreCountry")).scalar()
    later = sales.withColumn(AMOUNT, F.when(F.col("StoreCountry") == first, F.col(AMOUNT) * 2).otherwise(F.col(AMOUNT)).cast("decimal(18,2)"))
    root = shared_folder(x.spark, "sales-by-country")
    storage.refresh(sales, root)
    done = storage.refresh(later, root)
    stored = storage.read_by_country(x.spark, root, later.schema)
    return stored.groupBy("StoreCountry").agg(
        F.sum(AMOUNT).alias("Revenue"), F.sum("Quantity").alias("Units"), F.count(F.lit(1)).alias("Rows"), F.countDistinct("BasketID", "LineNo").alias("Lines")) \
        .withColumn("Rewritten", F.col("StoreCountry").isin(*done.rewritten).cast("int"))


@query("client_pages")
def q_client_pages(x: Ctx):
    """Client features and recommendation cards, stored in buckets of clients and joined without an exchange."""
    tables = storage.store_bucketed({"client_features": _client_feats(x), "recommendation_cards": bi.recommendation_cards(_recs(x), x.view(bi.first_rows(x.clean)))},
                                    f"pages_{uuid.uuid4().hex}")
    return storage.client_page(x.spark, tables).select("ClientID", "Persona", "ClientCountry", "RFM_Score", "TotalSpent", "Rank", "ProductID", "ProductFamily", "Price")


@query("country_playbook_app")
def q_playbook_app(x: Ctx):
    return bi.country_playbook_app(_insights(x), x.spark)


@query("country_kpi_summary")
def q_kpi_summary(x: Ctx):
    return bi.country_kpi_summary(x.master)


@query("search_targets_country")
def q_search_targets_country(x: Ctx):
    """Search audience restricted to one country (the first store country in sort order)."""
    country = x.t.stores.agg(F.min("StoreCountry")).scalar()
    t = targeting.search_targets(_matches(x), targeting.buyers_by_family(x.master), _client_feats(x), country=country)
    return t.select("ClientID", "Persona", "ClientCountry", "TargetScore", "Rank")
