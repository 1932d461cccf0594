"""BI roll-ups for executives, stores, customers and inventory — one relation per widget,
for every country / store / client at once (a point lookup is a filter on the result)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.functions.scalar import gender_label, money, safe_div
from shopsignal.operators import customers, products
from shopsignal.operators.features import AMOUNT, DATE, QTY, at_moment, row_tiebreak, spread_key
from shopsignal.operators.numeric import grouped_quantile, materialize, ordered_scan, scanned_quantile, top_k

SAMPLE_PERSONAS = [K.VERY_FREQUENT, K.LOYAL_MID, K.LOYAL_LOW, K.INACTIVE_MID, K.INACTIVE_LOW, K.NO_TRANSACTIONS]


def strategy_table(spark) -> DataFrame:
    """The fixed persona → strategy table (6 rows)."""
    return spark.createDataFrame(
        [(i, p, s, c, u) for i, (p, s, c, u) in enumerate(K.PERSONA_STRATEGIES)],
        "Ord int, Persona string, Strategy string, Channel string, Priority string")


def dataset_metadata(master: DataFrame, clients: DataFrame, products_df: DataFrame) -> DataFrame:
    countries = master.filter(F.col("StoreCountry").isNotNull()).select("StoreCountry").distinct()
    # the country list is bounded (ISO countries); it is the one list the metadata carries
    c = countries.agg(F.array_join(F.sort_array(F.collect_list("StoreCountry")), ",").alias("countries"),
                      F.count(F.lit(1)).alias("n_countries"))
    return (c.withColumn("n_clients_total", clients.select(F.countDistinct("ClientID")).scalar())
             .withColumn("n_products", products_df.select(F.countDistinct("ProductID")).scalar()))


def persona_samples(persona_df: DataFrame, per_persona: int = 2) -> DataFrame:
    p = persona_df.filter(F.col("Persona").isin(*SAMPLE_PERSONAS)).select("Persona", "ClientID")
    return top_k(p, ["Persona"], [F.col("ClientID")], per_persona, rank_col="SampleRank")


def final_features(master: DataFrame, rfm: DataFrame) -> DataFrame:
    """Join-back of the per-client and per-product features onto every sale (C2).

    Sales are dealt out twice, however wide: once by product, under the key by which they met the products, and once
    by client, to whose scores the favourite category is joined first."""
    pf = products.product_tiers(materialize(products.product_features(master), "product-features")).drop("FirstSale", "LastSale")   # read twice
    r = rfm.drop("FirstPurchase", "LastPurchase")
    per_client = r.join(customers.favorite_category(master), "ClientID", "full")       # a row per client on either side
    out = master.join(pf.withColumnRenamed("ProductID", "_product"), spread_key("ProductID") == F.col("_product"), "left").drop("_product")
    out = out.join(per_client.withColumnRenamed("ClientID", "_client"), spread_key("ClientID") == F.col("_client"), "left").drop("_client")
    keys = ["ClientID", "ProductID"]
    columns = [*keys, *[c for d in (master, r, pf) for c in d.columns if c not in keys]]
    return customers.favorite_flags(out.select(*columns, "FavoriteCategory"))


def first_sales(master: DataFrame, *columns: str) -> DataFrame:
    """The first sale row per product, its ``columns``.

    The first moment needs two columns of the sales; only the sales of that moment are joined to the
    dimensions, sorted and compared as rows."""
    tb = [c for c in row_tiebreak(master) if c != "ProductID"]
    order = F.struct(F.col(DATE), *[F.col(c) for c in tb if c != DATE])
    sold = master.filter(F.col("ProductID").isNotNull())
    at = F.when(F.count_if(F.col(DATE).isNull()) == 0, F.min(DATE))           # no date sorts before all
    return (at_moment(sold, "ProductID", at).groupBy("ProductID")
            .agg(F.min_by(F.struct(*columns), order).alias("_r")).select("ProductID", "_r.*"))


def first_rows(sales: DataFrame) -> DataFrame:
    """The sale of each product that ``first_sales`` takes, whole: a row per product, by an aggregate of plain sales, so that a
    lazy view on them joins the dimensions to no others."""
    key = row_tiebreak(sales)
    order = [DATE, *[c for c in key if c not in ("ProductID", DATE)]]
    firsts = sales.filter(F.col("ProductID").isNotNull()).groupBy("ProductID").agg(F.min(F.struct(*order)).alias("_r"))
    return firsts.select("ProductID", "_r.*").select(*key)


def product_catalog(master: DataFrame) -> DataFrame:
    """First sale row per product: its family, category and universe."""
    return first_sales(master, "FamilyLevel2", "Category", "FamilyLevel1", "Universe")


def recommendation_cards(recs: DataFrame, master: DataFrame) -> DataFrame:
    """The recommended products that were ever sold, as shown on a client's card: family and
    category of the first sale, its unit price as money, stock status (lists are stock-filtered).
    ``master`` holds all sales, or those of ``first_rows``."""
    priced = master.withColumn("PricePerUnit", F.col(AMOUNT).cast("double") / F.greatest(F.col(QTY), F.lit(1)))
    info = first_sales(priced, "FamilyLevel2", "Category", "PricePerUnit")
    return recs.join(info, "ProductID").select(
        "ClientID", "Rank", "ProductID", F.col("FamilyLevel2").alias("ProductFamily"), "Category",
        money("PricePerUnit").alias("Price"), F.lit("In Stock").alias("StockStatus"))


def basket_summary(master: DataFrame) -> DataFrame:
    from shopsignal.operators.baskets import basket_ids
    b = basket_ids(master)
    return b.groupBy("BasketID").agg(F.count(F.lit(1)).alias("n_lines"),
                                     F.countDistinct("ProductID").alias("n_items"),
                                     F.countDistinct("FamilyLevel2").alias("n_families"),
                                     F.sum(AMOUNT).cast("double").alias("basket_value"))


def kpi_headline(master: DataFrame) -> DataFrame:
    """Revenue, transactions, distinct clients, avg basket; plus the sum of per-country
    client counts (the precomputed-dashboard figure, which counts cross-border clients twice)."""
    tot = master.agg(F.sum(AMOUNT).cast("double").alias("total_revenue"),
                     F.count(F.lit(1)).alias("n_transactions"),
                     F.countDistinct("ClientID").alias("n_clients"))
    per = (master.filter(F.col("StoreCountry").isNotNull()).groupBy("StoreCountry")
           .agg(F.countDistinct("ClientID").alias("_n")).agg(F.sum("_n")))
    return (tot.withColumn("n_clients_country_sum", per.scalar())
               .withColumn("avg_basket", F.coalesce(safe_div(F.col("total_revenue"), F.col("n_transactions").cast("double")), F.lit(0.0))))


def country_kpis(master: DataFrame) -> DataFrame:
    """Per store country: revenue, transactions, clients, products, units, mean and exact
    median sale (the median is a distributed grouped quantile, not a per-group value map).

    One aggregate by (country, amount) gives the sums and, ordered, the median; the two distinct counts are the other pass.
    """
    m = master.filter(F.col("StoreCountry").isNotNull())
    amounts = m.groupBy("StoreCountry", AMOUNT).agg(F.count(F.lit(1)).alias("_n"), F.sum(QTY).alias("_units"))
    values = ordered_scan(amounts, ["StoreCountry"], [AMOUNT], sum_col="_n", prefix="_")        # its checkpoint serves both reads
    sums = values.groupBy("StoreCountry").agg(
        F.sum(F.col(AMOUNT) * F.col("_n").cast("decimal(18,0)")).cast("double").alias("total_revenue"), F.sum("_n").alias("n_transactions"),
        F.sum("_units").cast("bigint").alias("units")) \
        .withColumn("avg_basket", F.col("total_revenue") / F.col("n_transactions").cast("double"))
    kpi = m.groupBy("StoreCountry").agg(F.countDistinct("ClientID").alias("n_clients"), F.countDistinct("ProductID").alias("n_products"))
    med = scanned_quantile(values, ["StoreCountry"], AMOUNT, "_n", "_cum", 0.5, "median_basket")
    return sums.join(kpi, "StoreCountry", "left").join(med, "StoreCountry", "left").select(
        "StoreCountry", "total_revenue", "n_transactions", "n_clients", "n_products", "units", "avg_basket", "median_basket")


def strategy_matrix(spark, persona_df: DataFrame) -> DataFrame:
    counts = persona_df.groupBy("Persona").agg(F.countDistinct("ClientID").alias("_n"))
    st = strategy_table(spark)
    return (st.join(counts, "Persona", "left")
              .select("Persona", F.coalesce("_n", F.lit(0)).alias("Clients"), "Strategy", "Channel", "Priority"))


def with_persona(master: DataFrame, persona_df: DataFrame) -> DataFrame:
    return master.join(persona_df.select("ClientID", "Persona"), "ClientID", "left")


def family_persona_revenue(master_p: DataFrame, k: int = 10) -> DataFrame:
    fam = master_p.filter(F.col("FamilyLevel1").isNotNull())
    rev = fam.groupBy("FamilyLevel1").agg(F.sum(AMOUNT).alias("_r"))
    top = top_k(rev, [], [F.col("_r").desc(), F.col("FamilyLevel1")], k).select("FamilyLevel1")
    return (fam.filter(F.col("Persona").isNotNull()).join(top, "FamilyLevel1", "left_semi")
               .groupBy("FamilyLevel1", "Persona").agg(F.sum(AMOUNT).cast("double").alias("Revenue")))


def _top_names(df: DataFrame, key: str, item: str, k: int, prefix: str) -> DataFrame:
    rev = df.filter(F.col(item).isNotNull()).groupBy(key, item).agg(F.sum(AMOUNT).alias("_r"))
    t = top_k(rev, [key], [F.col("_r").desc(), F.col(item)], k)
    # ≤ k names per key: a bounded list
    return t.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Rank", item))),
                                                       lambda s: s[item]), "|").alias(prefix))


def stock_medians(stocks: DataFrame) -> DataFrame:
    return grouped_quantile(stocks.filter(F.col("StoreCountry").isNotNull()), ["StoreCountry"], "Quantity", 0.5, "_med")


def stock_health_by_country(stocks: DataFrame) -> DataFrame:
    s = stocks.join(F.broadcast(stock_medians(stocks)), "StoreCountry")     # a row per country
    return s.groupBy("StoreCountry").agg(
        F.countDistinct("ProductID").alias("total_skus"),
        F.count_if(F.col("Quantity") == 0).alias("zero_stock"),
        F.count_if(F.col("Quantity") > F.col("_med") * 3).alias("overstocked"),
        F.sum("Quantity").cast("bigint").alias("total_units"))


def country_insights(sales: DataFrame, persona_df: DataFrame, stocks: DataFrame, by: str = "ClientCountry") -> DataFrame:
    """Per country: KPIs, top-5 families and categories of its sales, persona counts of its
    clients, stock health (one aggregate per fact, joined on country). ``by`` says whose country
    a sale counts for: the client's or the store's."""
    m = sales.filter(F.col(by).isNotNull()).withColumn("Country", F.col(by))
    kpi = m.groupBy("Country").agg(
        F.sum(AMOUNT).cast("double").alias("revenue"), F.count(F.lit(1)).alias("transactions"),
        F.countDistinct("ClientID").alias("clients"))
    kpi = kpi.withColumn("avg_basket", F.col("revenue") / F.col("transactions").cast("double"))
    pc = (persona_df.filter(F.col("ClientCountry").isNotNull())
          .groupBy(F.col("ClientCountry").alias("Country"), "Persona").agg(F.count(F.lit(1)).alias("_n")))
    pagg = pc.groupBy("Country").agg(
        F.sum("_n").alias("persona_clients"),
        F.min_by("Persona", F.struct(-F.col("_n"), F.col("Persona"))).alias("dominant_persona"),
        F.sum(F.when(F.col("Persona").isin(K.INACTIVE_LOW, K.INACTIVE_MID), F.col("_n")).otherwise(0)).alias("inactive_count"),
        F.sum(F.when(F.col("Persona") == K.NO_TRANSACTIONS, F.col("_n")).otherwise(0)).alias("cold_count"))
    fams = _top_names(m, "Country", "FamilyLevel2", 5, "top_families")
    cats = _top_names(m, "Country", "Category", 5, "top_categories")
    sh = stock_health_by_country(stocks).withColumnRenamed("StoreCountry", "Country").drop("total_units")
    names = F.create_map(*[F.lit(x) for pair in K.COUNTRY_NAMES for x in pair])
    return (kpi.join(pagg, "Country", "left").join(fams, "Country", "left")
               .join(cats, "Country", "left").join(sh, "Country", "left")
               .withColumn("CountryName", F.coalesce(names[F.col("Country")], F.col("Country"))))


def country_playbook(insights: DataFrame, spark) -> DataFrame:
    """Playbook rules per country → one row per triggered action, with its figures."""
    st = strategy_table(spark).select(F.col("Persona").alias("dominant_persona"), "Strategy")
    i = insights.join(st, "dominant_persona", "left")
    pct_inactive = F.coalesce(safe_div(F.col("inactive_count") * 100.0, F.col("persona_clients").cast("double")), F.lit(0.0))
    pct_zero = F.coalesce(safe_div(F.col("zero_stock") * 100.0, F.col("total_skus").cast("double")), F.lit(0.0))
    def act(no, name, subject, count, pct, detail):
        return F.struct(F.lit(no).alias("ActionNo"), F.lit(name).alias("Action"), subject.alias("Subject"),
                        count.cast("bigint").alias("Count"), pct.cast("double").alias("Pct"), detail.alias("Detail"))
    none = F.lit(None)
    acts = F.array(
        act(1, "primary_audience", F.coalesce("dominant_persona", F.lit("Unknown")), none, none,
            F.coalesce("Strategy", F.lit("personalised offers"))),
        F.when(F.col("inactive_count") > 0, act(2, "win_back", F.lit("inactive clients"), F.col("inactive_count"),
                                                pct_inactive, F.lit("Email + SMS"))),
        F.when(F.col("cold_count") > 100, act(3, "activation", F.lit("never purchased"), F.col("cold_count"), none,
                                              F.lit("welcome offer on trending products"))),
        F.when(F.col("zero_stock") > 0, act(4, "stock_alert", F.lit("zero-stock SKUs"), F.col("zero_stock"), pct_zero,
                                            F.lit("replenish before campaign launch"))),
        F.when(F.col("overstocked") > 0, act(5, "promotion", F.lit("overstocked SKUs"), F.col("overstocked"), none,
                                             F.lit("discount campaigns"))),
    )
    return (i.select("Country", F.explode(F.filter(acts, lambda a: a.isNotNull())).alias("a"))
             .select("Country", "a.*"))


def persona_reach(master_p: DataFrame) -> DataFrame:
    m = master_p.filter(F.col("Persona").isNotNull())
    return m.groupBy("Persona").agg(
        (F.sum(AMOUNT).cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_amount"),
        F.avg("HasEmail").alias("email_reach"), F.avg("HasPhone").alias("phone_reach"),
        F.countDistinct("ClientID").alias("clients"))


def persona_advice(reach: DataFrame) -> DataFrame:
    p = F.col("Persona")
    strategy = (F.when(p.contains("Loyal") | p.contains("Very Frequent"), K.ADVICE_VIP)
                 .when(p.contains("Inactive"), K.ADVICE_WINBACK)
                 .when(p.contains("No Transactions"), K.ADVICE_ACTIVATION)
                 .otherwise(K.ADVICE_NURTURE))
    e, ph = F.col("email_reach") * 100, F.col("phone_reach") * 100
    channel = (F.when((e > 50) & (ph > 50), F.lit("Omnichannel"))
                .when(e > 50, F.lit("Email Primary")).when(ph > 50, F.lit("SMS Primary"))
                .otherwise(F.lit("Low Reach")))
    email, phone = percent_text(e), percent_text(ph)
    sentence = (F.when((e > 50) & (ph > 50), F.concat(F.lit("Omnichannel: Use Email ("), email, F.lit("%) & SMS ("), phone, F.lit("%) for balanced impact.")))
                 .when(e > 50, F.concat(F.lit("Email Primary: High email opt-in ("), email, F.lit("%). Use rich visual newsletters.")))
                 .when(ph > 50, F.concat(F.lit("SMS Primary: High phone opt-in ("), phone, F.lit("%). Optimal for urgent/short alerts.")))
                 .otherwise(F.lit(K.CHANNEL_LOW)))
    return reach.select("Persona", strategy.alias("Strategy"), channel.alias("Channel"), sentence.alias("ChannelText"),
                        e.alias("email_pct"), ph.alias("phone_pct"))


def percent_text(x):
    """A number with one decimal place, halves rounded up, built from whole tenths."""
    tenths = F.floor(x * 10 + 0.5).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def revenue_by_country(master: DataFrame) -> DataFrame:
    return (master.filter(F.col("StoreCountry").isNotNull()).groupBy("StoreCountry")
            .agg(F.sum(AMOUNT).cast("double").alias("Revenue")))


def top_categories(master: DataFrame, k: int = 12) -> DataFrame:
    rev = master.filter(F.col("Category").isNotNull()).groupBy("Category").agg(F.sum(AMOUNT).alias("Revenue"))
    return top_k(rev, [], [F.col("Revenue").desc(), F.col("Category")], k) \
        .withColumn("Revenue", F.col("Revenue").cast("double"))


def category_country_matrix(master: DataFrame, k: int = 10) -> DataFrame:
    """Revenue of the top-k categories in every store country: a zero-filled grid in long form."""
    top = top_categories(master, k).select("Category")
    m = master.filter(F.col("StoreCountry").isNotNull()).join(top, "Category", "left_semi")
    rev = m.groupBy("Category", "StoreCountry").agg(F.sum(AMOUNT).cast("double").alias("Revenue"))
    cats = top.agg(F.collect_list("Category")).scalar()          # ≤ k names
    grid = m.select("StoreCountry").distinct().select("StoreCountry", F.explode(cats).alias("Category"))
    return grid.join(rev, ["Category", "StoreCountry"], "left").withColumn("Revenue", F.coalesce("Revenue", F.lit(0.0)))


def pivot_wide(long_df: DataFrame, rows: list[str], col: str, val: str, values: list[str]) -> DataFrame:
    """One column per name in ``values`` (a bounded list, e.g. the countries), zero-filled."""
    return long_df.groupBy(*rows).pivot(col, values).agg(F.sum(val)).fillna(0, values)


MAX_COUNTRIES = 500


def country_columns(stocks: DataFrame) -> list[str]:
    """The countries that hold stock rows: the columns of the pivoted tables (ISO countries). More than
    MAX_COUNTRIES are dirty data, not a list of columns, and an error; the long form has no such limit."""
    found = stocks.filter(F.col("StoreCountry").isNotNull()).select("StoreCountry").distinct().limit(MAX_COUNTRIES + 1).collect()
    if len(found) > MAX_COUNTRIES:
        raise ValueError(f"more than {MAX_COUNTRIES} countries hold stock: use the long form")
    return sorted(r[0] for r in found)


def store_metrics(master: DataFrame) -> DataFrame:
    return (master.filter(F.col("StoreID").isNotNull()).groupBy("StoreID").agg(
        F.sum(AMOUNT).cast("double").alias("revenue"), F.count(F.lit(1)).alias("transactions"),
        (F.sum(AMOUNT).cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_transaction")))


def overstock(stocks: DataFrame, products_df: DataFrame, k: int = 15) -> DataFrame:
    over = stocks.join(F.broadcast(stock_medians(stocks)), "StoreCountry").filter(F.col("Quantity") > F.col("_med"))
    t = top_k(over, ["StoreCountry"], [F.col("Quantity").desc(), F.col("ProductID")], k)
    info = products_df.select("ProductID", F.col("FamilyLevel2").alias("Product"), "Category",
                              F.col("FamilyLevel1").alias("SportFamily"))
    return t.join(info, "ProductID", "left").select("StoreCountry", "Rank", "ProductID", "Product", "Category",
                                                   "SportFamily", "Quantity")


def stock_health(stocks: DataFrame) -> DataFrame:
    agg = stocks.groupBy("StoreCountry").agg(
        F.countDistinct("ProductID").alias("products"), F.sum("Quantity").cast("bigint").alias("total_units"),
        F.count_if(F.col("Quantity") == 0).alias("zero_stock"))
    return agg.withColumn("zero_pct", F.round(F.col("zero_stock") / F.col("products").cast("double") * 100, 1))


def country_trending(scores: DataFrame, products_df: DataFrame, k: int = 15) -> DataFrame:
    c = (scores.filter(F.col("StoreCountry").isNotNull()).groupBy("StoreCountry", "ProductID")
         .agg(F.sum("FinalScore").alias("FinalScore"), F.sum("recent_score").alias("recent_score"),
              F.sum("seasonal_score").alias("seasonal_score")))
    t = top_k(c, ["StoreCountry"], [F.round("FinalScore", 6).desc(), F.col("ProductID")], k)
    info = products_df.select("ProductID", F.col("FamilyLevel2").alias("Product"), "Category",
                              F.col("FamilyLevel1").alias("SportFamily"), F.col("Universe").alias("Gender"))
    return t.join(info, "ProductID", "left").withColumn("Source", F.lit("Country"))


def client_360(spark, persona_enr: DataFrame, rfm: DataFrame) -> DataFrame:
    st = strategy_table(spark)
    _, d_strategy, d_channel, _ = K.PERSONA_STRATEGIES[0]      # the "No Transactions" row is the default
    cf = customers.client_features(persona_enr, rfm)
    out = (cf.join(F.broadcast(st.select("Persona", "Strategy", "Channel")), "Persona", "left")
             .withColumn("_ds", F.lit(d_strategy)).withColumn("_dc", F.lit(d_channel)))
    cold = F.col("Persona") == K.NO_TRANSACTIONS
    return out.select(
        "ClientID", "Persona", "ClientCountry",
        F.coalesce("Strategy", "_ds").alias("Strategy"), F.coalesce("Channel", "_dc").alias("Channel"),
        "TotalSpent", "TransactionCount", "AvgOrderValue", "Recency", "RFM_Score", "FavoriteCategory",
        F.when(cold, gender_label("ClientGender")).alias("GenderLabel"),
        F.when(cold, F.col("ClientSegment")).alias("Segment"))


def dimension_values(master: DataFrame, stores: DataFrame) -> DataFrame:
    cc = master.filter(F.col("ClientCountry").isNotNull()).select(F.lit("ClientCountry").alias("Dimension"),
                                                                  F.col("ClientCountry").alias("Value"), F.lit(None).cast("string").alias("Parent"))
    sc = master.filter(F.col("StoreCountry").isNotNull()).select(F.lit("StoreCountry"), F.col("StoreCountry"), F.lit(None).cast("string"))
    st = stores.select("StoreID", F.col("StoreCountry").alias("_sc"))
    si = master.filter(F.col("StoreID").isNotNull()).select("StoreID").join(st, "StoreID", "left").select(
        F.lit("StoreID"), F.col("StoreID"), F.col("_sc"))
    return cc.union(sc).union(si).distinct()


def country_playbook_app(insights: DataFrame, spark) -> DataFrame:
    """The interactive app's variant: win-back above 50 inactive clients, stock alert above
    5 zero-stock items, and the dominant persona's strategy."""
    st = strategy_table(spark).select(F.col("Persona").alias("dominant_persona"), "Strategy")
    i = insights.join(st, "dominant_persona", "left")

    def act(no, name, count, detail):
        return F.struct(F.lit(no).alias("ActionNo"), F.lit(name).alias("Action"),
                        count.cast("bigint").alias("Count"), detail.alias("Detail"))
    acts = F.array(
        F.when(F.col("inactive_count") > 50, act(1, "win_back", F.col("inactive_count"), F.lit("SMS Re-engagement"))),
        F.when(F.col("zero_stock") > 5, act(2, "stock_alert", F.col("zero_stock"), F.lit("popular items out of stock"))),
        F.when(F.col("dominant_persona").isNotNull(), act(3, "dominant_persona", F.lit(None),
                                                         F.coalesce(F.col("Strategy"), F.lit("Standard")))),
    )
    return i.select("Country", F.explode(F.filter(acts, lambda a: a.isNotNull())).alias("a")).select("Country", "a.*")


def country_kpi_summary(master: DataFrame) -> DataFrame:
    """The country KPI table as displayed: money as '€1,234' (≥ 1000) or '€12.34'."""
    k = (master.filter(F.col("StoreCountry").isNotNull()).groupBy("StoreCountry").agg(
        F.sum(AMOUNT).cast("double").alias("_rev"), F.count(F.lit(1)).alias("Transactions"),
        F.countDistinct("ClientID").alias("Clients"), F.sum(QTY).cast("bigint").alias("UnitsSold")))
    return k.select(F.col("StoreCountry").alias("Country"), money("_rev").alias("Revenue"), "Transactions", "Clients",
                    "UnitsSold", money(F.col("_rev") / F.col("Transactions").cast("double")).alias("AvgBasket"))
