"""SQL oracle (DuckDB dialect) for the query catalog.

Each key's SQL is assembled from a library of named CTEs with dependencies, all over the whole
sale history. Output normalisation matches ``catalog.normalize``:
timestamps as text, decimals/doubles as DOUBLE rounded to 6 places.
"""
from __future__ import annotations

import re

TS = "'%Y-%m-%d %H:%M:%S'"
RK = ("BasketID, LineNo, ClientID, ProductID, StoreID, "
      "ROUND(CAST(SalesNetAmountEuro AS DOUBLE), 6) AS SalesNetAmountEuro, Quantity")
ROW_ORDER = "BasketID, LineNo, ProductID, StoreID, SalesNetAmountEuro, Quantity"
ROW_ORDER_DESC = ("BasketID DESC, LineNo DESC, ProductID DESC, StoreID DESC, "
                  "SalesNetAmountEuro DESC, Quantity DESC")


def r6(expr: str, alias: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS {alias}"


def ts(expr: str, alias: str) -> str:
    return f"strftime({expr}, {TS}) AS {alias}"


def exact_mean(x: str) -> str:
    """Order-independent mean (same rule as functions.scalar.exact_mean)."""
    return (f"CAST(sum(CAST(ROUND({x} * 1000000000.0::DOUBLE) / 1000000000.0::DOUBLE AS DECIMAL(38,9))) AS DOUBLE)"
            f" / CAST(count({x}) AS DOUBLE)")


def days(a: str, b: str) -> str:
    """Whole elapsed days from a to b (floored)."""
    return f"CAST(floor(date_diff('second', {a}, {b}) / 86400) AS BIGINT)"


def _money(x: str) -> str:
    return (f"CASE WHEN abs({x}) >= 1000 THEN '€' || format('{{:,.0f}}', {x}) "
            f"ELSE '€' || format('{{:,.2f}}', {x}) END")


# name -> SQL body. "{p}" marks references to other *derived* CTEs (same prefix).
BASE: dict[str, str] = {}
DERIVED: dict[str, str] = {}


def base(name, sql):
    BASE[name] = sql


def derived(name, sql):
    DERIVED[name] = sql


# ------------------------------------------------------------------ fixture views
base("tx", """SELECT CAST(o.o_custkey AS VARCHAR) AS ClientID, CAST(l.l_partkey AS VARCHAR) AS ProductID,
       CAST(l.l_suppkey AS VARCHAR) AS StoreID, CAST(o.o_orderdate + INTERVAL 23 YEAR AS TIMESTAMP) AS SaleTransactionDate,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS SalesNetAmountEuro, CAST(l.l_quantity AS INTEGER) AS Quantity,
       CAST(l.l_orderkey AS VARCHAR) AS BasketID, l.l_linenumber AS LineNo
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
base("clients_raw", """SELECT CAST(c.c_custkey AS VARCHAR) AS ClientID,
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'LOYAL' WHEN 'BUILDING' THEN 'TOP'
            WHEN 'FURNITURE' THEN 'INACTIVE_1Y' WHEN 'HOUSEHOLD' THEN 'PROSPECT' END AS ClientSegment,
       n.n_name AS ClientCountry,
       CASE c.c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS ClientGender,
       CAST(c.c_custkey % 2 AS INTEGER) AS ClientOptINEmail,
       CASE WHEN c.c_custkey % 5 < 2 THEN 1 ELSE 0 END AS ClientOptINPhone
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
base("products_raw", """SELECT CAST(p_partkey AS VARCHAR) AS ProductID,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS Category,
       p_brand AS FamilyLevel1, p_name AS FamilyLevel2,
       CASE p_size % 3 WHEN 0 THEN 'Men' WHEN 1 THEN 'Women' END AS Universe
FROM part""")
base("stores", """SELECT CAST(s.s_suppkey AS VARCHAR) AS StoreID, n.n_name AS StoreCountry
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")
base("stocks", """SELECT n.n_name AS StoreCountry, CAST(p.p_partkey AS VARCHAR) AS ProductID,
       CAST(CASE WHEN (p.p_partkey*7 + n.n_nationkey*13) % 50 < 10 THEN 0
                 ELSE (p.p_partkey*7 + n.n_nationkey*13) % 50 END AS INTEGER) AS Quantity
FROM part p CROSS JOIN nation n WHERE (p.p_partkey + n.n_nationkey) % 4 <> 0""")
base("products", """SELECT ProductID, COALESCE(Category, 'Unknown') AS Category,
       COALESCE(FamilyLevel1, 'Unknown') AS FamilyLevel1, COALESCE(FamilyLevel2, 'Unknown') AS FamilyLevel2,
       COALESCE(Universe, 'Unisex') AS Universe FROM products_raw""")
base("clients", """SELECT ClientID, COALESCE(ClientSegment, 'Regular') AS ClientSegment, ClientCountry,
       COALESCE(ClientGender, 'Unknown') AS ClientGender,
       CAST(COALESCE(ClientOptINEmail = 1, false) AS INTEGER) AS HasEmail,
       CAST(COALESCE(ClientOptINPhone = 1, false) AS INTEGER) AS HasPhone,
       CAST(COALESCE(ClientOptINEmail = 1, false) OR COALESCE(ClientOptINPhone = 1, false) AS INTEGER) AS HasContact
FROM clients_raw""")
base("strategies", """SELECT * FROM (VALUES
 (0, 'No Transactions', 'Welcome offer on trending products', 'Email + Social Media', 'Medium'),
 (1, 'Inactive (Low Freq)', 'Win-back with discount on last-purchased category', 'Email + SMS + Retargeting', 'High'),
 (2, 'Inactive (Mid Freq)', 'Re-engage with personalised product bundles', 'Email + Push', 'High'),
 (3, 'Loyal/Top (Low Freq)', 'Cross-sell via association rules to build basket', 'Email + In-App', 'Moderate'),
 (4, 'Loyal/Top (Mid Freq)', 'AI-powered next-product predictions + loyalty rewards', 'Personalised Email + In-App + SMS', 'Nurture'),
 (5, 'Very Frequent (>15)', 'VIP treatment, ambassador program, exclusive early access', 'All Channels + Personal Manager', 'VIP')
) AS t(Ord, Persona, Strategy, Channel, Priority)""")

# ------------------------------------------------------------------ cleaning and the wide table
derived("clean", """SELECT DISTINCT * FROM {p}tx
WHERE SalesNetAmountEuro >= 0 AND Quantity > 0 AND SaleTransactionDate IS NOT NULL""")
derived("master0", """SELECT t.*, p.Category, p.FamilyLevel1, p.FamilyLevel2, p.Universe,
       c.ClientSegment, c.ClientCountry, c.ClientGender, c.HasEmail, c.HasPhone, c.HasContact, s.StoreCountry,
       CAST(year(t.SaleTransactionDate) AS INTEGER) AS Year, CAST(month(t.SaleTransactionDate) AS INTEGER) AS Month,
       CAST(quarter(t.SaleTransactionDate) AS INTEGER) AS Quarter,
       CAST(isodow(t.SaleTransactionDate) - 1 AS INTEGER) AS DayOfWeek,
       CAST(day(t.SaleTransactionDate) AS INTEGER) AS DayOfMonth,
       CAST(make_date(year(t.SaleTransactionDate), 11, 1)
            + CAST((12 - isodow(make_date(year(t.SaleTransactionDate), 11, 1))) % 7 + 21 AS INTEGER) AS TIMESTAMP) AS _bf
FROM {p}clean t LEFT JOIN products p ON t.ProductID = p.ProductID
LEFT JOIN clients c ON t.ClientID = c.ClientID LEFT JOIN stores s ON t.StoreID = s.StoreID""")
_EVENTS = " OR ".join([
    "(SaleTransactionDate >= TIMESTAMP '2022-11-20' AND SaleTransactionDate <= TIMESTAMP '2022-12-18')",
    "(SaleTransactionDate >= TIMESTAMP '2024-06-14' AND SaleTransactionDate <= TIMESTAMP '2024-07-14' AND ClientCountry IN ('FR','ES','IT','DE','GB','UK'))",
    "(SaleTransactionDate >= TIMESTAMP '2024-07-26' AND SaleTransactionDate <= TIMESTAMP '2024-08-11')",
    "(SaleTransactionDate >= TIMESTAMP '2023-06-10' AND SaleTransactionDate <= TIMESTAMP '2023-06-10' AND ClientCountry IN ('FR','ES','IT','DE','GB','UK'))",
    "(SaleTransactionDate >= TIMESTAMP '2024-06-01' AND SaleTransactionDate <= TIMESTAMP '2024-06-01' AND ClientCountry IN ('FR','ES','IT','DE','GB','UK'))",
    "(SaleTransactionDate >= TIMESTAMP '2023-02-12' AND SaleTransactionDate <= TIMESTAMP '2023-02-12' AND ClientCountry IN ('US'))",
    "(SaleTransactionDate >= TIMESTAMP '2024-02-11' AND SaleTransactionDate <= TIMESTAMP '2024-02-11' AND ClientCountry IN ('US'))",
])
derived("master1", """SELECT *, CAST(DayOfWeek IN (5, 6) AS INTEGER) AS IsWeekend,
       CASE WHEN Month IN (12, 1, 2) THEN 'Winter' WHEN Month IN (3, 4, 5) THEN 'Spring'
            WHEN Month IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS Season,
       CAST(COALESCE(SaleTransactionDate >= _bf AND SaleTransactionDate <= _bf + INTERVAL 3 DAY, false) AS INTEGER) AS IsBlackFriday,
       CAST(COALESCE(SaleTransactionDate = _bf + INTERVAL 3 DAY, false) AS INTEGER) AS IsCyberMonday,
       CAST(Month = 12 AND DayOfMonth <= 25 AS INTEGER) AS IsChristmasSeason,
       CAST((Month = 12 AND DayOfMonth >= 26) OR (Month = 1 AND DayOfMonth <= 7) AS INTEGER) AS IsNewYearSeason,
       CAST((Month = 8 AND DayOfMonth >= 15) OR (Month = 9 AND DayOfMonth <= 15) AS INTEGER) AS IsBackToSchool,
       CAST((Month = 6 AND DayOfMonth >= 15) OR Month = 7 AS INTEGER) AS IsSummerSale,
       CAST(COALESCE(""" + _EVENTS + """, false) AS INTEGER) AS IsMajorSportingEvent
FROM {p}master0""")
derived("master", """SELECT *, CAST(Season = 'Winter' AS INTEGER) AS IsWinter, CAST(Season = 'Spring' AS INTEGER) AS IsSpring,
       CAST(Season = 'Summer' AS INTEGER) AS IsSummer, CAST(Season = 'Fall' AS INTEGER) AS IsFall,
       CAST(Quarter = 1 AS INTEGER) AS IsQ1, CAST(Quarter = 2 AS INTEGER) AS IsQ2,
       CAST(Quarter = 3 AS INTEGER) AS IsQ3, CAST(Quarter = 4 AS INTEGER) AS IsQ4,
       CAST(IsWeekend = 1 OR IsChristmasSeason = 1 OR IsNewYearSeason = 1 OR IsBlackFriday = 1 AS INTEGER) AS IsHoliday
FROM {p}master1""")
derived("priced", """SELECT *, CAST(SalesNetAmountEuro AS DOUBLE) / greatest(Quantity, 1) AS PricePerUnit FROM {p}master""")
derived("prodprice", """SELECT ProductID, """ + exact_mean("PricePerUnit") + """ AS AvgPricePerUnit, median(Quantity) AS TypicalQuantity
FROM {p}priced WHERE ProductID IS NOT NULL GROUP BY ProductID""")
derived("pricefeat", """SELECT m.*, pp.AvgPricePerUnit, pp.TypicalQuantity,
       CAST(COALESCE(m.PricePerUnit < pp.AvgPricePerUnit * 0.8, false) AS INTEGER) AS IsPotentialDiscount,
       least(greatest((1 - m.PricePerUnit / greatest(pp.AvgPricePerUnit, 0.01)) * 100, 0.0), 100.0) AS DiscountPercentage,
       CAST(COALESCE(m.PricePerUnit > pp.AvgPricePerUnit * 1.2, false) AS INTEGER) AS IsPremiumPurchase,
       CAST(COALESCE(m.Quantity >= greatest(pp.TypicalQuantity * 3, 5), false) AS INTEGER) AS IsBulkPurchase
FROM {p}priced m LEFT JOIN {p}prodprice pp ON m.ProductID = pp.ProductID""")

# ------------------------------------------------------------------ customers
derived("rfm_base", """SELECT *, TotalSpent / Frequency AS AvgOrderValue FROM (
SELECT ClientID, max(SaleTransactionDate) AS LastPurchase, min(SaleTransactionDate) AS FirstPurchase,
       CAST(sum(SalesNetAmountEuro) AS DOUBLE) AS TotalSpent,
       stddev_samp(CAST(SalesNetAmountEuro AS DOUBLE)) AS StdOrderValue,
       CAST(sum(Quantity) AS BIGINT) AS TotalQuantity, count(*) AS Frequency,
       avg(IsWeekend) AS WeekendShopperRatio,
       """ + days("max(SaleTransactionDate)", "(SELECT max(SaleTransactionDate) FROM {p}master) + INTERVAL 1 DAY") + """ AS Recency
FROM {p}master WHERE ClientID IS NOT NULL GROUP BY ClientID)""")


def _quintile(col: str, asc: bool) -> str:
    score = f"""CASE WHEN e.ok THEN 1 + CAST(s.x > e.q[1] AS INTEGER) + CAST(s.x > e.q[2] AS INTEGER)
                     + CAST(s.x > e.q[3] AS INTEGER) + CAST(s.x > e.q[4] AS INTEGER)
                ELSE 1 + CAST(s.pr > 0.2::DOUBLE AS INTEGER) + CAST(s.pr > 0.4::DOUBLE AS INTEGER)
                     + CAST(s.pr > 0.6::DOUBLE AS INTEGER) + CAST(s.pr > 0.8::DOUBLE AS INTEGER) END"""
    if not asc:
        score = f"6 - ({score})"
    return f"""SELECT s.ClientID, CAST({score} AS INTEGER) AS sc FROM
  (SELECT ClientID, CAST({col} AS DOUBLE) AS x,
          ((rank() OVER (ORDER BY {col}) - 1) + (count(*) OVER (PARTITION BY {col}) + 1) / 2.0::DOUBLE)
          / CAST(count(*) OVER () AS DOUBLE) AS pr FROM {{p}}rfm_base) s,
  (SELECT len(list_distinct([min(x), q[1], q[2], q[3], q[4], max(x)])) = 6 AS ok, q FROM
     (SELECT CAST({col} AS DOUBLE) AS x, quantile_cont(CAST({col} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) OVER () AS q
      FROM {{p}}rfm_base) GROUP BY q) e"""


derived("q_rec", _quintile("Recency", False))
derived("q_freq", _quintile("Frequency", True))
derived("q_mon", _quintile("TotalSpent", True))
derived("rfm", """SELECT b.*, r.sc AS RecencyScore, f.sc AS FrequencyScore, m.sc AS MonetaryScore,
       r.sc + f.sc + m.sc AS RFM_Score,
       """ + days("b.FirstPurchase", "b.LastPurchase") + """ AS CustomerLifetimeDays,
       COALESCE(b.StdOrderValue / greatest(b.AvgOrderValue, 1.0::DOUBLE), 0.0::DOUBLE) AS PriceVolatility,
       CAST(m.sc >= 4 AS INTEGER) AS IsHighValue, CAST(f.sc >= 4 AS INTEGER) AS IsFrequentBuyer,
       CAST(r.sc >= 4 AS INTEGER) AS IsRecentBuyer, CAST(r.sc <= 2 AND f.sc >= 3 AS INTEGER) AS IsAtRisk
FROM {p}rfm_base b JOIN {p}q_rec r USING (ClientID) JOIN {p}q_freq f USING (ClientID) JOIN {p}q_mon m USING (ClientID)""")
derived("fav", """SELECT ClientID, Category AS FavoriteCategory FROM (
  SELECT ClientID, Category, row_number() OVER (PARTITION BY ClientID ORDER BY spend DESC, Category) AS rn
  FROM (SELECT ClientID, Category, sum(SalesNetAmountEuro) AS spend FROM {p}master
        WHERE ClientID IS NOT NULL AND Category IS NOT NULL GROUP BY ClientID, Category)) WHERE rn = 1""")
derived("personas", """SELECT c.ClientID, c.ClientSegment, c.ClientCountry, c.ClientGender, c.HasEmail, c.HasPhone,
       COALESCE(n.n, 0) AS TransactionCount,
       CASE WHEN COALESCE(n.n, 0) = 0 THEN 'No Transactions'
            WHEN n.n > 15 THEN 'Very Frequent (>15)'
            WHEN upper(c.ClientSegment) = 'INACTIVE_1Y' THEN CASE WHEN n.n > 2 THEN 'Inactive (Mid Freq)' ELSE 'Inactive (Low Freq)' END
            WHEN upper(c.ClientSegment) IN ('LOYAL', 'TOP') THEN CASE WHEN n.n > 2 THEN 'Loyal/Top (Mid Freq)' ELSE 'Loyal/Top (Low Freq)' END
            ELSE 'Other (Active)' END AS Persona
FROM clients c LEFT JOIN (SELECT ClientID, count(*) AS n FROM {p}tx WHERE ClientID IS NOT NULL GROUP BY ClientID) n
  ON c.ClientID = n.ClientID""")
derived("modecat", """SELECT ClientID, Category AS ModeCategory FROM (
  SELECT ClientID, Category, row_number() OVER (PARTITION BY ClientID ORDER BY n DESC, Category) AS rn
  FROM (SELECT ClientID, Category, count(*) AS n FROM {p}master WHERE ClientID IS NOT NULL AND Category IS NOT NULL
        GROUP BY ClientID, Category)) WHERE rn = 1""")
derived("penr", """SELECT p.*, CAST(st.spent AS DOUBLE) / CAST(NULLIF(p.TransactionCount, 0) AS DOUBLE) AS AvgOrderValue,
       COALESCE(st.spent, 0.0::DOUBLE) AS TotalSpent, st.LastDate, st.TotalUnits,
       COALESCE(st.rec, 999) AS Recency,
       COALESCE(mc.ModeCategory, CASE WHEN st.ClientID IS NULL THEN 'None' ELSE 'N/A' END) AS FavoriteCategory
FROM {p}personas p LEFT JOIN (
  SELECT ClientID, CAST(sum(SalesNetAmountEuro) AS DOUBLE) AS spent, max(SaleTransactionDate) AS LastDate,
         CAST(sum(Quantity) AS BIGINT) AS TotalUnits,
         """ + days("max(SaleTransactionDate)", "(SELECT max(SaleTransactionDate) FROM {p}master)") + """ AS rec
  FROM {p}master WHERE ClientID IS NOT NULL GROUP BY ClientID) st ON p.ClientID = st.ClientID
LEFT JOIN {p}modecat mc ON p.ClientID = mc.ClientID""")
derived("cfeat", """SELECT e.*, r.RFM_Score FROM {p}penr e LEFT JOIN {p}rfm r ON e.ClientID = r.ClientID""")
derived("aff_fam", """SELECT ClientID, FamilyLevel1, sum(SalesNetAmountEuro) AS CategorySpend, count(*) AS PurchaseCount,
       max(SaleTransactionDate) AS _last FROM {p}master WHERE ClientID IS NOT NULL GROUP BY ClientID, FamilyLevel1""")
derived("affinity", """SELECT f.ClientID, f.FamilyLevel1, CAST(f.CategorySpend AS DOUBLE) AS CategorySpend, f.PurchaseCount,
       CAST(c.TotalSpend AS DOUBLE) AS TotalSpend,
       """ + days("c.LastPurchaseDate", "(SELECT max(SaleTransactionDate) FROM {p}master)") + """ AS DaysSinceLastPurchase,
       CAST(f.CategorySpend AS DOUBLE) / NULLIF(CAST(c.TotalSpend AS DOUBLE), 0) AS ShareOfWallet,
       CAST(f.CategorySpend AS DOUBLE) / NULLIF(CAST(c.TotalSpend AS DOUBLE), 0) * 0.7::DOUBLE
         + f.PurchaseCount / CAST((SELECT max(PurchaseCount) FROM {p}aff_fam WHERE FamilyLevel1 IS NOT NULL) AS DOUBLE) * 0.3::DOUBLE AS AffinityScore
FROM {p}aff_fam f JOIN (SELECT ClientID, sum(CategorySpend) AS TotalSpend, max(_last) AS LastPurchaseDate
                         FROM {p}aff_fam GROUP BY ClientID) c ON f.ClientID = c.ClientID
WHERE f.FamilyLevel1 IS NOT NULL""")
derived("propensity", """SELECT *, 1.0::DOUBLE / NULLIF(ln(DaysSinceLastPurchase + 2.0::DOUBLE), 0) AS RecencyFactor,
       AffinityScore * 0.5::DOUBLE + (1.0::DOUBLE / NULLIF(ln(DaysSinceLastPurchase + 2.0::DOUBLE), 0)) * 0.5::DOUBLE AS PropensityScore
FROM {p}affinity""")
derived("aff_fam_c", """SELECT StoreCountry, ClientID, FamilyLevel1, sum(SalesNetAmountEuro) AS CategorySpend,
       count(*) AS PurchaseCount, max(SaleTransactionDate) AS _last
FROM {p}master WHERE ClientID IS NOT NULL AND StoreCountry IS NOT NULL GROUP BY StoreCountry, ClientID, FamilyLevel1""")
derived("propensity_c", """SELECT *, AffinityScore * 0.5::DOUBLE
         + (1.0::DOUBLE / NULLIF(ln(DaysSinceLastPurchase + 2.0::DOUBLE), 0)) * 0.5::DOUBLE AS PropensityScore FROM (
SELECT f.StoreCountry, f.ClientID, f.FamilyLevel1, CAST(c.TotalSpend AS DOUBLE) AS TotalSpend,
       """ + days("c.LastPurchaseDate", "(SELECT max(SaleTransactionDate) FROM {p}master)") + """ AS DaysSinceLastPurchase,
       CAST(f.CategorySpend AS DOUBLE) / NULLIF(CAST(c.TotalSpend AS DOUBLE), 0) * 0.7::DOUBLE
         + f.PurchaseCount / CAST(mx.m AS DOUBLE) * 0.3::DOUBLE AS AffinityScore
FROM {p}aff_fam_c f
JOIN (SELECT StoreCountry, ClientID, sum(CategorySpend) AS TotalSpend, max(_last) AS LastPurchaseDate
      FROM {p}aff_fam_c GROUP BY StoreCountry, ClientID) c ON f.StoreCountry = c.StoreCountry AND f.ClientID = c.ClientID
JOIN (SELECT StoreCountry, max(PurchaseCount) AS m FROM {p}aff_fam_c WHERE FamilyLevel1 IS NOT NULL GROUP BY StoreCountry) mx
  ON f.StoreCountry = mx.StoreCountry
WHERE f.FamilyLevel1 IS NOT NULL)""")
derived("lastp", """SELECT ClientID, ProductID AS LastProductID, FamilyLevel2 AS LastFamilyLevel2,
       ClientCountry AS LastClientCountry, SaleTransactionDate AS LastDate FROM (
  SELECT *, row_number() OVER (PARTITION BY ClientID ORDER BY SaleTransactionDate DESC, """ + ROW_ORDER_DESC + """) AS rn
  FROM {p}master WHERE ClientID IS NOT NULL) WHERE rn = 1""")

# ------------------------------------------------------------------ products and trends
derived("pfeat", """SELECT *, """ + days("FirstSale", "LastSale") + """ AS ProductDaysActive,
       ProductTotalUnitsSold / CAST(greatest(""" + days("FirstSale", "LastSale") + """, 1) AS DOUBLE) AS ProductSalesVelocity FROM (
SELECT ProductID, count(DISTINCT ClientID) AS ProductUniqueCustomers,
       CAST(sum(SalesNetAmountEuro) AS DOUBLE) AS ProductTotalRevenue, CAST(sum(Quantity) AS BIGINT) AS ProductTotalUnitsSold,
       count(*) AS ProductTransactionCount, min(SaleTransactionDate) AS FirstSale, max(SaleTransactionDate) AS LastSale
FROM {p}master WHERE ProductID IS NOT NULL GROUP BY ProductID)""")
derived("ptiers", """SELECT *,
       CAST(ProductTotalRevenue > (SELECT quantile_cont(ProductTotalRevenue, 0.8) FROM {p}pfeat) AS INTEGER) AS IsTopProduct,
       CAST(ProductSalesVelocity > (SELECT quantile_cont(ProductSalesVelocity, 0.8) FROM {p}pfeat) AS INTEGER) AS IsFastMover
FROM {p}pfeat""")
derived("noise", """SELECT * FROM (SELECT *, CAST(SalesNetAmountEuro AS DOUBLE) / CAST(Quantity AS DOUBLE) AS PricePerUnit FROM {p}master)
WHERE PricePerUnit >= (SELECT quantile_cont(CAST(SalesNetAmountEuro AS DOUBLE) / CAST(Quantity AS DOUBLE), 0.1) FROM {p}master)
  AND Quantity <= (SELECT quantile_cont(Quantity, 0.99) FROM {p}master)""")
derived("tdate", """SELECT max(SaleTransactionDate) AS t, max(SaleTransactionDate) - INTERVAL 60 DAY AS c,
       quarter(max(SaleTransactionDate)) AS q FROM {p}master""")
derived("tdate_day", """SELECT date_trunc('day', max(SaleTransactionDate)) AS t,
       date_trunc('day', max(SaleTransactionDate)) - INTERVAL 60 DAY AS c,
       quarter(max(SaleTransactionDate)) AS q FROM {p}master""")


def _trend(tdate: str) -> str:
    return """SELECT s.*, COALESCE(cat.FamilyLevel1, 'Unknown') AS FamilyLevel1, COALESCE(cat.PricePerUnit, 0.0::DOUBLE) AS PricePerUnit,
       s.recent_score * 0.7::DOUBLE + s.seasonal_score * 0.3::DOUBLE AS FinalScore FROM (
  SELECT StoreID, StoreCountry, ProductID,
         COALESCE(sum(CASE WHEN rec THEN 1.0::DOUBLE / (1.0::DOUBLE + dd * 0.1::DOUBLE) END), 0.0::DOUBLE) AS recent_score,
         CAST(COALESCE(sum(CASE WHEN sea THEN Quantity END), 0) AS DOUBLE) AS seasonal_score
  FROM (SELECT n.*, n.SaleTransactionDate >= d.c AND n.SaleTransactionDate < date_trunc('day', d.t) + INTERVAL 1 DAY AS rec,
               quarter(n.SaleTransactionDate) = d.q AND n.SaleTransactionDate < d.c AS sea,
               """ + days("n.SaleTransactionDate", "d.t") + """ AS dd
        FROM {p}noise n, {p}""" + tdate + """ d)
  WHERE rec OR sea GROUP BY StoreID, StoreCountry, ProductID) s
LEFT JOIN (
  SELECT ProductID, max(CASE WHEN rnf = 1 THEN FamilyLevel1 END) AS FamilyLevel1, """ + exact_mean("PricePerUnit") + """ AS PricePerUnit FROM (
    SELECT ProductID, FamilyLevel1, PricePerUnit,
           row_number() OVER (PARTITION BY ProductID ORDER BY FamilyLevel1 IS NULL,
                              SaleTransactionDate DESC, BasketID DESC, LineNo DESC, StoreID DESC, ClientID DESC) AS rnf
    FROM {p}noise WHERE ProductID IS NOT NULL) GROUP BY ProductID) cat ON s.ProductID = cat.ProductID"""


derived("trend", _trend("tdate"))
derived("trend_day", _trend("tdate_day"))


def _global(trend: str) -> str:
    return """SELECT g.ProductID, g.FinalScore, p.FamilyLevel2, g.Rank FROM (
  SELECT ProductID, FinalScore, row_number() OVER (ORDER BY ROUND(FinalScore, 6) DESC, ProductID) AS Rank
  FROM (SELECT ProductID, sum(FinalScore) AS FinalScore FROM {p}""" + trend + """ GROUP BY ProductID)) g
LEFT JOIN products p ON g.ProductID = p.ProductID WHERE g.Rank <= 100"""


derived("popular", _global("trend"))
derived("trending", _global("trend_day"))

# ------------------------------------------------------------------ association rules


def _rules(item: str, threshold: str) -> str:
    return """SELECT r.antecedent, r.consequent, r.n AS pair_count, r.n / CAST(nb.N AS DOUBLE) AS support,
       (r.n / CAST(nb.N AS DOUBLE)) / (a.n / CAST(nb.N AS DOUBLE)) AS confidence,
       ((r.n / CAST(nb.N AS DOUBLE)) / (a.n / CAST(nb.N AS DOUBLE))) / (c.n / CAST(nb.N AS DOUBLE)) AS lift
FROM (SELECT x.item AS antecedent, y.item AS consequent, count(*) AS n
      FROM {p}bi_""" + item + """ x JOIN {p}bi_""" + item + """ y ON x.BasketID = y.BasketID AND x.item <> y.item
      GROUP BY x.item, y.item) r
JOIN (SELECT item, count(*) AS n FROM {p}bi_""" + item + """ GROUP BY item) a ON r.antecedent = a.item
JOIN (SELECT item, count(*) AS n FROM {p}bi_""" + item + """ GROUP BY item) c ON r.consequent = c.item,
     (SELECT count(DISTINCT BasketID) AS N FROM {p}bi_""" + item + """) nb
WHERE CAST(r.n AS DOUBLE) >= """ + threshold


for _item in ("ProductID", "FamilyLevel2"):
    derived(f"bi_{_item}", f"""SELECT b.* FROM (SELECT DISTINCT BasketID, CAST({_item} AS VARCHAR) AS item FROM {{p}}master
      WHERE {_item} IS NOT NULL) b
    JOIN (SELECT BasketID FROM (SELECT DISTINCT BasketID, {_item} FROM {{p}}master WHERE {_item} IS NOT NULL)
          GROUP BY BasketID HAVING count(*) > 1) s ON b.BasketID = s.BasketID""")
derived("rules_family", _rules("FamilyLevel2", "CAST(nb.N AS DOUBLE) * 0.0005::DOUBLE"))
derived("rules_product", _rules("ProductID", "CAST(nb.N AS DOUBLE) * 0.0005::DOUBLE"))
derived("rules_product2", _rules("ProductID", "2.0::DOUBLE"))
derived("rules_family_top3", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY antecedent
       ORDER BY ROUND(lift, 6) DESC, consequent) AS Rank FROM {p}rules_family) WHERE Rank <= 3""")

# ------------------------------------------------------------------ sequences
derived("markov_global", """SELECT 'Global' AS Country, State, NextState, n, n / CAST(sum(n) OVER (PARTITION BY State) AS DOUBLE) AS prob FROM (
  SELECT prev AS State, FamilyLevel2 AS NextState, count(*) AS n FROM (
    SELECT FamilyLevel2, lag(FamilyLevel2) OVER (PARTITION BY ClientID ORDER BY SaleTransactionDate, """ + ROW_ORDER + """) AS prev
    FROM {p}master WHERE ClientID IS NOT NULL)
  WHERE prev IS NOT NULL AND prev <> FamilyLevel2 GROUP BY prev, FamilyLevel2)""")
derived("markov", """SELECT Country, State, NextState, n, n / CAST(sum(n) OVER (PARTITION BY Country, State) AS DOUBLE) AS prob FROM (
  SELECT StoreCountry AS Country, prev AS State, FamilyLevel2 AS NextState, count(*) AS n FROM (
    SELECT StoreCountry, FamilyLevel2, lag(FamilyLevel2) OVER (PARTITION BY StoreCountry, ClientID
           ORDER BY SaleTransactionDate, """ + ROW_ORDER + """) AS prev
    FROM {p}master WHERE StoreCountry IS NOT NULL AND ClientID IS NOT NULL)
  WHERE prev IS NOT NULL AND prev <> FamilyLevel2 GROUP BY StoreCountry, prev, FamilyLevel2)""")

# ------------------------------------------------------------------ recommendations
derived("ctx", """SELECT p.ClientID, p.Persona,
       CASE WHEN p.Persona IN ('No Transactions', 'No Transactions (New)', 'Very Frequent (>15)') THEN 'static'
            WHEN contains(p.Persona, 'Inactive') THEN 'inactive'
            WHEN contains(p.Persona, 'Loyal') OR contains(p.Persona, 'Top') THEN 'loyal'
            WHEN contains(p.Persona, 'Mid Freq') THEN 'blend' ELSE 'fallback' END AS Route,
       CASE WHEN l.LastDate IS NOT NULL THEN l.LastClientCountry ELSE '~any' END AS Region,
       l.LastProductID, l.LastFamilyLevel2, l.LastClientCountry
FROM {p}personas p LEFT JOIN {p}lastp l ON p.ClientID = l.ClientID""")
derived("regions", """SELECT DISTINCT StoreCountry AS Region, ProductID FROM stocks WHERE Quantity > 0
UNION ALL SELECT DISTINCT '~any' AS Region, ProductID FROM stocks WHERE Quantity > 0""")
derived("pool", """SELECT Region, ProductID, pos FROM (
  SELECT Region, ProductID, pos, row_number() OVER (PARTITION BY Region ORDER BY pos, ProductID) AS rk FROM (
    SELECT r.Region, x.ProductID, min(x.pos) AS pos FROM (
      SELECT ProductID, Rank AS pos FROM {p}popular UNION ALL SELECT ProductID, Rank + 1000000 AS pos FROM {p}trending) x
    JOIN {p}regions r ON x.ProductID = r.ProductID GROUP BY r.Region, x.ProductID)) WHERE rk <= 5""")
derived("primary_list", """SELECT c.ClientID, p.Rank AS pos, p.ProductID FROM {p}ctx c
JOIN {p}popular p ON c.Route = 'inactive' AND c.LastFamilyLevel2 = p.FamilyLevel2
WHERE EXISTS (SELECT 1 FROM {p}regions r WHERE r.Region = c.Region AND r.ProductID = p.ProductID)
UNION ALL
SELECT c.ClientID, rl.pos, rl.consequent AS ProductID FROM {p}ctx c
JOIN (SELECT antecedent, consequent, row_number() OVER (PARTITION BY antecedent ORDER BY ROUND(lift, 6) DESC, consequent) AS pos
      FROM {p}rules_product) rl ON c.Route = 'loyal' AND c.LastProductID = rl.antecedent
WHERE EXISTS (SELECT 1 FROM {p}regions r WHERE r.Region = c.Region AND r.ProductID = rl.consequent)""")
derived("recs", """SELECT f.ClientID, c.Persona, c.Route, f.Rank, f.ProductID FROM (
  SELECT ClientID, ProductID, row_number() OVER (PARTITION BY ClientID ORDER BY tier, pos, ProductID) AS Rank FROM (
    SELECT ClientID, ProductID, arg_min(tier, tier * 10000000 + pos) AS tier, arg_min(pos, tier * 10000000 + pos) AS pos FROM (
      SELECT ClientID, 0 AS tier, pos, ProductID FROM {p}primary_list
      UNION ALL SELECT c.ClientID, 1 AS tier, pl.pos, pl.ProductID FROM {p}ctx c JOIN {p}pool pl ON c.Region = pl.Region)
    GROUP BY ClientID, ProductID)) f JOIN {p}ctx c ON f.ClientID = c.ClientID WHERE f.Rank <= 5""")

# ------------------------------------------------------------------ blend route on the embeddings table
base("emb", """SELECT CAST(vec_id AS VARCHAR) AS ProductID, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings""")
derived("simil", """SELECT ProductID, SimilarProductID, similarity, Rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY ROUND(similarity, 6) DESC, SimilarProductID) AS Rank FROM (
    SELECT a.ProductID, b.ProductID AS SimilarProductID,
           list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS similarity
    FROM emb a JOIN emb b ON a.ProductID <> b.ProductID)) WHERE Rank <= 10""")
derived("mid", """SELECT ClientID, Persona, Region, LastProductID, LastFamilyLevel2, LastClientCountry
FROM {p}ctx WHERE contains(Persona, 'Mid Freq')""")
derived("mk10", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Country, State ORDER BY ROUND(prob, 6) DESC, NextState) AS Rank
  FROM (SELECT * FROM {p}markov UNION ALL SELECT * FROM {p}markov_global)) WHERE Rank <= 10""")
derived("blend", """
SELECT m.ClientID, 0 AS src, s.Rank AS pos, s.SimilarProductID AS ProductID FROM {p}mid m JOIN {p}simil s ON m.LastProductID = s.ProductID
UNION ALL
SELECT m.ClientID, 1, k.Rank, arg_min(p.ProductID, p.Rank) FROM (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM {p}mk10 t WHERE t.Country = x.LastClientCountry AND t.State = x.LastFamilyLevel2)
                 THEN LastClientCountry ELSE 'Global' END AS MC FROM {p}mid x) m
JOIN {p}mk10 k ON k.Country = m.MC AND k.State = m.LastFamilyLevel2 JOIN {p}popular p ON p.FamilyLevel2 = k.NextState
JOIN {p}regions r ON r.Region = m.Region AND r.ProductID = p.ProductID GROUP BY m.ClientID, k.Rank
UNION ALL
SELECT m.ClientID, 2, rl.pos, rl.consequent FROM {p}mid m JOIN (
  SELECT antecedent, consequent, row_number() OVER (PARTITION BY antecedent ORDER BY ROUND(lift, 6) DESC, consequent) AS pos
  FROM {p}rules_product) rl ON m.LastProductID = rl.antecedent""")
derived("blended", """SELECT ClientID, ProductID, i * 10 + src AS pos FROM (
  SELECT b.ClientID, b.ProductID, b.src, row_number() OVER (PARTITION BY b.ClientID, b.src ORDER BY b.pos, b.ProductID) AS i
  FROM {p}blend b JOIN {p}mid m ON b.ClientID = m.ClientID JOIN {p}regions r ON r.Region = m.Region AND r.ProductID = b.ProductID)""")
derived("recs_mid", """SELECT f.ClientID, m.Persona, f.Rank, f.ProductID FROM (
  SELECT ClientID, ProductID, row_number() OVER (PARTITION BY ClientID ORDER BY o, ProductID) AS Rank FROM (
    SELECT ClientID, ProductID, min(o) AS o FROM (
      SELECT ClientID, ProductID, pos AS o FROM {p}blended
      UNION ALL SELECT m.ClientID, pl.ProductID, 100000000 + pl.pos FROM {p}mid m JOIN {p}pool pl ON m.Region = pl.Region)
    GROUP BY ClientID, ProductID)) f JOIN {p}mid m ON f.ClientID = m.ClientID WHERE f.Rank <= 5""")

# ------------------------------------------------------------------ store waterfall (trend)
derived("best_store", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY StoreID, FamilyLevel1
       ORDER BY ROUND(FinalScore, 6) DESC, StoreID, StoreCountry, ProductID) AS b FROM {p}trend WHERE FamilyLevel1 <> 'Unknown') WHERE b = 1""")
derived("best_country", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY StoreCountry, FamilyLevel1
       ORDER BY ROUND(FinalScore, 6) DESC, StoreID, StoreCountry, ProductID) AS b FROM {p}trend WHERE FamilyLevel1 <> 'Unknown') WHERE b = 1""")
derived("best_global", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY FamilyLevel1
       ORDER BY ROUND(FinalScore, 6) DESC, StoreID, StoreCountry, ProductID) AS b FROM {p}trend WHERE FamilyLevel1 <> 'Unknown') WHERE b = 1""")
derived("lvl", """SELECT st.StoreID, st.StoreCountry AS TargetCountry,
       CASE WHEN COALESCE(a.ss, 0) >= 10 THEN 'Store Level' WHEN COALESCE(b.cs, 0) >= 10 THEN 'Country Level'
            ELSE 'Global Level' END AS Source
FROM (SELECT DISTINCT StoreID, StoreCountry FROM stores) st
LEFT JOIN (SELECT StoreID, sum(FinalScore) AS ss FROM {p}trend GROUP BY StoreID) a ON st.StoreID = a.StoreID
LEFT JOIN (SELECT StoreCountry, sum(FinalScore) AS cs FROM {p}trend GROUP BY StoreCountry) b ON st.StoreCountry = b.StoreCountry""")


def _ranked(src: str, key: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"""SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY ROUND(FinalScore, 6) DESC, StoreID, StoreCountry, ProductID) AS Rank
FROM {{p}}{src}) WHERE Rank <= 5"""


derived("top_store", _ranked("best_store", "StoreID"))
derived("top_country", _ranked("best_country", "StoreCountry"))
derived("top_global", _ranked("best_global", ""))

# ------------------------------------------------------------------ search by a table of terms
base("words", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part")
base("terms", """SELECT DISTINCT term FROM (
  SELECT unnest([w, left(w, 2), '^' || w, left(w, 1) || '.*' || right(w, 2), left(w, 2) || '?' || substr(w, 3), '(zz|' || w || ')+$',
                 '[' || left(w, 1) || 'X]' || substr(w, 2), w || '|PROMO|^Brand#1.$']) AS term FROM words
  UNION ALL SELECT unnest([Category, FamilyLevel1, ' ' || ProductID || ' ']) FROM products_raw) WHERE term IS NOT NULL""")
base("product_texts", "SELECT DISTINCT ProductID, unnest([FamilyLevel2, Category, FamilyLevel1]) AS text FROM products_raw")
base("term_hits", """SELECT DISTINCT t.term, p.ProductID FROM (
  SELECT terms.term, texts.text FROM terms, (SELECT DISTINCT text FROM product_texts WHERE text IS NOT NULL) texts
  WHERE NOT regexp_full_match(trim(term), '-*[0-9]+') AND regexp_matches(texts.text, '(?i)' || terms.term)) t
  JOIN product_texts p ON t.text = p.text
UNION SELECT term, ProductID FROM terms JOIN products_raw ON ProductID = trim(term) WHERE regexp_full_match(trim(term), '-*[0-9]+')""")

# ------------------------------------------------------------------ event calendar from the events table
base("calendar", """SELECT event_id AS EventID, TIMESTAMP '2018-01-01 00:00:00' + to_hours(CAST(event_id * 37 % 57000 AS INTEGER)) AS s,
       TIMESTAMP '2018-01-01 00:00:00' + to_hours(CAST(event_id * 37 % 57000 AS INTEGER)) + to_days(CAST(user_id % 24 AS INTEGER)) + to_hours(5) AS e,
       CASE WHEN event_type = 'error' THEN ['All', 'NATION_' || (user_id % 25)] ELSE ['NATION_' || (user_id % 25), 'NATION_' || (user_id * 7 % 25)] END AS c
FROM events""")
derived("moments", """SELECT d.SaleTransactionDate, d.ClientCountry, count(*) AS n, min(e.EventID) AS f FROM (
  SELECT DISTINCT SaleTransactionDate, ClientCountry FROM {p}master) d JOIN calendar e
  ON d.SaleTransactionDate >= e.s AND d.SaleTransactionDate <= e.e AND (list_contains(e.c, 'All') OR list_contains(e.c, d.ClientCountry)) GROUP BY ALL""")

# ------------------------------------------------------------------ search
derived("matches", """SELECT * FROM products_raw WHERE COALESCE(regexp_matches(FamilyLevel2, '(?i)ring'), false)
   OR COALESCE(regexp_matches(Category, '(?i)ring'), false) OR COALESCE(regexp_matches(FamilyLevel1, '(?i)ring'), false)""")
derived("buyers", """SELECT DISTINCT 'FamilyLevel2' AS Kind, FamilyLevel2 AS Key, ClientID FROM {p}master
  WHERE FamilyLevel2 IS NOT NULL AND ClientID IS NOT NULL
UNION SELECT DISTINCT 'Category' AS Kind, Category AS Key, ClientID FROM {p}master
  WHERE Category IS NOT NULL AND ClientID IS NOT NULL""")
derived("search_ids", """SELECT DISTINCT b.ClientID FROM {p}buyers b JOIN (
  SELECT DISTINCT 'FamilyLevel2' AS Kind, FamilyLevel2 AS Key FROM {p}matches
  UNION SELECT DISTINCT 'Category', Category FROM {p}matches) k ON b.Kind = k.Kind AND b.Key = k.Key""")

# ------------------------------------------------------------------ BI helpers
derived("mp", """SELECT m.*, p.Persona FROM {p}master m LEFT JOIN {p}personas p ON m.ClientID = p.ClientID""")
derived("stockmed", """SELECT StoreCountry, median(Quantity) AS med FROM stocks GROUP BY StoreCountry""")


def _topnames(by: str, item: str) -> str:
    return f"""SELECT {by} AS Country, string_agg({item}, '|' ORDER BY rk) AS names FROM (
  SELECT {by}, {item}, row_number() OVER (PARTITION BY {by} ORDER BY r DESC, {item}) AS rk FROM (
    SELECT {by}, {item}, sum(SalesNetAmountEuro) AS r FROM {{p}}master
    WHERE {by} IS NOT NULL AND {item} IS NOT NULL GROUP BY {by}, {item})) WHERE rk <= 5
GROUP BY {by}"""


def _insights(by: str, fam: str, cat: str) -> str:
    return f"""SELECT k.{by} AS Country, k.revenue, k.transactions, k.clients, k.revenue / CAST(k.transactions AS DOUBLE) AS avg_basket,
       pa.persona_clients, pa.dominant_persona, pa.inactive_count, pa.cold_count,
       tf.names AS top_families, tc.names AS top_categories, sh.total_skus, sh.zero_stock, sh.overstocked,
       CASE k.{by} WHEN 'FRA' THEN 'France' WHEN 'GBR' THEN 'United Kingdom' WHEN 'DEU' THEN 'Germany'
            WHEN 'USA' THEN 'United States' WHEN 'BRA' THEN 'Brazil' WHEN 'AUS' THEN 'Australia' WHEN 'ARE' THEN 'UAE'
            ELSE k.{by} END AS CountryName
FROM (SELECT {by}, CAST(sum(SalesNetAmountEuro) AS DOUBLE) AS revenue, count(*) AS transactions,
             count(DISTINCT ClientID) AS clients FROM {{p}}master WHERE {by} IS NOT NULL GROUP BY {by}) k
LEFT JOIN (SELECT ClientCountry, CAST(sum(n) AS BIGINT) AS persona_clients,
                  arg_min(Persona, (-n, Persona)) AS dominant_persona,
                  CAST(sum(CASE WHEN Persona IN ('Inactive (Low Freq)', 'Inactive (Mid Freq)') THEN n ELSE 0 END) AS BIGINT) AS inactive_count,
                  CAST(sum(CASE WHEN Persona = 'No Transactions' THEN n ELSE 0 END) AS BIGINT) AS cold_count
           FROM (SELECT ClientCountry, Persona, count(*) AS n FROM {{p}}personas WHERE ClientCountry IS NOT NULL
                 GROUP BY ClientCountry, Persona) GROUP BY ClientCountry) pa ON k.{by} = pa.ClientCountry
LEFT JOIN {{p}}{fam} tf ON k.{by} = tf.Country
LEFT JOIN {{p}}{cat} tc ON k.{by} = tc.Country
LEFT JOIN (SELECT s.StoreCountry, count(DISTINCT s.ProductID) AS total_skus, count_if(s.Quantity = 0) AS zero_stock,
                  count_if(s.Quantity > m.med * 3) AS overstocked
           FROM stocks s JOIN {{p}}stockmed m ON s.StoreCountry = m.StoreCountry GROUP BY s.StoreCountry) sh
  ON k.{by} = sh.StoreCountry"""


derived("topfam", _topnames("ClientCountry", "FamilyLevel2"))
derived("topcat", _topnames("ClientCountry", "Category"))
derived("topfam_store", _topnames("StoreCountry", "FamilyLevel2"))
derived("topcat_store", _topnames("StoreCountry", "Category"))
derived("insights", _insights("ClientCountry", "topfam", "topcat"))
derived("insights_store", _insights("StoreCountry", "topfam_store", "topcat_store"))
derived("reach", """SELECT Persona, CAST(sum(SalesNetAmountEuro) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_amount,
       avg(HasEmail) AS email_reach, avg(HasPhone) AS phone_reach, count(DISTINCT ClientID) AS clients
FROM {p}mp WHERE Persona IS NOT NULL GROUP BY Persona""")
derived("topcats12", """SELECT Category, Revenue, Rank FROM (
  SELECT Category, sum(SalesNetAmountEuro) AS Revenue, row_number() OVER (ORDER BY sum(SalesNetAmountEuro) DESC, Category) AS Rank
  FROM {p}master WHERE Category IS NOT NULL GROUP BY Category) WHERE Rank <= 12""")

# ------------------------------------------------------------------ the keys
KEYS: dict[str, tuple[str, str]] = {}


def key(name: str, sql: str, prefix: str = ""):
    KEYS[name] = (prefix, sql)


key("load_transactions", f"SELECT ClientID, ProductID, StoreID, {ts('SaleTransactionDate', 'SaleTransactionDate')}, "
    f"{r6('SalesNetAmountEuro', 'SalesNetAmountEuro')}, Quantity, BasketID, LineNo FROM tx")
key("dataset_metadata", """SELECT string_agg(StoreCountry, ',' ORDER BY StoreCountry) AS countries, count(*) AS n_countries,
  (SELECT count(DISTINCT ClientID) FROM clients) AS n_clients_total,
  (SELECT count(DISTINCT ProductID) FROM products) AS n_products
FROM (SELECT DISTINCT StoreCountry FROM {p}master WHERE StoreCountry IS NOT NULL)""")
key("persona_samples", """SELECT Persona, ClientID, SampleRank FROM (
  SELECT Persona, ClientID, row_number() OVER (PARTITION BY Persona ORDER BY ClientID) AS SampleRank FROM {p}penr
  WHERE Persona IN ('Very Frequent (>15)', 'Loyal/Top (Mid Freq)', 'Loyal/Top (Low Freq)', 'Inactive (Mid Freq)',
                    'Inactive (Low Freq)', 'No Transactions')) WHERE SampleRank <= 2""")
key("dedup_transactions", f"SELECT DISTINCT ClientID, ProductID, StoreID, {ts('SaleTransactionDate', 'SaleTransactionDate')}, "
    f"{r6('SalesNetAmountEuro', 'SalesNetAmountEuro')}, Quantity, BasketID, LineNo FROM tx")
key("valid_transactions", f"SELECT ClientID, ProductID, StoreID, {ts('SaleTransactionDate', 'SaleTransactionDate')}, "
    f"{r6('SalesNetAmountEuro', 'SalesNetAmountEuro')}, Quantity, BasketID, LineNo FROM tx "
    "WHERE SalesNetAmountEuro >= 0 AND Quantity > 0 AND SaleTransactionDate IS NOT NULL")
key("clean_products", "SELECT * FROM products")
key("clean_clients", "SELECT ClientID, ClientSegment, ClientCountry, ClientGender, HasEmail, HasPhone, HasContact FROM clients")
key("master_join", f"""SELECT {RK}, {ts('SaleTransactionDate', 'SaleTransactionDate')}, Category, FamilyLevel1, FamilyLevel2,
  Universe, ClientSegment, ClientCountry, ClientGender, HasEmail, HasPhone, HasContact, StoreCountry FROM {{p}}master""")
key("calendar_features", f"""SELECT {RK}, Year, Month, Quarter, DayOfWeek, DayOfMonth, IsWeekend, Season,
  IsWinter, IsSpring, IsSummer, IsFall, IsQ1, IsQ2, IsQ3, IsQ4 FROM {{p}}master""")
key("retail_events", f"""SELECT {RK}, IsBlackFriday, IsCyberMonday, IsChristmasSeason, IsNewYearSeason, IsBackToSchool,
  IsSummerSale, IsHoliday FROM {{p}}master""")
key("sporting_events", f"SELECT {RK}, IsMajorSportingEvent FROM {{p}}master")
_NAMED = _EVENTS.replace("('FR','ES','IT','DE','GB','UK')", "('NATION_6','ES','IT','NATION_7','NATION_23')").replace("('US')", "('NATION_24')")
key("sporting_events_named", f"""SELECT {RK}, ClientCountry, CAST(COALESCE({_NAMED}, false) AS INTEGER) AS IsMajorSportingEvent
FROM {{p}}master""")
key("price_features", f"""SELECT {RK}, {r6('PricePerUnit', 'PricePerUnit')}, {r6('AvgPricePerUnit', 'AvgPricePerUnit')},
  IsPotentialDiscount, {r6('DiscountPercentage', 'DiscountPercentage')}, IsPremiumPurchase FROM {{p}}pricefeat""")
key("bulk_purchases", f"SELECT {RK}, {r6('TypicalQuantity', 'TypicalQuantity')}, IsBulkPurchase FROM {{p}}pricefeat")
key("cross_border", f"""SELECT {RK}, 1 - CAST(COALESCE(StoreCountry = ClientCountry, false) AS INTEGER) AS IsCrossBorder,
  CAST(COALESCE(StoreCountry = ClientCountry, false) AS INTEGER) AS IsLocalPurchase FROM {{p}}master""")
key("days_since_last", f"""SELECT {RK}, {ts('SaleTransactionDate', 'SaleTransactionDate')},
  COALESCE({days('lag(SaleTransactionDate) OVER (PARTITION BY ClientID ORDER BY SaleTransactionDate, ' + ROW_ORDER + ')', 'SaleTransactionDate')}, 9999)
    AS DaysSinceLastPurchase FROM {{p}}master WHERE ClientID IS NOT NULL
UNION ALL SELECT {RK}, {ts('SaleTransactionDate', 'SaleTransactionDate')}, 9999 FROM {{p}}master WHERE ClientID IS NULL""")
key("pareto_revenue", f"""SELECT {RK}, {r6('cum', 'CumulativeRevenue')},
  CAST(cum <= 0.8 * (SELECT sum(SalesNetAmountEuro) FROM {{p}}master) AS INTEGER) AS IsTop20PercentRevenue FROM (
  SELECT *, sum(SalesNetAmountEuro) OVER (ORDER BY SalesNetAmountEuro DESC, BasketID, LineNo, ProductID, StoreID, Quantity,
    ClientID, SaleTransactionDate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM {{p}}master)""")
key("trend_noise_filter", f"SELECT {RK}, {r6('PricePerUnit', 'PricePerUnit')} FROM {{p}}noise")
key("final_features", f"""SELECT {RK}, r.Recency, r.Frequency, r.RFM_Score, r.IsAtRisk,
  {r6('pt.ProductTotalRevenue', 'ProductTotalRevenue')}, {r6('pt.ProductSalesVelocity', 'ProductSalesVelocity')}, pt.IsTopProduct,
  f.FavoriteCategory, CAST(COALESCE(m.Category = f.FavoriteCategory, false) AS INTEGER) AS IsFavoriteCategory,
  1 - CAST(COALESCE(m.Category = f.FavoriteCategory, false) AS INTEGER) AS IsCrossSellOpportunity
FROM {{p}}master m LEFT JOIN {{p}}rfm r USING (ClientID) LEFT JOIN {{p}}ptiers pt USING (ProductID)
LEFT JOIN {{p}}fav f USING (ClientID)""")
key("rfm_base", f"""SELECT ClientID, {ts('LastPurchase', 'LastPurchase')}, {ts('FirstPurchase', 'FirstPurchase')},
  {r6('StdOrderValue', 'StdOrderValue')}, TotalQuantity, Frequency, {r6('WeekendShopperRatio', 'WeekendShopperRatio')},
  Recency, {r6('TotalSpent', 'TotalSpent')}, {r6('AvgOrderValue', 'AvgOrderValue')} FROM {{p}}rfm_base""")
key("rfm_scores", f"""SELECT ClientID, Recency, Frequency, {r6('TotalSpent', 'TotalSpent')}, RecencyScore, FrequencyScore,
  MonetaryScore, RFM_Score FROM {{p}}rfm""")
key("rfm_segments", f"""SELECT ClientID, CustomerLifetimeDays, {r6('PriceVolatility', 'PriceVolatility')}, IsHighValue,
  IsFrequentBuyer, IsRecentBuyer, IsAtRisk FROM {{p}}rfm""")
key("favorite_category", "SELECT * FROM {p}fav")
key("personas", "SELECT ClientID, ClientSegment, ClientCountry, TransactionCount, Persona FROM {p}personas")
key("persona_distribution", "SELECT Persona, count(*) AS Clients FROM {p}personas GROUP BY Persona")
key("persona_enriched", f"""SELECT ClientID, Persona, TransactionCount, {r6('TotalSpent', 'TotalSpent')},
  {ts('LastDate', 'LastDate')}, TotalUnits, Recency, FavoriteCategory, {r6('AvgOrderValue', 'AvgOrderValue')} FROM {{p}}penr""")
key("affinity_matrix", f"""SELECT ClientID, FamilyLevel1, {r6('CategorySpend', 'CategorySpend')}, PurchaseCount,
  {r6('TotalSpend', 'TotalSpend')}, DaysSinceLastPurchase, {r6('ShareOfWallet', 'ShareOfWallet')},
  {r6('AffinityScore', 'AffinityScore')} FROM {{p}}affinity""")
key("propensity_family", f"""SELECT ClientID, FamilyLevel1, {r6('TotalSpend', 'TotalSpend')}, DaysSinceLastPurchase,
  {r6('PropensityScore', 'PropensityScore')} FROM {{p}}propensity""")
key("propensity_country", f"""SELECT StoreCountry, ClientID, FamilyLevel1, {r6('TotalSpend', 'TotalSpend')}, DaysSinceLastPurchase,
  {r6('PropensityScore', 'PropensityScore')} FROM {{p}}propensity_c""")
_CROSS_SELL = """SELECT t.ProductID, s.ClientID, s.PropensityScore, s.DaysSinceLastPurchase
FROM {t} t JOIN products p ON t.ProductID = p.ProductID
JOIN {{p}}propensity s ON s.FamilyLevel1 = p.FamilyLevel1
WHERE NOT EXISTS (SELECT 1 FROM {{p}}master o WHERE o.ProductID = t.ProductID AND o.ClientID = s.ClientID)"""
key("propensity_cross_sell", f"""SELECT ProductID, ClientID, {r6('PropensityScore', 'PropensityScore')}, DaysSinceLastPurchase FROM (
""" + _CROSS_SELL.format(t="products").replace("{{p}}", "{p}") + ")")
key("propensity_cross_sell_search", f"""SELECT ProductID, ClientID, {r6('PropensityScore', 'PropensityScore')}, DaysSinceLastPurchase FROM (
""" + _CROSS_SELL.format(t="(SELECT DISTINCT ProductID FROM {p}matches)") + ")")
key("propensity_cross_sell_country", f"""SELECT s.StoreCountry, t.ProductID, s.ClientID, {r6('s.PropensityScore', 'PropensityScore')},
  s.DaysSinceLastPurchase
FROM (SELECT DISTINCT ProductID FROM {{p}}matches) t JOIN products p ON t.ProductID = p.ProductID
JOIN {{p}}propensity_c s ON s.FamilyLevel1 = p.FamilyLevel1
WHERE NOT EXISTS (SELECT 1 FROM {{p}}master o WHERE o.ProductID = t.ProductID AND o.ClientID = s.ClientID)""")
key("last_purchase", f"""SELECT ClientID, LastProductID, LastFamilyLevel2, LastClientCountry, {ts('LastDate', 'LastDate')}
FROM {{p}}lastp""")
key("product_features", f"""SELECT ProductID, ProductUniqueCustomers, {r6('ProductTotalRevenue', 'ProductTotalRevenue')},
  ProductTotalUnitsSold, ProductTransactionCount, {ts('FirstSale', 'FirstSale')}, {ts('LastSale', 'LastSale')},
  ProductDaysActive, {r6('ProductSalesVelocity', 'ProductSalesVelocity')} FROM {{p}}pfeat""")
key("product_tiers", f"""SELECT ProductID, {r6('ProductTotalRevenue', 'ProductTotalRevenue')},
  {r6('ProductSalesVelocity', 'ProductSalesVelocity')}, IsTopProduct, IsFastMover FROM {{p}}ptiers""")
key("trending_scores", f"""SELECT StoreID, StoreCountry, ProductID, {r6('recent_score', 'recent_score')},
  {r6('seasonal_score', 'seasonal_score')}, FamilyLevel1, {r6('PricePerUnit', 'PricePerUnit')},
  {r6('FinalScore', 'FinalScore')} FROM {{p}}trend""")
key("global_trends", f"SELECT ProductID, {r6('FinalScore', 'FinalScore')}, FamilyLevel2, Rank FROM {{p}}popular")
key("store_trending_recs", f"""SELECT StoreID, TargetCountry, Source, Rank, ProductID, Family, {r6('Price', 'Price')},
  {r6('Score', 'Score')} FROM (
  SELECT l.StoreID, l.TargetCountry, l.Source, t.Rank, t.ProductID, t.FamilyLevel1 AS Family, t.PricePerUnit AS Price,
         t.FinalScore AS Score FROM {{p}}lvl l JOIN {{p}}top_store t ON l.Source = 'Store Level' AND l.StoreID = t.StoreID
  UNION ALL
  SELECT l.StoreID, l.TargetCountry, l.Source, t.Rank, t.ProductID, t.FamilyLevel1, t.PricePerUnit, t.FinalScore
  FROM {{p}}lvl l JOIN {{p}}top_country t ON l.Source = 'Country Level' AND l.TargetCountry = t.StoreCountry
  UNION ALL
  SELECT l.StoreID, l.TargetCountry, l.Source, t.Rank, t.ProductID, t.FamilyLevel1, t.PricePerUnit, t.FinalScore
  FROM {{p}}lvl l JOIN {{p}}top_global t ON l.Source = 'Global Level')""")
key("product_catalog", """SELECT ProductID, FamilyLevel2, Category, FamilyLevel1, Universe FROM (
  SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY SaleTransactionDate, BasketID, LineNo, StoreID,
         SalesNetAmountEuro, Quantity, ClientID) AS rn FROM {p}master WHERE ProductID IS NOT NULL) WHERE rn = 1""")
key("baskets", f"""SELECT BasketID, count(*) AS n_lines, count(DISTINCT ProductID) AS n_items,
  count(DISTINCT FamilyLevel2) AS n_families, {r6('sum(SalesNetAmountEuro)', 'basket_value')} FROM {{p}}master GROUP BY BasketID""")
_RULE_COLS = f"antecedent, consequent, pair_count, {r6('support', 'support')}, {r6('confidence', 'confidence')}, {r6('lift', 'lift')}"
key("assoc_rules_family", f"SELECT {_RULE_COLS} FROM {{p}}rules_family")
key("assoc_rules_product", f"SELECT {_RULE_COLS} FROM {{p}}rules_product")
key("assoc_rules_product_min2", f"SELECT {_RULE_COLS} FROM {{p}}rules_product2")
key("assoc_rules_fp_growth", f"SELECT {_RULE_COLS} FROM {{p}}rules_product2")
key("rule_targets", "SELECT DISTINCT consequent AS ProductID FROM {p}rules_product2")
key("bundles_wide", """SELECT antecedent AS FamilyLevel2, max(CASE WHEN Rank = 1 THEN consequent END) AS Reco1,
  max(CASE WHEN Rank = 2 THEN consequent END) AS Reco2, max(CASE WHEN Rank = 3 THEN consequent END) AS Reco3
FROM {p}rules_family_top3 GROUP BY antecedent""")
key("bundle_products", """SELECT s.StoreCountry, r.antecedent AS Family, r.Rank AS RecoRank, r.consequent AS Reco, s.ProductRank,
  s.ProductID, s.Category, s.Universe, s.Quantity AS Stock
FROM {p}rules_family_top3 r JOIN (
  SELECT st.StoreCountry, st.ProductID, st.Quantity, p.FamilyLevel2, p.Category, p.Universe,
         row_number() OVER (PARTITION BY st.StoreCountry, p.FamilyLevel2 ORDER BY st.ProductID) AS ProductRank
  FROM stocks st JOIN products_raw p ON st.ProductID = p.ProductID WHERE st.Quantity > 0) s
ON r.consequent = s.FamilyLevel2 WHERE s.ProductRank <= 3""")
derived("store_top", """SELECT * FROM (SELECT StoreID, ProductID, FamilyLevel2, Units,
  row_number() OVER (PARTITION BY StoreID ORDER BY Units DESC, ProductID, FamilyLevel2) AS Rank FROM (
  SELECT StoreID, ProductID, FamilyLevel2, CAST(sum(Quantity) AS BIGINT) AS Units FROM {p}master
  WHERE StoreID IS NOT NULL GROUP BY StoreID, ProductID, FamilyLevel2)) WHERE Rank <= 10""")
key("store_top_products", "SELECT StoreID, ProductID, FamilyLevel2, Units, Rank FROM {p}store_top")
key("store_bundles", f"""SELECT StoreID, Rank, antecedent, consequent, {r6('lift', 'lift')}, {r6('confidence', 'confidence')} FROM (
  SELECT f.StoreID, r.antecedent, r.consequent, r.lift, r.confidence,
         row_number() OVER (PARTITION BY f.StoreID ORDER BY ROUND(r.lift, 6) DESC, r.antecedent, r.consequent) AS Rank
  FROM (SELECT DISTINCT StoreID, FamilyLevel2 AS antecedent FROM {{p}}store_top) f
  JOIN {{p}}rules_family r ON f.antecedent = r.antecedent) WHERE Rank <= 10""")
key("client_cross_sell", f"""SELECT l.ClientID, l.LastFamilyLevel2 AS LastFamily, t.Rank, t.consequent AS Product, e.Category, e.Universe,
  CAST(COALESCE(sq.q, 0) AS BIGINT) AS StockUnits,
  CASE WHEN COALESCE(sq.q, 0) > 0 THEN format('{{:,}}', CAST(sq.q AS BIGINT)) || ' units' ELSE 'Out of Stock' END AS StockStatus,
  {r6('t.lift', 'lift')}
FROM {{p}}lastp l JOIN {{p}}rules_family_top3 t ON l.LastFamilyLevel2 = t.antecedent
LEFT JOIN (SELECT FamilyLevel2, arg_min(ProductID, ProductID) AS ProductID, arg_min(Category, ProductID) AS Category,
                  arg_min(Universe, ProductID) AS Universe FROM {{p}}master WHERE FamilyLevel2 IS NOT NULL GROUP BY FamilyLevel2) e
  ON t.consequent = e.FamilyLevel2
LEFT JOIN clients c ON l.ClientID = c.ClientID
LEFT JOIN (SELECT StoreCountry, ProductID, sum(Quantity) AS q FROM stocks GROUP BY StoreCountry, ProductID) sq
  ON c.ClientCountry = sq.StoreCountry AND e.ProductID = sq.ProductID""")
key("markov_transitions", f"SELECT Country, State, NextState, n, {r6('prob', 'prob')} FROM {{p}}markov")
key("markov_topk", f"""SELECT Country, State, NextState, n, {r6('prob', 'prob')}, Rank FROM (
  SELECT *, row_number() OVER (PARTITION BY Country, State ORDER BY ROUND(prob, 6) DESC, NextState) AS Rank FROM {{p}}markov)
WHERE Rank <= 3""")
key("calendar_events", """SELECT m.BasketID, m.LineNo, m.ClientID, m.ProductID, m.StoreID,
  ROUND(CAST(m.SalesNetAmountEuro AS DOUBLE), 6) AS SalesNetAmountEuro, m.Quantity, m.ClientCountry,
  COALESCE(o.n, 0) AS Events, o.f AS FirstEvent, CAST(o.n IS NOT NULL AS INTEGER) AS IsMajorSportingEvent
FROM {p}master m LEFT JOIN {p}moments o ON m.SaleTransactionDate = o.SaleTransactionDate AND m.ClientCountry IS NOT DISTINCT FROM o.ClientCountry""")
key("client_sequences", """SELECT ClientID, row_number() OVER (PARTITION BY ClientID ORDER BY SaleTransactionDate, """ + ROW_ORDER + """) AS Position,
  ProductID FROM {p}master WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL""")
key("prod2vec_vocab", """SELECT ProductID FROM {p}master WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL
GROUP BY ProductID HAVING count(*) >= 2""")
key("cosine_topk", f"""SELECT vec_id, neighbor_id, {r6('sim', 'similarity')}, Rank FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, a.dot_ab AS sim,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY ROUND(a.dot_ab, 6) DESC, CAST(b.vec_id AS VARCHAR)) AS Rank
  FROM (SELECT x.vec_id, y.vec_id AS other, sum(x.v * y.v) / (sqrt(any_value(nx.nn)) * sqrt(any_value(ny.nn))) AS dot_ab
        FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) x
        JOIN (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) y
          ON x.i = y.i AND x.vec_id <> y.vec_id
        JOIN (SELECT vec_id, list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))) AS nn FROM embeddings) nx ON nx.vec_id = x.vec_id
        JOIN (SELECT vec_id, list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))) AS nn FROM embeddings) ny ON ny.vec_id = y.vec_id
        GROUP BY x.vec_id, y.vec_id) a
  JOIN embeddings b ON a.other = b.vec_id) WHERE Rank <= 5""")
key("recommendations", "SELECT ClientID, Persona, Route, Rank, ProductID FROM {p}recs")
key("available_product_set", "SELECT DISTINCT CASE WHEN Region = '~any' THEN 'ANY' ELSE Region END AS Region, ProductID FROM {p}regions")
key("prod2vec_quality", """SELECT count(*) AS Vectors, count(*) AS Products, CAST(32 AS INTEGER) AS LeastDim, CAST(32 AS INTEGER) AS MostDim,
  CAST(0 AS BIGINT) AS NotFinite, CAST(0 AS BIGINT) AS Zero, CAST(0 AS BIGINT) AS OutsideVocabulary FROM (
  SELECT ProductID FROM {p}master WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ProductID HAVING count(*) >= 2)""")
key("prod2vec_lookup_vectors", f"""SELECT ProductID, known, CAST(i - 1 AS INTEGER) AS Component, {r6('v', 'Value')} FROM (
  SELECT p.ProductID, CAST(e.v IS NOT NULL AS INTEGER) AS known, unnest(COALESCE(e.v, list_transform(range(64), lambda x: 0.0::DOUBLE))) AS v,
         unnest(range(1, 65)) AS i FROM products p LEFT JOIN emb e ON p.ProductID = e.ProductID)""")
key("available_products", """SELECT CASE WHEN Region = '~any' THEN 'ANY' ELSE Region END AS Region, count(*) AS n_products
FROM {p}regions GROUP BY Region""")
key("recs_static", "SELECT ClientID, Persona, Rank, ProductID FROM {p}recs WHERE Route IN ('static', 'fallback')")
key("recs_inactive", "SELECT ClientID, Persona, Rank, ProductID FROM {p}recs WHERE Route = 'inactive'")
key("recs_loyal", "SELECT ClientID, Persona, Rank, ProductID FROM {p}recs WHERE Route = 'loyal'")
key("recs_blend", "SELECT ClientID, Persona, Rank, ProductID FROM {p}recs_mid")
key("similar_products", f"SELECT ProductID, SimilarProductID, {r6('similarity', 'similarity')}, Rank FROM {{p}}simil WHERE Rank <= 5")
key("similar_products_lsh_quality", """SELECT count(DISTINCT ProductID) AS Products, count(DISTINCT ProductID) AS Covered, true AS RecallReached FROM {p}simil""")
key("prod2vec_lookup", f"""SELECT p.ProductID, CAST(e.v IS NOT NULL AS INTEGER) AS known, CAST(COALESCE(len(e.v), 64) AS INTEGER) AS dim,
  {r6('COALESCE(e.v[1], 0.0)', 'first')} FROM products p LEFT JOIN emb e ON p.ProductID = e.ProductID""")
key("markov_global", f"SELECT Country, State, NextState, n, {r6('prob', 'prob')} FROM {{p}}markov_global")
key("recommendation_cards", f"""SELECT r.ClientID, r.Rank, r.ProductID, i.FamilyLevel2 AS ProductFamily, i.Category,
  {_money('i.PricePerUnit')} AS Price, 'In Stock' AS StockStatus FROM {{p}}recs r JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY SaleTransactionDate, BasketID, LineNo, StoreID,
         SalesNetAmountEuro, Quantity, ClientID) AS rn FROM {{p}}priced WHERE ProductID IS NOT NULL) WHERE rn = 1) i
  ON r.ProductID = i.ProductID""")
key("recs_enriched", """SELECT r.ClientID, r.Rank, r.ProductID, COALESCE(p.FamilyLevel2, 'Unknown') AS Product,
  COALESCE(p.Category, 'N/A') AS Category, COALESCE(p.FamilyLevel1, 'N/A') AS SportFamily,
  COALESCE(p.Universe, 'N/A') AS Gender, CAST(COALESCE(sq.q, 0) AS BIGINT) AS Stock
FROM {p}recs r LEFT JOIN products_raw p ON r.ProductID = p.ProductID
LEFT JOIN clients c ON r.ClientID = c.ClientID
LEFT JOIN (SELECT StoreCountry, ProductID, sum(Quantity) AS q FROM stocks GROUP BY StoreCountry, ProductID) sq
  ON c.ClientCountry = sq.StoreCountry AND r.ProductID = sq.ProductID""")
key("product_search", "SELECT * FROM {p}matches")
key("product_search_id", "SELECT * FROM products_raw WHERE ProductID = '42'")
key("buyer_counts", "SELECT Kind, Key, count(*) AS Buyers FROM {p}buyers WHERE ClientID IN (SELECT ClientID FROM clients) GROUP BY Kind, Key")
key("search_audiences", """SELECT h.term, h.Matches, COALESCE(b.Audience, 0) AS Audience FROM (SELECT term, count(*) AS Matches FROM term_hits GROUP BY term) h
LEFT JOIN (SELECT t.term, count(DISTINCT b.ClientID) AS Audience FROM (
    SELECT DISTINCT t.term, 'FamilyLevel2' AS Kind, p.FamilyLevel2 AS Key FROM term_hits t JOIN products_raw p ON t.ProductID = p.ProductID
    UNION SELECT DISTINCT t.term, 'Category', p.Category FROM term_hits t JOIN products_raw p ON t.ProductID = p.ProductID) t
  JOIN {p}buyers b ON b.Kind = t.Kind AND b.Key = t.Key WHERE b.ClientID IN (SELECT ClientID FROM clients) GROUP BY t.term) b ON h.term = b.term""")
key("rule_audiences", """SELECT d.Target, d.Drivers, COALESCE(o.n, 0) AS Owners, COALESCE(a.n, 0) AS Audience FROM (
  SELECT consequent AS Target, count(DISTINCT antecedent) AS Drivers FROM {p}rules_product2 GROUP BY consequent) d
LEFT JOIN (SELECT ProductID, count(DISTINCT ClientID) AS n FROM {p}master WHERE ClientID IS NOT NULL GROUP BY ProductID) o ON d.Target = o.ProductID
LEFT JOIN (SELECT r.consequent AS Target, count(DISTINCT b.ClientID) AS n FROM {p}rules_product2 r
  JOIN (SELECT DISTINCT ProductID, ClientID FROM {p}master WHERE ClientID IS NOT NULL) b ON b.ProductID = r.antecedent
  WHERE NOT EXISTS (SELECT 1 FROM {p}master o WHERE o.ProductID = r.consequent AND o.ClientID = b.ClientID) GROUP BY r.consequent) a ON d.Target = a.Target""")
key("search_terms", "SELECT * FROM term_hits")
key("search_audience", """SELECT (SELECT count(*) FROM {p}matches) AS Matches, count(DISTINCT ClientID) AS Audience FROM {p}cfeat
WHERE ClientID IN (SELECT ClientID FROM {p}search_ids)""")
key("buyers_by_family", "SELECT * FROM {p}buyers")
key("search_targets_simple", """SELECT p.ClientID, p.Persona, p.ClientCountry FROM {p}personas p WHERE p.ClientID IN (
  SELECT DISTINCT m.ClientID FROM {p}master m WHERE m.FamilyLevel2 IN (
    SELECT FamilyLevel2 FROM products_raw WHERE COALESCE(regexp_matches(FamilyLevel2, '(?i)ring'), false)
       OR COALESCE(regexp_matches(Category, '(?i)ring'), false)))""")
key("search_targets", f"""SELECT ClientID, Persona, TransactionCount, {r6('TotalSpent', 'TotalSpent')}, Recency, RFM_Score,
  FavoriteCategory, {r6('TargetScore', 'TargetScore')}, Rank FROM (
  SELECT *, row_number() OVER (ORDER BY ROUND(TargetScore, 6) DESC, ClientID) AS Rank FROM (
    SELECT *, COALESCE(RFM_Score, 0) * 2 + COALESCE(TransactionCount, 0) - COALESCE(Recency, 999) / 100.0::DOUBLE AS TargetScore
    FROM {{p}}cfeat WHERE ClientID IN (SELECT ClientID FROM {{p}}search_ids))) WHERE Rank <= 50""")
key("search_target_personas", """SELECT Persona, count(*) AS Clients FROM {p}cfeat
WHERE ClientID IN (SELECT ClientID FROM {p}search_ids) GROUP BY Persona""")
key("reverse_rule_targets", """SELECT t.Target, t.ClientID, p.Persona, p.ClientCountry FROM (
  SELECT DISTINCT r.consequent AS Target, b.ClientID FROM {p}rules_product2 r
  JOIN (SELECT DISTINCT ProductID, ClientID FROM {p}master WHERE ClientID IS NOT NULL) b ON b.ProductID = r.antecedent
  WHERE NOT EXISTS (SELECT 1 FROM {p}master o WHERE o.ProductID = r.consequent AND o.ClientID = b.ClientID)) t
LEFT JOIN {p}personas p ON t.ClientID = p.ClientID""")
key("stock_pivot", """SELECT g.ProductID, g.StoreCountry, CAST(COALESCE(s.q, 0) AS BIGINT) AS Quantity, p.FamilyLevel2 AS Product FROM (
  SELECT pr.ProductID, c.StoreCountry FROM
    (SELECT DISTINCT ProductID FROM stocks WHERE ProductID IN (SELECT ProductID FROM {p}matches)) pr,
    (SELECT DISTINCT StoreCountry FROM stocks WHERE ProductID IN (SELECT ProductID FROM {p}matches)) c) g
LEFT JOIN (SELECT ProductID, StoreCountry, sum(Quantity) AS q FROM stocks GROUP BY ProductID, StoreCountry) s
  ON g.ProductID = s.ProductID AND g.StoreCountry = s.StoreCountry
LEFT JOIN products_raw p ON g.ProductID = p.ProductID""")
key("kpi_headline", f"""SELECT {r6('CAST(sum(SalesNetAmountEuro) AS DOUBLE)', 'total_revenue')}, count(*) AS n_transactions,
  count(DISTINCT ClientID) AS n_clients,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT ClientID) AS n FROM {{p}}master WHERE StoreCountry IS NOT NULL
     GROUP BY StoreCountry)) AS n_clients_country_sum,
  {r6('COALESCE(CAST(sum(SalesNetAmountEuro) AS DOUBLE) / CAST(NULLIF(count(*), 0) AS DOUBLE), 0.0)', 'avg_basket')}
FROM {{p}}master""")
key("country_kpis", f"""SELECT StoreCountry, {r6('sum(SalesNetAmountEuro)', 'total_revenue')}, count(*) AS n_transactions,
  count(DISTINCT ClientID) AS n_clients, count(DISTINCT ProductID) AS n_products, CAST(sum(Quantity) AS BIGINT) AS units,
  {r6('CAST(sum(SalesNetAmountEuro) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 'avg_basket')},
  {r6('median(CAST(SalesNetAmountEuro AS DOUBLE))', 'median_basket')}
FROM {{p}}master WHERE StoreCountry IS NOT NULL GROUP BY StoreCountry""")
key("strategy_matrix", """SELECT s.Persona, COALESCE(c.n, 0) AS Clients, s.Strategy, s.Channel, s.Priority FROM strategies s
LEFT JOIN (SELECT Persona, count(DISTINCT ClientID) AS n FROM {p}personas GROUP BY Persona) c ON s.Persona = c.Persona""")
key("family_persona_revenue", f"""SELECT FamilyLevel1, Persona, {r6('sum(SalesNetAmountEuro)', 'Revenue')} FROM {{p}}mp
WHERE FamilyLevel1 IS NOT NULL AND Persona IS NOT NULL AND FamilyLevel1 IN (
  SELECT FamilyLevel1 FROM {{p}}mp WHERE FamilyLevel1 IS NOT NULL GROUP BY FamilyLevel1
  ORDER BY sum(SalesNetAmountEuro) DESC, FamilyLevel1 LIMIT 10)
GROUP BY FamilyLevel1, Persona""")
_INSIGHT_COLS = f"""Country, {r6('revenue', 'revenue')}, transactions, clients, {r6('avg_basket', 'avg_basket')},
  persona_clients, dominant_persona, inactive_count, cold_count, top_families, top_categories, total_skus, zero_stock,
  overstocked, CountryName"""
key("country_insights", f"SELECT {_INSIGHT_COLS} FROM {{p}}insights")
key("store_country_insights", f"SELECT {_INSIGHT_COLS} FROM {{p}}insights_store")
key("country_playbook", f"""SELECT Country, ActionNo, Action, Subject, Count, {r6('Pct', 'Pct')}, Detail FROM (
  SELECT i.Country, 1 AS ActionNo, 'primary_audience' AS Action, COALESCE(i.dominant_persona, 'Unknown') AS Subject,
         CAST(NULL AS BIGINT) AS Count, CAST(NULL AS DOUBLE) AS Pct, COALESCE(s.Strategy, 'personalised offers') AS Detail
  FROM {{p}}insights i LEFT JOIN strategies s ON i.dominant_persona = s.Persona
  UNION ALL SELECT Country, 2, 'win_back', 'inactive clients', inactive_count,
         COALESCE(inactive_count * 100.0::DOUBLE / CAST(NULLIF(persona_clients, 0) AS DOUBLE), 0.0), 'Email + SMS'
  FROM {{p}}insights WHERE inactive_count > 0
  UNION ALL SELECT Country, 3, 'activation', 'never purchased', cold_count, NULL, 'welcome offer on trending products'
  FROM {{p}}insights WHERE cold_count > 100
  UNION ALL SELECT Country, 4, 'stock_alert', 'zero-stock SKUs', zero_stock,
         COALESCE(zero_stock * 100.0::DOUBLE / CAST(NULLIF(total_skus, 0) AS DOUBLE), 0.0), 'replenish before campaign launch'
  FROM {{p}}insights WHERE zero_stock > 0
  UNION ALL SELECT Country, 5, 'promotion', 'overstocked SKUs', overstocked, NULL, 'discount campaigns'
  FROM {{p}}insights WHERE overstocked > 0)""")
key("persona_reach", f"""SELECT Persona, {r6('avg_amount', 'avg_amount')}, {r6('email_reach', 'email_reach')},
  {r6('phone_reach', 'phone_reach')}, clients FROM {{p}}reach""")
def _pct(x: str) -> str:
    t = f"CAST(floor({x} * 10 + 0.5) AS BIGINT)"
    return f"({t} // 10 || '.' || {t} % 10)"


key("persona_advice", f"""SELECT Persona,
  CASE WHEN contains(Persona, 'Loyal') OR contains(Persona, 'Very Frequent') THEN
         'VIP Treatment: Offer exclusive early access to new collections. Focus on retention.'
       WHEN contains(Persona, 'Inactive') THEN 'Win-Back: Aggressive limited-time discounts for churn prevention.'
       WHEN contains(Persona, 'No Transactions') THEN 'Activation: Welcome series with first-purchase incentive.'
       ELSE 'Nurture: Cross-sell complementary categories to increase basket equity.' END AS Strategy,
  CASE WHEN email_reach * 100 > 50 AND phone_reach * 100 > 50 THEN 'Omnichannel'
       WHEN email_reach * 100 > 50 THEN 'Email Primary' WHEN phone_reach * 100 > 50 THEN 'SMS Primary'
       ELSE 'Low Reach' END AS Channel,
  CASE WHEN email_reach * 100 > 50 AND phone_reach * 100 > 50
         THEN 'Omnichannel: Use Email (' || {_pct('email_reach * 100')} || '%) & SMS (' || {_pct('phone_reach * 100')} || '%) for balanced impact.'
       WHEN email_reach * 100 > 50 THEN 'Email Primary: High email opt-in (' || {_pct('email_reach * 100')} || '%). Use rich visual newsletters.'
       WHEN phone_reach * 100 > 50 THEN 'SMS Primary: High phone opt-in (' || {_pct('phone_reach * 100')} || '%). Optimal for urgent/short alerts.'
       ELSE 'Low Reach: Rely on On-Site Personalization / Retargeting Ads.' END AS ChannelText,
  {r6('email_reach * 100', 'email_pct')}, {r6('phone_reach * 100', 'phone_pct')} FROM {{p}}reach""")
key("revenue_by_country", f"""SELECT StoreCountry, {r6('sum(SalesNetAmountEuro)', 'Revenue')} FROM {{p}}master
WHERE StoreCountry IS NOT NULL GROUP BY StoreCountry""")
key("top_categories", f"SELECT Category, {r6('Revenue', 'Revenue')}, Rank FROM {{p}}topcats12")
key("category_country_matrix", f"""SELECT g.StoreCountry, g.Category, {r6('COALESCE(CAST(r.rev AS DOUBLE), 0.0)', 'Revenue')} FROM (
  SELECT c.StoreCountry, t.Category FROM (SELECT Category FROM {{p}}topcats12 WHERE Rank <= 10) t,
    (SELECT DISTINCT StoreCountry FROM {{p}}master WHERE StoreCountry IS NOT NULL
       AND Category IN (SELECT Category FROM {{p}}topcats12 WHERE Rank <= 10)) c) g
LEFT JOIN (SELECT StoreCountry, Category, sum(SalesNetAmountEuro) AS rev FROM {{p}}master GROUP BY StoreCountry, Category) r
  ON g.StoreCountry = r.StoreCountry AND g.Category = r.Category""")
key("store_metrics", f"""SELECT StoreID, {r6('sum(SalesNetAmountEuro)', 'revenue')}, count(*) AS transactions,
  {r6('CAST(sum(SalesNetAmountEuro) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 'avg_transaction')}
FROM {{p}}master WHERE StoreID IS NOT NULL GROUP BY StoreID""")
key("overstock", """SELECT o.StoreCountry, o.Rank, o.ProductID, p.FamilyLevel2 AS Product, p.Category, p.FamilyLevel1 AS SportFamily,
  o.Quantity FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.StoreCountry ORDER BY s.Quantity DESC, s.ProductID) AS Rank
  FROM stocks s JOIN {p}stockmed m ON s.StoreCountry = m.StoreCountry WHERE s.Quantity > m.med) o
LEFT JOIN products_raw p ON o.ProductID = p.ProductID WHERE o.Rank <= 15""")
key("stock_health", f"""SELECT StoreCountry, count(DISTINCT ProductID) AS products, CAST(sum(Quantity) AS BIGINT) AS total_units,
  count_if(Quantity = 0) AS zero_stock,
  {r6('ROUND(count_if(Quantity = 0) / CAST(count(DISTINCT ProductID) AS DOUBLE) * 100, 1)', 'zero_pct')}
FROM stocks GROUP BY StoreCountry""")
key("country_trending", f"""SELECT t.StoreCountry, 'Country' AS Source, t.Rank, t.ProductID, p.FamilyLevel2 AS Product, p.Category,
  p.FamilyLevel1 AS SportFamily, p.Universe AS Gender, {r6('t.FinalScore', 'FinalScore')},
  {r6('t.recent_score', 'recent_score')}, {r6('t.seasonal_score', 'seasonal_score')} FROM (
  SELECT *, row_number() OVER (PARTITION BY StoreCountry ORDER BY ROUND(FinalScore, 6) DESC, ProductID) AS Rank FROM (
    SELECT StoreCountry, ProductID, sum(FinalScore) AS FinalScore, sum(recent_score) AS recent_score,
           sum(seasonal_score) AS seasonal_score FROM {{p}}trend WHERE StoreCountry IS NOT NULL
    GROUP BY StoreCountry, ProductID)) t
LEFT JOIN products_raw p ON t.ProductID = p.ProductID WHERE t.Rank <= 15""")
key("client_360", f"""SELECT c.ClientID, c.Persona, c.ClientCountry,
  COALESCE(s.Strategy, 'Welcome offer on trending products') AS Strategy, COALESCE(s.Channel, 'Email + Social Media') AS Channel,
  {r6('c.TotalSpent', 'TotalSpent')}, c.TransactionCount, {r6('c.AvgOrderValue', 'AvgOrderValue')}, c.Recency, c.RFM_Score,
  c.FavoriteCategory,
  CASE WHEN c.Persona = 'No Transactions' THEN CASE c.ClientGender WHEN 'M' THEN 'Men' WHEN 'F' THEN 'Women' ELSE 'All' END END AS GenderLabel,
  CASE WHEN c.Persona = 'No Transactions' THEN c.ClientSegment END AS Segment
FROM {{p}}cfeat c LEFT JOIN strategies s ON c.Persona = s.Persona""")
key("dimension_values", """SELECT DISTINCT 'ClientCountry' AS Dimension, ClientCountry AS Value, CAST(NULL AS VARCHAR) AS Parent
  FROM {p}master WHERE ClientCountry IS NOT NULL
UNION SELECT DISTINCT 'StoreCountry', StoreCountry, CAST(NULL AS VARCHAR) FROM {p}master WHERE StoreCountry IS NOT NULL
UNION SELECT DISTINCT 'StoreID', m.StoreID, s.StoreCountry FROM {p}master m LEFT JOIN stores s ON m.StoreID = s.StoreID
  WHERE m.StoreID IS NOT NULL""")


key("parse_dates", f"""SELECT {RK}, strftime(p, {TS}) AS SaleTransactionDate, CAST(p IS NULL AS INTEGER) AS IsQuarantined FROM (
  SELECT *, TRY_CAST(CASE WHEN LineNo % 7 = 0 THEN 'not a date'
                          ELSE strftime(SaleTransactionDate, {TS}) || CASE WHEN LineNo % 3 = 0 THEN '+00:00'
                                 WHEN LineNo % 3 = 1 THEN '+02:00' ELSE '' END END AS TIMESTAMP) AS p FROM tx)""")
base("raw_sales", """SELECT BasketID, LineNo, ClientID, ProductID, StoreID, d AS DateText, a AS SalesNetAmountEuro, q AS Quantity,
       CASE WHEN d IS NOT NULL AND TRY_CAST(d AS TIMESTAMP) IS NULL THEN 'unparseable date' WHEN d IS NULL THEN 'missing date' WHEN a IS NULL THEN 'missing amount'
            WHEN a < 0 THEN 'negative amount' WHEN q IS NULL THEN 'missing quantity' WHEN q <= 0 THEN 'quantity not positive' END AS Reason FROM (
  SELECT *, CASE WHEN CAST(BasketID AS BIGINT) % 23 = 5 THEN NULL WHEN LineNo = 7 THEN '31/31/2024' ELSE strftime(SaleTransactionDate, '%Y-%m-%d %H:%M:%S') END AS d,
         CASE CAST(BasketID AS BIGINT) % 23 WHEN 6 THEN -SalesNetAmountEuro WHEN 7 THEN NULL ELSE SalesNetAmountEuro END AS a,
         CASE CAST(BasketID AS BIGINT) % 23 WHEN 8 THEN 0 WHEN 9 THEN NULL ELSE Quantity END AS q FROM tx)""")
key("quarantine_counts", """SELECT r.Reason, count(s.BasketID) AS Counted, count(s.BasketID) AS Stored FROM (
  SELECT unnest(['accepted', 'unparseable date', 'missing date', 'missing amount', 'negative amount', 'missing quantity', 'quantity not positive']) AS Reason) r
LEFT JOIN raw_sales s ON r.Reason = COALESCE(s.Reason, 'accepted') GROUP BY r.Reason""")
key("quarantine_rows", f"SELECT {RK}, DateText, Reason FROM raw_sales WHERE Reason IS NOT NULL")
key("csv_transactions", f"""SELECT ClientID, ProductID, StoreID, {ts('SaleTransactionDate', 'SaleTransactionDate')},
  ROUND(CAST(SalesNetAmountEuro AS DOUBLE), 6) AS SalesNetAmountEuro, Quantity, BasketID FROM tx""")
key("csv_broken_lines", """SELECT 'transactions' AS "table", unnest([StoreID || ',too few', '1,2,3,4,5,6,7,8,' || StoreID]) AS line, CAST(unnest([2, 7]) AS INTEGER) AS read FROM stores""")
key("csv_clients", "SELECT * FROM clients_raw")
key("csv_precomputed", f"""SELECT ClientID, Persona, ClientCountry, TransactionCount, {r6('TotalSpent', 'TotalSpent')}, Recency, RFM_Score, FavoriteCategory,
  CAST(0 AS BIGINT) AS Trending FROM {{p}}cfeat""")
key("country_playbook_app", """SELECT Country, ActionNo, Action, Count, Detail FROM (
  SELECT Country, 1 AS ActionNo, 'win_back' AS Action, CAST(inactive_count AS BIGINT) AS Count, 'SMS Re-engagement' AS Detail
  FROM {p}insights WHERE inactive_count > 50
  UNION ALL SELECT Country, 2, 'stock_alert', zero_stock, 'popular items out of stock' FROM {p}insights WHERE zero_stock > 5
  UNION ALL SELECT i.Country, 3, 'dominant_persona', CAST(NULL AS BIGINT), COALESCE(s.Strategy, 'Standard')
  FROM {p}insights i LEFT JOIN strategies s ON i.dominant_persona = s.Persona WHERE i.dominant_persona IS NOT NULL)""")




key("country_kpi_summary", f"""SELECT StoreCountry AS Country, {_money('rev')} AS Revenue, Transactions, Clients, UnitsSold,
  {_money('rev / CAST(Transactions AS DOUBLE)')} AS AvgBasket FROM (
  SELECT StoreCountry, CAST(sum(SalesNetAmountEuro) AS DOUBLE) AS rev, count(*) AS Transactions,
         count(DISTINCT ClientID) AS Clients, CAST(sum(Quantity) AS BIGINT) AS UnitsSold
  FROM {{p}}master WHERE StoreCountry IS NOT NULL GROUP BY StoreCountry)""")
key("search_targets_country", f"""SELECT ClientID, Persona, ClientCountry, {r6('TargetScore', 'TargetScore')}, Rank FROM (
  SELECT *, row_number() OVER (ORDER BY ROUND(TargetScore, 6) DESC, ClientID) AS Rank FROM (
    SELECT *, COALESCE(RFM_Score, 0) * 2 + COALESCE(TransactionCount, 0) - COALESCE(Recency, 999) / 100.0::DOUBLE AS TargetScore
    FROM {{p}}cfeat WHERE ClientID IN (SELECT ClientID FROM {{p}}search_ids)
      AND ClientCountry = (SELECT min(StoreCountry) FROM stores))) WHERE Rank <= 50""")


key("country_refresh", f"""SELECT StoreCountry, {r6('sum(SalesNetAmountEuro) * CASE WHEN StoreCountry = (SELECT min(StoreCountry) FROM stores) THEN 2 ELSE 1 END', 'Revenue')},
  CAST(sum(Quantity) AS BIGINT) AS Units, count(*) AS Rows, count(DISTINCT (BasketID, LineNo)) AS Lines,
  CAST(StoreCountry = (SELECT min(StoreCountry) FROM stores) AS INTEGER) AS Rewritten
FROM {{p}}master WHERE StoreCountry IS NOT NULL GROUP BY StoreCountry""")
key("client_pages", f"""SELECT c.ClientID, c.Persona, c.ClientCountry, c.RFM_Score, {r6('c.TotalSpent', 'TotalSpent')}, r.Rank, r.ProductID, i.FamilyLevel2 AS ProductFamily,
  {_money('i.PricePerUnit')} AS Price FROM {{p}}cfeat c LEFT JOIN ({{p}}recs r JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY SaleTransactionDate, BasketID, LineNo, StoreID,
         SalesNetAmountEuro, Quantity, ClientID) AS rn FROM {{p}}priced WHERE ProductID IS NOT NULL) WHERE rn = 1) i ON r.ProductID = i.ProductID)
  ON c.ClientID = r.ClientID""")


key("approx_quantiles", """SELECT c AS "Column", p AS P, (SELECT count(*) FROM {p}master) AS Rows, true AS WithinBound FROM
  (SELECT unnest(['Amount', 'Quantity']) AS c), (SELECT unnest([0.1, 0.2, 0.4, 0.5, 0.6, 0.8, 0.99])::DOUBLE AS p)""")


# one column per nation of the fixture
_STOCK_COLS = ",\n  ".join(f"CAST(COALESCE(sum(Quantity) FILTER (WHERE StoreCountry = 'NATION_{i}'), 0) AS BIGINT) AS NATION_{i}" for i in range(25))
key("stock_pivot_wide", f"""SELECT s.ProductID, p.FamilyLevel2 AS Product, {_STOCK_COLS}
FROM stocks s JOIN {{p}}matches m ON s.ProductID = m.ProductID LEFT JOIN products_raw p ON s.ProductID = p.ProductID
GROUP BY s.ProductID, p.FamilyLevel2""")
_REV_COLS = ",\n  ".join(r6(f"COALESCE(sum(SalesNetAmountEuro) FILTER (WHERE StoreCountry = 'NATION_{i}'), 0)", f"NATION_{i}") for i in range(25))
key("category_country_wide", f"""SELECT Category, {_REV_COLS} FROM {{p}}master
WHERE StoreCountry IS NOT NULL AND Category IN (SELECT Category FROM {{p}}topcats12 WHERE Rank <= 10) GROUP BY Category""")
_TABLES = {
    "final_data": "SELECT count(*) AS n FROM {p}master", "persona": "SELECT count(*) AS n FROM {p}penr",
    "client_features": "SELECT count(*) AS n FROM {p}cfeat", "associations": "SELECT count(DISTINCT antecedent) AS n FROM {p}rules_family",
    "associations_long": "SELECT count(*) AS n FROM {p}rules_family", "popular": "SELECT count(*) AS n FROM {p}popular",
    "trending": "SELECT count(*) AS n FROM {p}trending", "affinity": "SELECT count(*) AS n FROM {p}affinity",
    "country_kpis": "SELECT count(DISTINCT StoreCountry) AS n FROM {p}master",
    "country_trending": "SELECT sum(least(n, 15)) AS n FROM (SELECT count(DISTINCT ProductID) AS n FROM {p}trend WHERE StoreCountry IS NOT NULL GROUP BY StoreCountry)",
    "markov": "SELECT count(*) AS n FROM {p}markov", "markov_global": "SELECT count(*) AS n FROM {p}markov_global",
    "embeddings": "SELECT count(*) AS n FROM (SELECT ProductID FROM {p}master WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ProductID HAVING count(*) >= 2)",
    "metadata": "SELECT 1 AS n"}
key("materialize", "\nUNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST(n AS BIGINT) AS rows FROM ({q})" for t, q in _TABLES.items()))


# ------------------------------------------------------------------ assembly
_REF = re.compile(r"\{p\}(\w+)")


def _deps(sql: str, p: str) -> list[tuple[str, str]]:
    out = []
    for name in _REF.findall(sql):
        if name == "tx" and p == "":
            out.append(("base", "tx"))
        else:
            out.append(("derived", name))
    for name in BASE:
        if re.search(rf"(?<![\w.]){name}(?!\w)", sql.replace("{p}", "\u0001")):
            out.append(("base", name))
    return out


def build_sql(name: str) -> str:
    p, final = KEYS[name]
    order: list[tuple[str, str]] = []
    seen: set = set()

    def visit(kind: str, n: str):
        if (kind, n) in seen:
            return
        seen.add((kind, n))
        body = BASE[n] if kind == "base" else DERIVED[n]
        for k2, n2 in _deps(body, p if kind == "derived" else ""):
            visit(k2, n2)
        order.append((kind, n))

    for k2, n2 in _deps(final, p):
        visit(k2, n2)
    ctes = []
    for kind, n in order:
        body = BASE[n] if kind == "base" else DERIVED[n]
        cname = n if kind == "base" else f"{p}{n}"
        ctes.append(f"{cname} AS (\n{body.replace('{p}', p)}\n)")
    head = ("WITH " + ",\n".join(ctes) + "\n") if ctes else ""
    return head + final.replace("{p}", p)


ORACLE_SQL: dict[str, str] = {k: build_sql(k) for k in KEYS}
