"""Fixed business values that must equal the original application's, stated as data."""
from __future__ import annotations

# ---- fixed values: persona names (classification output) ---------------------------------
NO_TRANSACTIONS = "No Transactions"
VERY_FREQUENT = "Very Frequent (>15)"
INACTIVE_MID = "Inactive (Mid Freq)"
INACTIVE_LOW = "Inactive (Low Freq)"
LOYAL_MID = "Loyal/Top (Mid Freq)"
LOYAL_LOW = "Loyal/Top (Low Freq)"
OTHER_ACTIVE = "Other (Active)"

# ---- fixed values: persona -> (strategy, channel, urgency), in the original order ---------
PERSONA_STRATEGIES = [
    ("No Transactions", "Welcome offer on trending products", "Email + Social Media", "Medium"),
    ("Inactive (Low Freq)", "Win-back with discount on last-purchased category", "Email + SMS + Retargeting", "High"),
    ("Inactive (Mid Freq)", "Re-engage with personalised product bundles", "Email + Push", "High"),
    ("Loyal/Top (Low Freq)", "Cross-sell via association rules to build basket", "Email + In-App", "Moderate"),
    ("Loyal/Top (Mid Freq)", "AI-powered next-product predictions + loyalty rewards", "Personalised Email + In-App + SMS", "Nurture"),
    ("Very Frequent (>15)", "VIP treatment, ambassador program, exclusive early access", "All Channels + Personal Manager", "VIP"),
]

# ---- fixed values: major sporting events (start, end inclusive, countries or All) ---------
SPORTING_EVENTS = [
    ("2022-11-20", "2022-12-18", ["All"]),
    ("2024-06-14", "2024-07-14", ["FR", "ES", "IT", "DE", "GB", "UK"]),
    ("2024-07-26", "2024-08-11", ["All"]),
    ("2023-06-10", "2023-06-10", ["FR", "ES", "IT", "DE", "GB", "UK"]),
    ("2024-06-01", "2024-06-01", ["FR", "ES", "IT", "DE", "GB", "UK"]),
    ("2023-02-12", "2023-02-12", ["US"]),
    ("2024-02-11", "2024-02-11", ["US"]),
]

# ---- fixed values: country code -> display name -------------------------------------------
COUNTRY_NAMES = [
    ("FRA", "France"), ("GBR", "United Kingdom"), ("DEU", "Germany"), ("USA", "United States"),
    ("BRA", "Brazil"), ("AUS", "Australia"), ("ARE", "UAE"),
]

# ---- fixed values: null fills and thresholds ----------------------------------------------
UNKNOWN = "Unknown"
UNISEX = "Unisex"
REGULAR = "Regular"
PARETO_SHARE = "0.8"              # cumulative revenue share flagged as top
RULE_MIN_SUPPORT = 0.0005         # pair support threshold, share of multi-item baskets
TREND_WINDOW_DAYS = 60
TREND_RECENT_WEIGHT = 0.7
TREND_SEASONAL_WEIGHT = 0.3
TREND_DECAY = 0.1
NOISE_PRICE_Q = 0.10
NOISE_QTY_Q = 0.99
WATERFALL_MIN_SCORE = 10
AFFINITY_SPEND_W = 0.7
AFFINITY_COUNT_W = 0.3
PROPENSITY_RECENCY_W = 0.5
NEW_CLIENT_RECENCY = 999
FIRST_PURCHASE_GAP = 9999

# ---- fixed values: persona-advice texts (strategy by persona name, channel by reach) -------
ADVICE_VIP = "VIP Treatment: Offer exclusive early access to new collections. Focus on retention."
ADVICE_WINBACK = "Win-Back: Aggressive limited-time discounts for churn prevention."
ADVICE_ACTIVATION = "Activation: Welcome series with first-purchase incentive."
ADVICE_NURTURE = "Nurture: Cross-sell complementary categories to increase basket equity."
CHANNEL_LOW = "Low Reach: Rely on On-Site Personalization / Retargeting Ads."
