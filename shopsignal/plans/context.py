"""Per-(session, data folder) context: the retail tables and the shared intermediate
DataFrames every query reuses (built lazily, once)."""
from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignal.functions.scalar import ts_lit
from shopsignal.operators import baskets, cleaning, customers, features, products, sequences
from shopsignal.operators.numeric import materialize, sized
from shopsignal.sources.retail import RetailTables, load_retail

_CACHE: dict = {}
_SOURCES: dict = {}   # (session, folder) -> RetailTables (metadata only: reused across contexts)


def clear() -> None:
    """Forget the contexts: the next query writes its shared tables anew."""
    _CACHE.clear()


def context(spark: SparkSession, sf_dir: str) -> "Ctx":
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Ctx(spark, sf_dir)
    return _CACHE[key]


class Ctx:
    """The tables of a folder as they were when the first query used them: clean sales are written once per context, so
    files that arrive later are seen after ``clear()``.

    ``since`` (a datetime) restricts all sales to a window; by default the whole history counts."""

    def __init__(self, spark: SparkSession, sf_dir: str, since: dt.datetime | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.since = since

    @cached_property
    def t(self) -> RetailTables:
        key = (self.spark.sparkContext.applicationId, self.sf_dir.rstrip("/"), self.since)
        if key not in _SOURCES:
            _SOURCES[key] = load_retail(self.spark, self.sf_dir, since=self.since)
        src = _SOURCES[key]
        t = RetailTables(src.transactions, src.clients, src.products, src.stores, src.stocks)
        if self.since is not None:
            t.transactions = t.transactions.filter(F.col(cleaning.DATE) >= ts_lit(self.since))
        return t

    @cached_property
    def products(self) -> DataFrame:
        return sized(cleaning.clean_products(self.t.products))

    @cached_property
    def clients(self) -> DataFrame:
        return cleaning.clean_clients(self.t.clients)

    @cached_property
    def clean(self) -> DataFrame:
        """Valid, deduplicated sales: written once to the shared folder as parquet, so every query
        pays one shuffle for the dedupe at most and scans only the columns it uses."""
        return materialize(cleaning.clean_transactions(self.t.transactions), "clean-sales")

    @cached_property
    def master(self) -> DataFrame:
        """Clean sales ⟕ dims + calendar + events, as a lazy view: Catalyst drops the joins and
        columns that a query does not use."""
        return self.view(self.clean)

    def view(self, sales: DataFrame) -> DataFrame:
        """What ``master`` is to clean sales, for some of them."""
        m = features.master_join(sales, self.products, self.clients, self.t.stores)
        return features.add_sporting_events(features.add_retail_events(features.add_calendar(m)))

    @cached_property
    def rfm(self) -> DataFrame:
        return customers.customer_rfm(self.master)

    @cached_property
    def personas(self) -> DataFrame:
        return customers.personas(self.clients, self.t.transactions)

    @cached_property
    def persona_enriched(self) -> DataFrame:
        return customers.persona_enriched(self.personas, self.master)

    @cached_property
    def last(self) -> DataFrame:
        return customers.last_purchase(self.master)

    @cached_property
    def latest_day(self) -> dt.datetime | None:
        """The day of the last sale; None without sales."""
        d = self.max_date
        return None if d is None else dt.datetime(d.year, d.month, d.day)

    @cached_property
    def denoised(self) -> DataFrame:
        """Sales inside the global unit-price p10 / quantity p99 bounds (computed once)."""
        return products.noise_filter(self.master)

    @cached_property
    def max_date(self):
        return self.master.select(F.max(cleaning.DATE)).first()[0]

    @cached_property
    def trend_scores(self) -> DataFrame:
        return materialize(products.trending_scores(self.master, self.max_date, filtered=self.denoised), "trend-scores")

    @cached_property
    def popular(self) -> DataFrame:
        return materialize(products.global_trends(self.master, self.products, self.max_date, filtered=self.denoised,
                                                  scores=self.trend_scores), "popular")

    @cached_property
    def trending(self) -> DataFrame:
        # scores at the last sale's moment are those of its day where that is midnight
        same = self.max_date == self.latest_day
        return products.global_trends(self.master, self.products, target_date=self.latest_day,
                                      filtered=self.denoised, scores=self.trend_scores if same else None)

    @cached_property
    def rules_product(self) -> DataFrame:
        return baskets.association_rules(self.master, "ProductID")

    @cached_property
    def rules_family(self) -> DataFrame:
        return baskets.association_rules(self.master, "FamilyLevel2")

    @cached_property
    def markov(self) -> DataFrame:
        return sequences.markov_transitions(self.master, "FamilyLevel2")

    @cached_property
    def markov_global(self) -> DataFrame:
        return sequences.markov_transitions(self.master, "FamilyLevel2", by=None)

    @cached_property
    def sequences(self) -> DataFrame:
        return sequences.client_sequences(self.master)

    @cached_property
    def embeddings(self) -> DataFrame:
        if not sequences.vocabulary(self.sequences).limit(1).count():       # nothing to train
            return self.spark.createDataFrame([], "ProductID string, embedding array<double>")
        return sequences.train_prod2vec(self.sequences)
