"""The streaming roll-up equals the batch roll-up on the same files."""
from shopsignal.plans.context import context
from shopsignal.streaming.incremental import country_revenue, country_revenue_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    x = context(spark, SF)
    src = str(tmp_path / "sales")
    x.t.transactions.repartition(4).write.parquet(src)
    out = str(tmp_path / "out")
    q = country_revenue_stream(spark, src, x.t.stores, str(tmp_path / "ckpt"), lambda df, i: df.write.mode("overwrite").parquet(out))
    q.awaitTermination(120)
    got = {r.StoreCountry: (round(r.total_revenue, 2), r.n_transactions) for r in spark.read.parquet(out).collect()}
    exp = {r.StoreCountry: (round(r.total_revenue, 2), r.n_transactions)
           for r in country_revenue(spark.read.parquet(src), x.t.stores).collect()}
    assert got == exp and len(got) > 0
