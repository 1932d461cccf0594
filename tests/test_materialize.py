"""Materialised artefacts round-trip; a missing optional artefact reads back empty."""
from shopsignal.plans.context import context
from shopsignal.plans.materialize import materialize, read_artefacts

SF = "/root/testdata/sf0.001"


def test_materialize_and_read_back(spark, tmp_path):
    x = context(spark, SF)
    root = str(tmp_path / "art")
    summary = {r.table: r.rows for r in materialize(x, root, tables=["country_kpis", "popular"]).collect()}
    assert summary["country_kpis"] > 0 and 0 < summary["popular"] <= 100
    arts = read_artefacts(spark, root, {"country_kpis": None, "popular": None,
                                        "country_trending": "StoreCountry string, ProductID string, FinalScore double"})
    assert arts["country_kpis"].count() == summary["country_kpis"]
    assert arts["country_trending"].count() == 0 and "FinalScore" in arts["country_trending"].columns
