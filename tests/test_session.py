"""The application's shared folder: one for all intermediate data, and gone when asked."""
import os

from shopsignal.operators.numeric import shared_folder
from shopsignal.plans.catalog import build_query
from shopsignal.session import ensure_checkpoint_dir, remove_shared

SF = "/root/testdata/sf0.001"


def test_everything_lies_in_one_folder_that_can_be_removed(spark):
    before = ensure_checkpoint_dir(spark)
    local = before.removeprefix("file:")
    want = build_query("country_kpis", spark, SF).collect()
    assert os.listdir(local) and shared_folder(spark, "x").startswith(before.rstrip("/"))
    remove_shared(spark)
    assert not os.path.exists(local)
    after = ensure_checkpoint_dir(spark)
    assert after != before and os.path.dirname(after.rstrip("/")) == os.path.dirname(before.rstrip("/"))
    assert build_query("country_kpis", spark, SF).collect() == want          # and queries start anew
