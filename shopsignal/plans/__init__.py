from shopsignal.plans.catalog import QUERIES, build_query  # noqa: F401
from shopsignal.plans.oracle import ORACLE_SQL  # noqa: F401
