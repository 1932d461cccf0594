from shopsignal.sources.retail import RetailTables, load_retail  # noqa: F401
