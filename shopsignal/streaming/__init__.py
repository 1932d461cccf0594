from shopsignal.streaming.incremental import country_revenue_stream  # noqa: F401
