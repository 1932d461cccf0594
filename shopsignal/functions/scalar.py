"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _second_of_day(x: Column) -> Column:
    return F.hour(x) * 3600 + F.minute(x) * 60 + F.date_part(F.lit("SECOND"), x)


def day_delta(start, end) -> Column:
    """Whole elapsed 24h units from ``start`` to ``end``, floored (timedelta.days semantics).

    Differs from ``datediff`` (calendar days): 23:00 → 01:00 next day gives 0. Built from
    wall-clock fields of TIMESTAMP_NTZ values only, so no session time zone (or DST change)
    enters the arithmetic.
    """
    a, b = c(start), c(end)
    secs = F.datediff(F.to_date(b), F.to_date(a)).cast("decimal(20,6)") * 86400 \
        + (_second_of_day(b) - _second_of_day(a))
    return F.floor(secs / F.lit(86400)).cast("bigint")


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime, via text (no time-zone conversion)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def flag(cond: Column) -> Column:
    """Boolean → 0/1 INT with NULL counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI mode raises otherwise)."""
    return F.try_divide(c(num), c(den))


def season(month) -> Column:
    m = c(month)
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
             .when(m.isin(6, 7, 8), "Summer").otherwise("Fall"))


def black_friday(year, us_thanksgiving: bool = False) -> Column:
    """Fourth Friday of November: first Friday on/after Nov 1, plus three weeks (a DATE); or the day after the fourth Thursday."""
    if us_thanksgiving:
        return F.date_add(F.next_day(F.make_date(c(year), F.lit(10), F.lit(31)), "THU"), 22)
    first_fri = F.next_day(F.make_date(c(year), F.lit(10), F.lit(31)), "FRI")
    return F.date_add(first_fri, 21)


def as_ts(d: Column) -> Column:
    return d.cast("timestamp_ntz")


def money(x) -> Column:
    """'€1,234' when |x| >= 1000, else '€12.34' (format_number rounds half-even)."""
    v = c(x).cast("double")
    return F.when(F.abs(v) >= 1000, F.concat(F.lit("€"), F.format_number(v, 0))) \
            .otherwise(F.concat(F.lit("€"), F.format_number(v, 2)))


def gender_label(g) -> Column:
    return F.when(c(g) == "M", "Men").when(c(g) == "F", "Women").otherwise("All")


def round6(x) -> Column:
    """Round to 6 places as round(x·1e6)/1e6: the scaling is exact IEEE arithmetic, so every
    engine rounds the same scaled value (direct decimal rounding differs on .5e-6 ties)."""
    return F.round(c(x).cast("double") * F.lit(1e6)) / F.lit(1e6)


def ts_text(x) -> Column:
    return F.date_format(c(x), "yyyy-MM-dd HH:mm:ss")


def exact_mean(x) -> Column:
    """Mean of a double column that does not depend on summation order: each value is rounded
    to 9 places (scaled rounding, identical in every engine), summed as DECIMAL(38,9)
    (exact), then divided once. Differs from a float mean by at most 5e-10."""
    v = F.round(c(x) * F.lit(1e9)) / F.lit(1e9)
    return F.sum(v.cast("decimal(38,9)")).cast("double") / F.count(c(x)).cast("double")
