"""Column helpers: month arithmetic, clipping, missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(date) -> Column:
    """Months as consecutive integers: year * 12 + month."""
    return F.year(col(date)) * 12 + F.month(col(date))


def month_label(index) -> Column:
    """yyyy-MM label of a month index."""
    i = col(index) - 1
    # format_string would build a formatter for every row
    return F.concat(F.lpad(F.floor(i / 12).cast("int").cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("int").cast("string"), 2, "0"))


def month_index_of(label) -> Column:
    """Month index of a yyyy-MM label."""
    c = col(label)
    return F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")


def month_end(index) -> Column:
    i = col(index) - 1
    return F.last_day(F.make_date(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1)))


def clip(c, low: float | None, high: float | None) -> Column:
    """Clip that keeps NULL (least/greatest alone would drop it)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def finite_or_null(c) -> Column:
    """NaN and +-Inf become NULL."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def is_finite(c) -> Column:
    return F.coalesce(finite_or_null(c).isNotNull(), F.lit(False))


def safe_div(a, b) -> Column:
    """a / b, NULL where b is zero or missing."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / b)


def hit_share(condition: Column) -> Column:
    """Share of rows where condition holds; rows where it is NULL count as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def months_t_stat(c) -> Column:
    """mean / (sample sd / sqrt(T)) over the rows of a group."""
    c = col(c)
    return safe_div(F.avg(c), F.stddev_samp(c)) * F.sqrt(F.count(c))


def safe_corr(a, b) -> Column:
    """Pearson correlation over rows where both are known; NULL if either is constant."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
