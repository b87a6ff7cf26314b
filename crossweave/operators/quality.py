"""Data-quality rules for a panel and an event table, and planted errors to test them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.operators import crosssection as X
from crossweave.operators.ranks import group_quantiles
from crossweave.session import stage

MATCH = 1e-4
# Parts of column names that tell of vintages.
VINTAGE_WORDS = ("vintage", "asof", "as_of", "revis", "restat")


def _share(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def year_of(mi: str = "mi") -> Column:
    return F.floor((F.col(mi) - 1) / 12).cast("int")


def timing_consistency(panel: DataFrame, month: str = "mi", drop: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Share of rows per month whose paired columns agree; flags months far below the median month."""
    ret_ok = F.abs(F.col("ret_1_0") - F.col("ret")) < MATCH
    me_ok = F.abs(F.col("market_equity") - F.col("me")) / F.abs("me") < MATCH
    by = list(by or [])
    # One row per calendar month from here on.
    m = panel.groupBy(*by, month).agg(_share(ret_ok).alias("ret_ok"), _share(me_ok).alias("me_ok"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    low = (F.col("ret_ok") < F.median("ret_ok").over(whole) - drop) | (F.col("me_ok") < F.median("me_ok").over(whole) - drop)
    return m.withColumn("flagged", low)


def duplicate_keys(df: DataFrame, key_sets: list[list[str]]) -> DataFrame:
    """Rows beyond the first per key, for several keys: (key, duplicates)."""
    parts = [df.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
             .select(F.lit("+".join(k)).alias("key"), "duplicates") for k in key_sets]
    return reduce(lambda a, b: a.unionByName(b), parts)


def vintage_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(word in c.lower() for word in VINTAGE_WORDS)]


def ticker_owners(panel: DataFrame, month: str = "mi", by: list[str] | None = None) -> DataFrame:
    """(ticker, month) pairs owned by more than one entity."""
    by = list(by or [])
    pairs = panel.filter("ticker IS NOT NULL").select(*by, "ticker", month, "permno").distinct()
    return pairs.groupBy(*by, "ticker", month).agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")


def ticker_map_check(panel: DataFrame, month: str = "mi") -> DataFrame:
    """One row: shared ticker-months, and tickers used by several entities over time."""
    reused = (panel.filter("ticker IS NOT NULL").select("ticker", "permno").distinct().groupBy("ticker")
              .agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("x")))
    return ticker_owners(panel, month).agg(F.count(F.lit(1)).alias("shared_ticker_months")).withColumn("reused_tickers", reused.scalar())


def key_changes(panel: DataFrame, order: str = "mi", by: list[str] | None = None) -> DataFrame:
    """One row (per `by`): entities whose secondary key changes, and entities that return to an earlier key."""
    key = F.concat_ws("-", "gvkey", "iid")
    entity = [*(by or []), "permno"]
    w = W.partitionBy(*entity).orderBy(order, "k")
    rows = panel.select(*entity, order, key.alias("k")).withColumn("prev", F.lag("k").over(w)).withColumn("n", F.row_number().over(w))
    runs = rows.filter((F.col("n") == 1) | (F.col("k") != F.col("prev")))
    per = runs.groupBy(*entity, "k").agg(F.count(F.lit(1)).alias("times")).groupBy(*entity).agg(
        F.sum("times").alias("runs"), F.max("times").alias("most"))
    return per.groupBy(*(by or [])).agg(F.coalesce(F.sum((F.col("runs") > 1).cast("long")), F.lit(0)).alias("changed"),
                                        F.coalesce(F.sum((F.col("most") > 1).cast("long")), F.lit(0)).alias("switched_back"))


def with_miss_share(panel: DataFrame, columns: list[str]) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return panel.withColumn("miss_share", missing / F.lit(len(columns)))


def _band() -> Column:
    m = F.col("miss_share")
    return F.when(m <= 0.1, "<=10%").when(m <= 0.25, "10-25%").when(m <= 0.5, "25-50%").otherwise(">50%")


def missingness_bands(panel: DataFrame) -> DataFrame:
    """Rows, exact median size and micro/nano share per band of row missingness."""
    banded = panel.withColumn("band", _band())
    medians = group_quantiles(banded, ["band"], "me", {"median_me": 0.5})
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), _share(F.col("size_grp").isin("micro", "nano")).alias("micro_nano_share"))
    return counts.join(medians, "band", "left")


def missingness_ratio(panel: DataFrame, month: str = "mi", high: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """One row (per `by`): median over months of (median size of high-missing rows / of the others)."""
    split = panel.withColumn("high", F.col("miss_share") > high)
    by = list(by or [])
    med = group_quantiles(split, [*by, month, "high"], "me", {"m": 0.5})
    ratio = med.groupBy(*by, month).agg((F.max(F.when(F.col("high"), F.col("m"))) / F.max(F.when(~F.col("high"), F.col("m")))).alias("ratio"))
    return ratio.groupBy(*by).agg(F.median("ratio").alias("ratio"), F.count("ratio").alias("months"))


def lifetimes(panel: DataFrame, end, early: int, month: str = "mi", by: list[str] | None = None) -> DataFrame:
    """First and last month per entity and its group: listed, left early or left late."""
    life = panel.groupBy(*(by or []), "permno").agg(F.min(month).alias("first"), F.max(month).alias("last"))
    return life.withColumn("group", F.when(F.col("last") == end, "listed").when(F.col("last") < early, "left early").otherwise("left late"))


def coverage_by_year(panel: DataFrame, life: DataFrame, base_year: int, month: str = "mi",
                     groups=("left early", "left late", "listed")) -> DataFrame:
    """Entities per year by group and in all, and the total relative to a base year."""
    seen = panel.select("permno", year_of(month).alias("year")).distinct().join(life.select("permno", "group"), "permno")
    wide = seen.groupBy("year").pivot("group", list(groups)).agg(F.count(F.lit(1)))
    total = seen.groupBy("year").agg(F.count(F.lit(1)).alias("all"))
    base = total.filter(F.col("year") == base_year).select("all").scalar()
    out = wide.na.fill(0, list(groups)).join(total, "year")
    return out.withColumn("vs_base", F.col("all") / base)


def survivorship_flag(life: DataFrame, end, limit: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """One row (per `by`): share of entities gone before the end; too few exits is the flag."""
    share = _share(F.col("last") < end)
    return life.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("entities"), share.alias("exit_share"), (share < limit).alias("flagged"))


def real_start(panel: DataFrame, base_year: int, month: str = "mi", share: float = 0.5) -> DataFrame:
    """One row: first month with at least `share` of the base year's mean row count."""
    counts = panel.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    level = counts.filter(year_of(month) == base_year).agg(F.avg("n")).scalar()
    return counts.filter(F.col("n") >= F.lit(share) * level).agg(F.min(month).alias("start"), level.alias("level"))


def event_lag_buckets(events: DataFrame) -> DataFrame:
    """One row: filing date less event date, in days: counts per bucket and the exact median."""
    lag = F.datediff("filing_date", "content_report_date")

    # Days are few distinct values, so the median comes from their counts.
    counts = events.select(lag.alias("lag")).groupBy("lag").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("lag")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return counts.agg(total(c.isNull()).alias("missing"), total(c < 0).alias("negative"), total(c == 0).alias("same_day"),
                      total(c.between(1, 4)).alias("days_1_4"), total(c > 4).alias("later"),
                      F.expr("percentile(lag, 0.5, CASE WHEN lag IS NULL THEN 0 ELSE n END)").alias("median_days"))


def event_ticker_conflicts(events: DataFrame, panel: DataFrame, month: str = "mi") -> DataFrame:
    """One row: events whose ticker differs from the panel's that month, or belongs to another entity."""
    own = panel.select("permno", month, F.col("ticker").alias("panel_ticker"))
    owner = panel.filter("ticker IS NOT NULL").groupBy("ticker", month).agg(F.min("permno").alias("owner"))
    m = events.join(own, ["permno", month], "left").join(owner, ["ticker", month], "left")
    both = F.col("ticker").isNotNull() & F.col("panel_ticker").isNotNull()
    differs = both & (F.col("ticker") != F.col("panel_ticker"))

    def n(cond):
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    return m.agg(n(both).alias("both_present"), n(differs).alias("differs"), (n(differs) / n(both)).alias("share_differs"),
                 n(F.col("owner").isNotNull() & (F.col("owner") != F.col("permno"))).alias("owned_by_other"), n(F.col("cik").isNull()).alias("cik_missing"))


def event_flags(events: DataFrame, panel: DataFrame, life: DataFrame, months: int = 12, month: str = "mi") -> DataFrame:
    """Per entity: any event in the `months` months up to its last one, any ever, size at the last month."""
    seen = events.select("permno", month).distinct().join(life.select("permno", "last"), "permno")
    recent = F.col(month).between(F.col("last") - (months - 1), F.col("last"))
    flags = seen.groupBy("permno").agg(F.max(recent.cast("int")).alias("recent"), F.lit(1).alias("ever"))
    size = panel.groupBy("permno").agg(F.max_by("size_grp", month).alias("size_last"))
    return (life.join(flags, "permno", "left").join(size, "permno", "left")
            .withColumn("recent", F.coalesce("recent", F.lit(0))).withColumn("ever", F.coalesce("ever", F.lit(0))))


def event_coverage(flags: DataFrame, by: str = "group") -> DataFrame:
    return flags.groupBy(by).agg(F.count(F.lit(1)).alias("entities"), F.avg("recent").alias("recent_share"), F.avg("ever").alias("ever_share"))


def event_coverage_by_size(flags: DataFrame, groups=("left early", "left late", "listed")) -> DataFrame:
    return flags.groupBy("size_last").pivot("group", list(groups)).agg(F.avg("recent"))


def event_coverage_by_year(events: DataFrame, panel: DataFrame, life: DataFrame, month: str = "mi",
                           groups=("left early", "left late", "listed")) -> DataFrame:
    """Share of the year's panel entities with an event that year, by group and in all, and the year's events."""
    present = panel.select("permno", year_of(month).alias("year")).distinct().join(life.select("permno", "group"), "permno")
    has = events.select("permno", year_of(month).alias("year"), F.lit(1).alias("has")).distinct()
    rows = present.join(has, ["permno", "year"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    wide = rows.groupBy("year").pivot("group", list(groups)).agg(F.avg("has"))
    total = rows.groupBy("year").agg(F.avg("has").alias("all"))
    count = events.groupBy(year_of(month).alias("year")).agg(F.count(F.lit(1)).alias("events"))
    return wide.join(total, "year").join(count, "year", "left")


def plant_lookahead(panel: DataFrame, columns: list[str], month_from: int, month_to: int, month: str = "mi") -> DataFrame:
    """Overwrite one month's columns with the same entity's values of a later month."""
    src = panel.filter(F.col(month) == month_to).select("permno", F.lit(month_from).alias(month), F.lit(1).alias("__hit"),
                                                        *[F.col(c).alias(f"__{c}") for c in columns])
    joined = panel.join(src, ["permno", month], "left")
    changed = {c: F.when(F.col("__hit") == 1, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns}
    return joined.select(*[changed.get(c, F.col(c)) for c in panel.columns])


def plant_survivorship(panel: DataFrame, end: int, month: str = "mi") -> DataFrame:
    """Keep only entities present in the last month."""
    stays = panel.groupBy("permno").agg(F.max(month).alias("__last")).filter(F.col("__last") == end)
    return panel.join(stays.select("permno"), "permno", "left_semi")


def shared_ticker(panel: DataFrame, min_rows: int = 6, month: str = "mi") -> DataFrame:
    """One row (ticker, first_holder, second_holder): the first ticker with two long-standing holders."""
    n = panel.filter("ticker IS NOT NULL").groupBy("ticker", "permno").agg(
        F.count(F.lit(1)).alias("rows"), F.min(month).alias("since")).filter(F.col("rows") >= min_rows)
    w = W.partitionBy("ticker").orderBy("since", "permno")
    two = n.withColumn("place", F.row_number().over(w)).filter("place <= 2").groupBy("ticker").agg(
        F.max(F.when(F.col("place") == 1, F.col("permno"))).alias("first_holder"), F.max(F.when(F.col("place") == 2, F.col("permno"))).alias("second_holder"))
    return two.filter("second_holder IS NOT NULL").orderBy("ticker").limit(1)


def plant_ticker_error(panel: DataFrame, pick: DataFrame) -> DataFrame:
    """Give the second holder's rows under the shared ticker to the first holder."""
    swap = pick.select("ticker", F.col("second_holder").alias("permno"), F.col("first_holder").alias("__to"))
    joined = panel.join(F.broadcast(swap), ["ticker", "permno"], "left")
    return joined.withColumn("permno", F.coalesce("__to", "permno")).select(*panel.columns)


#: Slices of planted_copies: the clean rows, each error alone, all three, and the look-ahead without the columns that give it away.
COPIES = ("clean", "lookahead", "survivors", "ticker", "all", "lookahead_partial")


def planted_copies(panel: DataFrame, columns: list[str], partial: list[str], month_from: int, month_to: int, end: int, pick: DataFrame,
                   month: str = "mi") -> DataFrame:
    """panel with a `slice` column: for each of COPIES the rows that the copy has, altered as it is.

    Rows are tagged once with what the errors need (the later month's values, whether the entity stays to the end, the other holder of the
    ticker); the copies are derived from the tags when they are read, so no altered copy is ever written. `columns` are
    overwritten by the look-ahead, `partial` of them in the partial one.
    """
    src = panel.filter(F.col(month) == month_to).select("permno", F.lit(month_from).alias(month), F.struct(*columns).alias("__later"))
    last = panel.groupBy("permno").agg((F.max(month) == end).alias("__stays"))
    swap = pick.select("ticker", F.col("second_holder").alias("permno"), F.col("first_holder").alias("__to"))
    tagged = stage(panel.join(src, ["permno", month], "left").join(last, "permno").join(F.broadcast(swap), ["ticker", "permno"], "left"), "tagged")
    stays = F.col("__stays")
    member = F.array_compact(F.array(*[F.when(stays, F.lit(c)) if c in ("survivors", "all") else F.lit(c) for c in COPIES]))
    rows = tagged.withColumn("slice", F.explode(member))

    def value(c):
        if c == "permno":
            return F.when(F.col("slice").isin("ticker", "all"), F.coalesce("__to", "permno")).otherwise(F.col("permno")).alias(c)
        if c not in columns:
            return F.col(c)
        ahead = ("lookahead", "all", *(["lookahead_partial"] if c in partial else []))
        return F.when(F.col("slice").isin(*ahead) & F.col("__later").isNotNull(), F.col(f"__later.{c}")).otherwise(F.col(c)).alias(c)

    return rows.select("slice", *[value(c) for c in panel.columns])


def tagged_slices(slices: dict[str, DataFrame]) -> DataFrame:
    """Separate copies under one another, named by a `slice` column."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("slice", F.lit(name)) for name, df in slices.items()])


def rules_scorecard(p: DataFrame, names: list[str], end: int, early: int, month: str = "mi") -> DataFrame:
    """(rule, one column per slice of `names`): the panel rules on clean and altered copies, in one plan keyed by slice."""
    by = ["slice"]

    def double(c, name):
        return F.col(c).cast("double").alias(name)

    copies = p.groupBy(*by, "permno", month).agg(F.count(F.lit(1)).alias("n"))
    shared = ticker_owners(p, month, by).groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("shared_ticker_months"))
    parts = [
        timing_consistency(p, month, by=by).groupBy(*by).agg(F.sum(F.col("flagged").cast("double")).alias("timing_months_flagged")),
        copies.groupBy(*by).agg(F.sum(F.col("n") - 1).cast("double").alias("duplicate_keys")),
        copies.select(*by).distinct().join(shared, by, "left").na.fill(0.0, ["shared_ticker_months"]),
        key_changes(p, month, by).select(*by, double("changed", "key_changed"), double("switched_back", "switched_back")),
        missingness_ratio(p, month, by=by).select(*by, double("ratio", "missing_size_ratio")),
        survivorship_flag(lifetimes(p, end, early, month, by), end, by=by).select(*by, "exit_share", double("flagged", "survivorship_flag"))]
    long = reduce(lambda a, b: a.unionByName(b), [X.unpivot(f, by, [c for c in f.columns if c != "slice"], "rule", "value") for f in parts])
    return long.groupBy("rule").pivot("slice", list(names)).agg(F.first("value"))
