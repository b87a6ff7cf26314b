"""Candidate selection with month-to-month memory.

Only names that can still be chosen enter the fold: for leg sizes n and a retention
zone of n * buffer, a month needs the first max(zone, 2n + other leg) names of each
order. The month arrays are therefore bounded by the leg sizes, whatever the size of
the universe, and Spark keeps just those rows per map task (top-k before the shuffle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDS = "array<bigint>"
#: Deepest rank that Spark cuts to in the map tasks (its windowGroupLimitThreshold), and the parts a month is dealt into beyond it.
MAP_SIDE_DEPTH, PARTS = 1000, 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a name, so that it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _pick(ids: Column, held: Column, n: Column, zone: Column, skip_kept: Column, skip_fill: Column) -> Column:
    """Incumbents inside the zone in rank order, then the best others, n in all."""
    kept = F.slice(F.array_except(F.array_intersect(F.slice(ids, F.lit(1), zone), held), skip_kept), F.lit(1), n)
    return _let(kept, lambda k: F.concat(
        k, F.slice(F.array_except(ids, F.concat(k, skip_fill)), F.lit(1), n - F.size(k))))


def _head(df: DataFrame, keys: list[str], order: list[Column], depth: int, rank: str) -> DataFrame:
    """The first `depth` rows of each group with their rank. Deep heads are cut in parts of the group first, so that no task sorts a whole month."""
    if depth > MAP_SIDE_DEPTH:
        parts = W.partitionBy(*keys, "__part").orderBy(*order)
        df = (df.withColumn("__part", F.pmod(F.xxhash64("permno"), F.lit(PARTS))).withColumn(rank, F.row_number().over(parts))
              .filter(F.col(rank) <= depth).drop("__part", rank))
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= depth)


def _full(legs: Column, n_long, n_short, strict: bool) -> Column:
    """The legs; strict fails the job when one is short."""
    if not strict:
        return legs
    whole = (F.size(legs["longs"]) == n_long) & (F.size(legs["shorts"]) == n_short)
    return F.when(whole, legs).otherwise(F.raise_error(F.lit("a leg is short of names")).cast(f"struct<longs:{IDS},shorts:{IDS}>"))


def _ordered_ids(df: DataFrame, keys: list[str], order: list[Column], depth: int, out: str) -> DataFrame:
    head = _head(df, keys, order, depth, "__n")
    pairs = F.sort_array(F.collect_list(F.struct("__n", F.col("permno").cast("bigint").alias("id"))))
    return head.groupBy(*keys).agg(F.transform(pairs, lambda p: p["id"]).alias(out))


def _empty() -> Column:
    return F.array().cast(IDS)


def _explode_picks(history: DataFrame, keys: list[str], month: str) -> DataFrame:
    picks = history.select(*keys, F.explode("picks").alias("p"))
    longs = picks.select(*keys, F.col(f"p.{month}").alias(month), F.lit(1).alias("side"),
                         F.posexplode("p.longs").alias("place", "permno"))
    shorts = picks.select(*keys, F.col(f"p.{month}").alias(month), F.lit(-1).alias("side"),
                          F.posexplode("p.shorts").alias("place", "permno"))
    return longs.unionByName(shorts).withColumn("place", F.col("place") + 1)


def _fold(months: DataFrame, keys: list[str], month: str, fields: list[str], step) -> DataFrame:
    """Fold step(state, month row) over the months of each key; collects every month's picks."""
    rows = F.sort_array(F.collect_list(F.struct(month, *fields)))
    out_type = f"array<struct<{month}:int,longs:{IDS},shorts:{IDS}>>"
    init = F.struct(_empty().alias("hl"), _empty().alias("hs"), F.array().cast(out_type).alias("picks"))

    def merge(acc, x):
        return _let(step(acc, x), lambda s: F.struct(
            s["longs"].alias("hl"), s["shorts"].alias("hs"),
            F.concat(acc["picks"], F.array(F.struct(x[month].cast("int").alias(month), s["longs"].alias("longs"),
                                                    s["shorts"].alias("shorts")))).alias("picks")))

    folded = months.groupBy(*keys).agg(rows.alias("rows"))
    return folded.select(*keys, F.aggregate("rows", init, merge, lambda acc: acc["picks"]).alias("picks"))


def select_asymmetric(scores: DataFrame, n_long: int, n_short: int, buffer: float = 2.5, short_min_me: float = 500.0,
                      keys: list[str] | None = None, month: str = "target_mi", keep_excludes_opposite: bool = True,
                      strict: bool = True) -> DataFrame:
    """Long and short candidates with retention: (keys, month, permno, side, place).

    Long order: score down, permno up. Short order: its exact reverse among names of
    at least short_min_me. A name held on the other side last month is not bought;
    keep_excludes_opposite applies that to retained longs as well. strict fails the job
    when a month cannot fill both legs.
    """
    keys = list(keys or [])
    by = [*keys, month]
    zone_l, zone_s = int(n_long * buffer), int(n_short * buffer)
    depth_l, depth_s = max(zone_l, 2 * n_long + n_short), max(zone_s, 2 * n_short + n_long)
    longs = _ordered_ids(scores, by, [F.col("score").desc(), F.col("permno").asc()], depth_l, "ids_l")
    shorts = _ordered_ids(scores.filter(F.col("me") >= short_min_me), by,
                          [F.col("score").asc(), F.col("permno").desc()], depth_s, "ids_s")
    months = longs.join(shorts, by, "left").withColumn("ids_s", F.coalesce("ids_s", _empty()))

    def step(acc, x):
        skip = acc["hs"] if keep_excludes_opposite else _empty()
        chosen = _pick(x["ids_l"], acc["hl"], F.lit(n_long), F.lit(zone_l), skip, acc["hs"])
        legs = _let(chosen, lambda long_ids: F.struct(
            long_ids.alias("longs"),
            _pick(x["ids_s"], acc["hs"], F.lit(n_short), F.lit(zone_s), long_ids, long_ids).alias("shorts")))
        return _let(legs, lambda both: _full(both, n_long, n_short, strict))

    return _explode_picks(_fold(months, keys, month, ["ids_l", "ids_s"], step), keys, month)


def select_global(scores: DataFrame, n: int = 150, buffer: float = 2.5, short_min_me: float = 500.0, **kw) -> DataFrame:
    """Equal leg sizes; incumbent longs stay even if they were also held short."""
    return select_asymmetric(scores, n, n, buffer, short_min_me, keep_excludes_opposite=False, **kw)


def sector_quota(scores: DataFrame, n: int, short_min_me: float = 500.0, month: str = "target_mi", strict: bool = True) -> DataFrame:
    """Slots per (month, sector), equal on both legs.

    The floor of n times the sector's share, capped by the thinner leg's supply;
    what is left goes slot by slot to the sector with most spare capacity (ties:
    the later sector). Slot j of a sector's spare capacity has priority j, so
    taking the highest priorities is the same greedy choice. strict fails the job
    when a month's sectors cannot take n slots.
    """
    supply = scores.groupBy(month, "sector").agg(
        F.count(F.lit(1)).alias("names"), F.sum((F.col("me") >= short_min_me).cast("long")).alias("short_names"))
    total = supply.groupBy(month).agg(F.sum("names").alias("universe"))
    base = (supply.join(total, month).withColumn("cap", F.least("names", "short_names"))
            .withColumn("want", F.least("cap", F.floor(F.lit(n) * F.col("names") / F.col("universe")))))
    left = base.groupBy(month).agg((F.lit(n) - F.sum("want")).alias("rem"))
    base = base.join(left, month).withColumn("spare", F.col("cap") - F.col("want"))
    slots = base.filter("spare > 0 AND rem > 0").select(
        month, "sector", "rem", F.explode(F.sequence(F.greatest(F.lit(1), F.col("spare") - F.col("rem") + 1), F.col("spare"))).alias("slot"))
    order = W.partitionBy(month).orderBy(F.col("slot").desc(), F.col("sector").desc())
    extra = (slots.withColumn("__n", F.row_number().over(order)).filter("__n <= rem")
             .groupBy(month, "sector").agg(F.count(F.lit(1)).alias("extra")))
    slots = (F.col("want") + F.coalesce("extra", F.lit(0))).cast("int")
    if strict:  # a month's sectors are few
        filled = F.sum(slots).over(W.partitionBy(month)) == n
        slots = F.when(filled, slots).otherwise(F.raise_error(F.lit("sectors cannot fill the quota")).cast("int"))
    return base.join(extra, [month, "sector"], "left").select(month, "sector", "names", "short_names", slots.alias("slots"))


def select_sector_balanced(scores: DataFrame, n: int, buffer: float = 2.5, short_min_me: float = 500.0,
                           month: str = "target_mi", strict: bool = True) -> DataFrame:
    """Quotas per sector, the same count on both legs, retention inside the sector.

    Shorts are ordered by score up, permno up. Incumbency is global: a name that
    changed sector keeps it. strict fails the job when a quota or a leg stays short.
    """
    by = [month, "sector"]
    quotas = sector_quota(scores, n, short_min_me, month, strict).filter("slots > 0").select(*by, "slots")
    depth = max(3 * n, int(n * buffer))
    longs = _ordered_ids(scores, by, [F.col("score").desc(), F.col("permno").asc()], depth, "ids_l")
    shorts = _ordered_ids(scores.filter(F.col("me") >= short_min_me), by,
                          [F.col("score").asc(), F.col("permno").asc()], depth, "ids_s")
    cells = (quotas.join(longs, by).join(shorts, by)
             .withColumn("zone", F.floor(F.col("slots") * F.lit(buffer)).cast("int")))
    need = F.greatest(3 * F.col("slots"), F.col("zone"))
    cells = cells.withColumn("ids_l", F.slice("ids_l", F.lit(1), need)).withColumn("ids_s", F.slice("ids_s", F.lit(1), need))
    months = cells.groupBy(month).agg(F.sort_array(F.collect_list(F.struct("sector", "slots", "zone", "ids_l", "ids_s"))).alias("cells"))

    def step(acc, x):
        def one(s):
            chosen = _pick(s["ids_l"], acc["hl"], s["slots"], s["zone"], _empty(), _empty())
            return _let(chosen, lambda long_ids: F.struct(
                long_ids.alias("l"), _pick(s["ids_s"], acc["hs"], s["slots"], s["zone"], long_ids, long_ids).alias("s")))
        legs = _let(F.transform(x["cells"], one), lambda picks: F.struct(
            F.flatten(F.transform(picks, lambda p: p["l"])).alias("longs"),
            F.flatten(F.transform(picks, lambda p: p["s"])).alias("shorts")))
        return _let(legs, lambda both: _full(both, n, n, strict))

    return _explode_picks(_fold(months, [], month, ["cells"], step), [], month)


def select_naive(scores: DataFrame, n: int = 100, month: str = "target_mi") -> DataFrame:
    """First and last n of the order (score down, permno up); no memory."""
    longs = _head(scores, [month], [F.col("score").desc(), F.col("permno").asc()], n, "place").withColumn("side", F.lit(1))
    shorts = _head(scores, [month], [F.col("score").asc(), F.col("permno").desc()], n, "place").withColumn("side", F.lit(-1))
    return longs.unionByName(shorts)


def with_scores(picks: DataFrame, scores: DataFrame, month: str = "target_mi") -> DataFrame:
    """Attach the scored row of each pick."""
    return picks.join(scores, [month, "permno"])


def check_legs(candidates: DataFrame, n_long: int, n_short: int, min_price: float, short_min_me: float,
               excluded=("nano", "micro"), keys: list[str] | None = None, month: str = "target_mi") -> DataFrame:
    """Per month: leg counts and the number of rows that break a selection rule."""
    long, short = F.col("side") > 0, F.col("side") < 0

    def count(cond):
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    out = candidates.groupBy(*(keys or []), month).agg(
        count(long).alias("longs"), count(short).alias("shorts"),
        count(F.abs("prc") < min_price).alias("below_price"), count(F.col("size_grp").isin(*excluded)).alias("excluded_size"),
        count(short & (F.col("me") < short_min_me)).alias("small_shorts"),
        (F.count(F.lit(1)) - F.count_distinct("permno")).alias("on_both_legs"))
    ok = ((F.col("longs") == n_long) & (F.col("shorts") == n_short) & (F.col("below_price") == 0)
          & (F.col("excluded_size") == 0) & (F.col("small_shorts") == 0) & (F.col("on_both_legs") == 0))
    return out.withColumn("passed", ok)
