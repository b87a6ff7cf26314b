"""From forecasts and a panel to the neutralised, smoothed score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators import crosssection as X
from crossweave.operators import prep as P
from crossweave.session import Checks, stage

KEEP = ("permno", "target_mi", "observed_mi", "eom", "forecast", "alt_forecast", "prc", "me", "size_grp", "gics", "sector",
        "rvol_21d", "dolvol_126d", "ticker", "company_name", "beta_use", "pe_pct")


def universe(forecasts: DataFrame, panel: DataFrame, min_price: float, with_valuation: bool = True, checks: Checks | None = None) -> DataFrame:
    """Lagged join -> beta -> screen -> sector -> valuation percentile, in that order.

    Panel rows that the screen will drop go through the join, which counts missing partners, as empty rows.
    """
    given = panel.withColumn("beta_use", P.beta_use())
    screened = given.select("permno", "mi", *[F.when(P.screen(min_price), F.col(c)).alias(c) for c in given.columns if c not in ("permno", "mi")])
    joined = P.lagged_join(forecasts, screened, checks=checks)
    kept = P.eligible(joined, min_price).withColumn("sector", P.sector_code())
    if with_valuation:
        kept = X.attach_trailing_percentile(kept, panel, month="target_mi", ahead=1)
    return kept.select(*[c for c in KEEP if c in kept.columns])


def score(universe_df: DataFrame, extra_signals: dict[str, float] | None = None, smooth_months: int = 3,
          decimals: int = 10) -> DataFrame:
    """Signal and size ranks, neutralised residual, smoothed over the entity's rows.

    The residual is rounded so that float noise cannot decide a rank.
    """
    ranked = stage(X.blend(universe_df, "forecast", ["target_mi"], extra_signals, also={"me": "size"}), "signal", codec="zstd")
    resid = X.neutralise(ranked, "signal", "size", "beta_use", "target_mi", "sector", "residual")
    return X.smooth(resid, "residual", smooth_months, out="score").withColumn("score", F.round("score", decimals))
