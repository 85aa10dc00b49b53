"""Fifty features of one-minute bars, per contiguous (commodity, segment)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.config import BarConfig
from pitwarden.functions.exprs import clip, finite, norm_cdf

from pitwarden.functions.rolling import centred, forward_sum, rolling_corr, trailing
from pitwarden.operators.lineage import spread

BACK = (3, 5, 10, 15, 30)
# Published names of the bar features, in their order.
FEATURES = (
    "ret_z_1", "ret_z_back_5", "ret_z_back_15", "ret_z_fwd_5", "ret_z_fwd_15", "range_ratio", "range_ratio_5",
    "vol_z", "vol_ratio_5", "vol_ratio_15", "body_share", "wick_share_5", "vol_per_move", "drawup_z_15",
    "drawdown_z_15", "reversal_5", "reversal_15", "up_share_10", "pv_corr_15", "zero_vol_share_15",
    "xs_ret_z_5", "xs_comove_share",
    "ret_z_back_3", "ret_z_fwd_3", "ret_z_back_10", "ret_z_fwd_10", "ret_z_back_30", "ret_z_fwd_30",
    "vrel_c5", "absz_c5", "vrel_c9", "absz_c9", "vrel_c15", "absz_c15", "range_c9",
    "ofi_5", "ofi_c5", "ofi_15", "ofi_c15", "kyle_15", "amihud_c5", "amihud_ratio",
    "roll_ac_15", "cs_spread_c5", "var_ratio_15", "jump_share_15",
    "vol_resid", "vol_resid_c5", "vol_resid_c9", "pos_30",
)
KEYS = ("commodity", "segment")


def _base(c: str, w, seg, cfg: BarConfig, fallback: Column | None = None) -> Column:
    """Trailing median ending one bar back; the whole segment's median while history is short."""
    trail = trailing(c, w, cfg.baseline, "median", cfg.min_baseline, lag=1)
    return F.coalesce(trail, F.percentile(c, 0.5).over(seg))


def series_features(bars: DataFrame, cfg: BarConfig | None = None) -> DataFrame:
    """All features except the two that compare commodities."""
    cfg = cfg or BarConfig()
    w = Window.partitionBy(*KEYS).orderBy("minute")
    seg = Window.partitionBy(*KEYS)
    c = F.col
    one = spread(bars, *KEYS).select(
        *KEYS, "minute", "open", "high", "low", "close", c("volume").cast("double").alias("vol"),
        (F.coalesce(F.ln("close") - F.ln(F.lag("close").over(w)), F.lit(0.0)) * 1e4).alias("ret"),
        ((c("high") - c("low")) / c("close") * 1e4).alias("rng"),
        F.ln(c("high") / c("low")).alias("hl"),
        F.lag("high").over(w).alias("high_1"), F.lag("low").over(w).alias("low_1"),
    ).withColumns({
        "lv": F.log1p("vol"), "abs_ret": F.abs("ret"), "ret_1": F.lag("ret").over(w), "hl_1": F.lag("hl").over(w),
        "body_share": F.when(c("high") > c("low"), F.abs(c("close") - c("open")) / (c("high") - c("low"))).otherwise(1.0),
    })
    sigma_seg = F.coalesce(F.stddev_samp("ret").over(seg), F.lit(cfg.sigma_floor_bp))
    two = one.withColumns({
        "sigma": F.greatest(F.coalesce(trailing("ret", w, cfg.baseline, "std", cfg.min_baseline, lag=1), sigma_seg), F.lit(cfg.sigma_floor_bp)),
        "rng_med": F.greatest(_base("rng", w, seg, cfg), F.lit(0.1)),
        "lv_med": _base("lv", w, seg, cfg),
        "vmed": F.greatest(_base("vol", w, seg, cfg), F.lit(1.0)),
        **{f"back_{k}": trailing("ret", w, k, "sum", 1) for k in BACK},
        **{f"fwd_{k}": forward_sum("ret", w, k) for k in BACK},
        "rng_5": trailing("rng", w, 5, "mean", 1),
        "vol_5": trailing("vol", w, 5, "mean", 1), "vol_15": trailing("vol", w, 15, "mean", 1),
        "vsum_5": trailing("vol", w, 5, "sum", 1), "vsum_15": trailing("vol", w, 15, "sum", 1),
        "vsum_c5": centred("vol", w, 5, "sum"), "vsum_c15": centred("vol", w, 15, "sum"),
        "body_5": trailing("body_share", w, 5, "mean", 1),
        "lo_15": trailing("close", w, 15, "min", 1), "hi_15": trailing("close", w, 15, "max", 1),
        "lo_30": trailing("close", w, 30, "min", 1), "hi_30": trailing("close", w, 30, "max", 1),
        "up_share_10": trailing(F.when(c("ret") > 0, 1.0).otherwise(0.0), w, 10, "mean", 1),
        "zero_vol_share_15": trailing(F.when(c("vol") <= 0, 1.0).otherwise(0.0), w, 15, "mean", 1),
        "pv": rolling_corr("abs_ret", "vol", w, 15, 5),
        "ac": trailing(c("ret") * c("ret_1"), w, 15, "mean", 5),
        "rv1": trailing(c("ret") * c("ret"), w, 15, "sum", 5),
        "bv": trailing(c("abs_ret") * F.abs("ret_1"), w, 15, "sum", 5) * (math.pi / 2),
        "cs": _corwin_schultz(),
    })
    three = two.withColumns({
        "z": c("ret") / c("sigma"), "vrel": c("vol") / c("vmed"), "lv_mad": F.abs(c("lv") - c("lv_med")),
        "rrel": c("rng") / c("rng_med"),
        "rv5": trailing(c("back_5") * c("back_5"), w, 15, "mean", 5) * 3,
        "cs_med": F.greatest(_base("cs", w, seg, cfg), F.lit(0.1)),
        "cs_c5": centred("cs", w, 5),
    }).withColumns({
        "absz": F.abs("z"),
        "signed": c("vol") * (2 * norm_cdf(clip("z", -6.0, 6.0)) - 1),
    }).withColumns({
        "sv": c("signed") / c("vmed"),
        "amihud": c("absz") / F.greatest(c("vrel"), F.lit(0.05)),
        "lv_scale": F.greatest(_base("lv_mad", w, seg, cfg) * 1.4826, F.lit(0.25)),
    })
    long = {"n": cfg.baseline, "min_periods": cfg.min_baseline, "lag": 1}
    four = three.withColumns({
        **{f"vrel_c{k}": centred("vrel", w, k) for k in (5, 9, 15)},
        **{f"absz_c{k}": centred("absz", w, k) for k in (5, 9, 15)},
        "range_c9": centred("rrel", w, 9),
        "ofi_5": trailing("signed", w, 5, "sum", 1) / F.greatest(c("vsum_5"), F.lit(1.0)),
        "ofi_15": trailing("signed", w, 15, "sum", 1) / F.greatest(c("vsum_15"), F.lit(1.0)),
        "ofi_c5": centred("signed", w, 5, "sum") / F.greatest(c("vsum_c5"), F.lit(1.0)),
        "ofi_c15": centred("signed", w, 15, "sum") / F.greatest(c("vsum_c15"), F.lit(1.0)),
        "zsv": trailing(c("z") * c("sv"), w, 15, "mean", 5),
        "mz": trailing("z", w, 15, "mean", 5), "msv": trailing("sv", w, 15, "mean", 5), "vsv": trailing("sv", w, 15, "var", 5),
        "amihud_c5": centred("amihud", w, 5), "amihud_c9": centred("amihud", w, 9),
        "a_med": F.greatest(_base("amihud", w, seg, cfg), F.lit(0.05)),
        "mx": trailing("absz", w, fn="mean", **long), "my": trailing("lv", w, fn="mean", **long),
        "mxy": trailing(c("absz") * c("lv"), w, fn="mean", **long), "vx": trailing("absz", w, fn="var", **long),
    })
    slope = F.coalesce(F.when(c("vx") > 0, (c("mxy") - c("mx") * c("my")) / c("vx")), F.lit(0.0))
    five = four.withColumn("vol_resid", F.coalesce(c("lv") - (c("my") + slope * (c("absz") - c("mx"))), F.lit(0.0)))
    five = five.withColumns({"vol_resid_c5": centred("vol_resid", w, 5), "vol_resid_c9": centred("vol_resid", w, 9)})
    vol_med = F.greatest(F.expm1("lv_med"), F.lit(1.0))
    root15 = c("sigma") * math.sqrt(15)
    out = {
        "ret_z_1": c("z"),
        **{f"ret_z_back_{k}": c(f"back_{k}") / (c("sigma") * math.sqrt(k)) for k in BACK},
        **{f"ret_z_fwd_{k}": c(f"fwd_{k}") / (c("sigma") * math.sqrt(k)) for k in BACK},
        "range_ratio": c("rrel"),
        "range_ratio_5": c("rng_5") / c("rng_med"),
        "vol_z": (c("lv") - c("lv_med")) / c("lv_scale"),
        "vol_ratio_5": c("vol_5") / vol_med,
        "vol_ratio_15": c("vol_15") / vol_med,
        "body_share": c("body_share"),
        "wick_share_5": 1.0 - c("body_5"),
        "vol_per_move": (c("lv") - c("lv_med")) / c("lv_scale") - c("absz"),
        "drawup_z_15": F.ln(c("close") / c("lo_15")) * 1e4 / root15,
        "drawdown_z_15": F.ln(c("hi_15") / c("close")) * 1e4 / root15,
        **{f"reversal_{k}": -F.signum(f"back_{k}") * (c(f"fwd_{k}") / (c("sigma") * math.sqrt(k))) for k in (5, 15)},
        "pv_corr_15": c("pv"),
        "kyle_15": clip(F.coalesce(F.when(c("vsv") > 0, (c("zsv") - c("mz") * c("msv")) / c("vsv")), F.lit(0.0)), -20.0, 20.0),
        "amihud_ratio": c("amihud_c9") / c("a_med"),
        "roll_ac_15": clip(F.coalesce(-c("ac") / (c("sigma") * c("sigma")), F.lit(0.0)), -5.0, 5.0),
        "cs_spread_c5": c("cs_c5") / c("cs_med"),
        "var_ratio_15": clip(F.coalesce(c("rv5") / F.greatest(c("rv1"), F.lit(1e-6)), F.lit(1.0)), 0.0, 5.0),
        "jump_share_15": F.coalesce(F.when(c("rv1").isNotNull() & c("bv").isNotNull(), clip((c("rv1") - c("bv")) / F.greatest(c("rv1"), F.lit(1e-6)), -1.0, 1.0)), F.lit(0.0)),
        "pos_30": F.when(c("hi_30") > c("lo_30"), (c("close") - c("lo_30")) / (c("hi_30") - c("lo_30"))).otherwise(0.5),
    }
    names = [f for f in FEATURES if not f.startswith("xs_")]
    return five.select(*KEYS, "minute", *[finite(out.get(f, c(f))).alias(f) for f in names])


def _corwin_schultz() -> Column:
    """High-low spread estimate from two bars, in basis points."""
    c = F.col
    k2 = 3 - 2 * math.sqrt(2)
    beta = c("hl") * c("hl") + c("hl_1") * c("hl_1")
    two_bar = F.ln(F.greatest("high", "high_1") / F.least("low", "low_1"))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k2 - F.sqrt(two_bar * two_bar / k2)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.coalesce(F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0))), F.lit(0.0)) * 1e4


def cross_section(features: DataFrame) -> DataFrame:
    """Five-minute move against the other commodities of the minute, and how many moved the same way."""
    r5 = F.col("ret_z_back_5")
    per = features.groupBy("minute").agg(
        F.percentile("ret_z_back_5", 0.5).alias("_med"), F.count("ret_z_back_5").alias("_n"),
        F.count_if(r5 >= 2).alias("_up"), F.count_if(r5 <= -2).alias("_down"),
    )
    same = F.when(r5 >= 2, F.col("_up") - 1).when(r5 <= -2, F.col("_down") - 1).otherwise(0)
    return features.join(per, "minute").withColumns({
        "xs_ret_z_5": F.when(F.col("_n") > 2, r5 - F.col("_med")).otherwise(r5),
        "xs_comove_share": F.when(F.col("_n") > 1, same / (F.col("_n") - 1)).otherwise(0.0),
    }).drop("_med", "_n", "_up", "_down")


def bar_features(bars: DataFrame, cfg: BarConfig | None = None) -> DataFrame:
    """Feature matrix keyed (commodity, segment, minute)."""
    return cross_section(series_features(bars, cfg)).select(*KEYS, "minute", *FEATURES)
