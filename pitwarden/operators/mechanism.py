"""Mechanism checks on flagged windows of one-minute bars, all windows in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pitwarden.functions.exprs import clip, rnd

PRE, POST, SNAP = 60, 30, 5
SIGMA_FLOOR_BP, MIN_JUDGED_Z = 0.5, 1.0
# Limits of the rule sets.
RULES = {
    "run_up_z": 2.5, "pd_volume_ratio": 1.5, "giveback": 0.5,
    "wash_volume_ratio": 2.5, "wash_max_move_z": 1.0, "wash_max_range_ratio": 1.3,
    "spoof_push_z": 2.0, "spoof_max_volume_ratio": 1.3, "spoof_retrace": 0.6, "spoof_wick": 0.6,
    "layer_push_z": 1.5, "layer_min_minutes": 3, "layer_retrace": 0.5,
    "comove_z": 2.0, "thin_zero_volume": 0.3, "min_post_bars": 10,
}
VERDICTS = ("consistent", "consistent (unverifiable)", "partial", "likely benign", "not consistent", "insufficient data")


HOUR = 60  # minutes of one block of bars


def _own_rows(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """A window's own bars from 60 minutes before to 30 after, each with its zone."""
    at = windows.select("window_id", "commodity", "start", "end", F.explode(F.sequence(F.col("start") - PRE, F.col("end") + POST)).alias("minute"))
    zone = F.when(F.col("minute") < F.col("start"), "pre").when(F.col("minute") <= F.col("end"), "win").otherwise("post")
    return at.join(bars.select("commodity", "minute", "open", "high", "low", "close", "volume"), ["commodity", "minute"]).withColumn("zone", zone)


def hour_blocks(bars: DataFrame) -> DataFrame:
    """(commodity, hour) -> its bars in time order, each with the minute of the bar before it and the return since.

    A block holds at most 60 bars. Only the last bar of each block is carried to the next one, so a commodity's whole
    history never passes through one window frame.
    """
    hour = F.floor(F.col("minute") / HOUR)
    blocks = bars.groupBy("commodity", hour.alias("hour")).agg(F.sort_array(F.collect_list(F.struct("minute", "open", "close"))).alias("bars"))
    ends = blocks.select("commodity", "hour", F.element_at("bars", -1).alias("last"))
    before = F.lag("last").over(Window.partitionBy("commodity").orderBy("hour"))
    linked = blocks.join(ends.select("commodity", "hour", before.alias("before")), ["commodity", "hour"])

    def returns(bar: Column, i: Column) -> Column:
        prev = F.when(i == 0, F.col("before")).otherwise(F.get("bars", i - 1))
        return F.struct(bar["minute"].alias("minute"), bar["open"].alias("open"), bar["close"].alias("close"), prev["minute"].alias("prev"),
                        ((F.ln(bar["close"]) - F.ln(prev["close"])) * 1e4).alias("r"))

    return linked.select("commodity", "hour", F.transform("bars", returns).alias("bars"))


def _spread(values: Column) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares of an array."""
    zero = F.lit(0.0)
    return F.size(values), F.aggregate(values, zero, lambda a, x: a + x), F.aggregate(values, zero, lambda a, x: a + x * x)


def _sd(n: str, total: str, squares: str) -> Column:
    """Sample deviation from count, sum and sum of squares; missing below two values."""
    rest = F.col(squares) - F.col(total) * F.col(total) / F.col(n)
    return F.when(F.col(n) > 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col(n) - 1)))


def moves(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Per (window, commodity): reference price, volatility, move and its z-score.

    A window meets every commodity, as each may be its peer, through the hours it touches: rows are windows x
    commodities x hours, not minutes. Windows without a bar of a commodity have no row for it.
    """
    hours = F.sequence(F.floor((F.col("start") - PRE) / HOUR), F.floor(F.col("end") / HOUR))
    asked = windows.select("window_id", F.col("commodity").alias("home"), "start", "end", F.explode(hours).alias("hour"))
    j = asked.join(hour_blocks(bars), "hour")
    lo, start, end = F.col("start") - PRE, F.col("start"), F.col("end")
    j = j.select(
        "window_id", "home", "start", "end", "commodity",
        F.filter("bars", lambda b: (b["minute"] >= lo) & (b["minute"] < start)).alias("pre"),
        F.filter("bars", lambda b: (b["minute"] >= start) & (b["minute"] <= end)).alias("win"),
    ).filter((F.size("pre") > 0) | (F.size("win") > 0))

    def inner(zone: str, since: Column) -> Column:
        return F.transform(F.filter(zone, lambda b: (b["prev"] >= since) & b["r"].isNotNull()), lambda b: b["r"])

    parts = {}
    for zone, since in (("pre", lo), ("win", start)):
        parts |= dict(zip((f"n_{zone}", f"sum_{zone}", f"sq_{zone}"), _spread(inner(zone, since))))
    pre_last, win_first, win_last = F.get("pre", F.size("pre") - 1), F.get("win", F.lit(0)), F.get("win", F.size("win") - 1)
    g = j.select(
        "window_id", "home", "start", "end", "commodity", F.size("win").alias("n"), F.size("pre").alias("pre_bars"), pre_last.alias("pre_last"),
        win_first.alias("win_first"), win_last.alias("win_last"), *[v.alias(k) for k, v in parts.items()],
    ).groupBy("window_id", "home", "start", "end", "commodity").agg(
        *[F.sum(c).alias(c) for c in ("n", "pre_bars", *parts)],
        F.max_by("pre_last", F.col("pre_last.minute"))["close"].alias("pre_close"),
        F.min_by("win_first", F.col("win_first.minute"))["open"].alias("win_open"),
        F.max_by("win_last", F.col("win_last.minute"))["close"].alias("win_close"),
    ).filter("n > 0")
    sd = F.when(F.col("n_pre") > 5, _sd("n_pre", "sum_pre", "sq_pre")).otherwise(_sd("n_win", "sum_win", "sq_win"))
    g = g.withColumns({"ref": F.coalesce("pre_close", "win_open"), "sd": sd})
    g = g.withColumns({"sigma": F.when(F.col("sd").isNotNull(), F.greatest("sd", F.lit(SIGMA_FLOOR_BP))), "move_bp": F.ln(F.col("win_close") / F.col("ref")) * 1e4})
    return g.drop("sd", *parts).withColumn("move_z", F.col("move_bp") / (F.col("sigma") * F.sqrt(F.col("n").cast("double"))))


def comovers(moved: DataFrame, sectors: DataFrame, comove_z: float = RULES["comove_z"]) -> DataFrame:
    """Other commodities that moved the same way in the window, and how many share its sector."""
    s = sectors.select("commodity", "sector")
    own = moved.filter("commodity = home").select("window_id", F.col("move_z").alias("own_z"))
    peers = moved.filter("commodity <> home").join(own, "window_id").join(s, "commodity", "left")
    peers = peers.join(s.withColumnsRenamed({"commodity": "home", "sector": "home_sector"}), "home", "left")
    with_us = (F.abs("move_z") >= comove_z) & (F.signum("move_z") == F.signum("own_z"))
    return peers.groupBy("window_id").agg(
        F.count_if(with_us).alias("n_comoving"),
        F.count_if(with_us & F.col("sector").eqNullSafe(F.col("home_sector"))).alias("n_comoving_same_sector"),
    )


def evidence(windows: DataFrame, bars: DataFrame, moved: DataFrame, peers: DataFrame) -> DataFrame:
    """Measured numbers of each window: excursion, retracement, give-back, volume, range, wicks."""
    own = moved.filter("commodity = home").select("window_id", "ref", "sigma", "n", "pre_bars", "move_bp", "move_z", "win_close")
    rows = _own_rows(windows, bars).join(own, "window_id")
    pre, win, post = (F.col("zone") == z for z in ("pre", "win", "post"))
    order = Window.partitionBy("window_id", "zone").orderBy("minute")
    span = F.col("high") - F.col("low")
    rows = rows.withColumns({
        "path": F.ln(F.col("close") / F.col("ref")) * 1e4, "k": F.row_number().over(order) - 1, "rng": span / F.col("close") * 1e4,
        "wick": F.when(span > 0, 1 - F.abs(F.col("close") - F.col("open")) / span).otherwise(0.0),
    })
    snap = post & (F.col("minute") <= F.col("end") + SNAP)

    def avg(c: str, cond: Column) -> Column:
        return F.avg(F.when(cond, F.col(c)))

    def med(c: str, cond: Column) -> Column:
        return F.percentile(F.when(cond, F.col(c)), 0.5)

    dry = F.when(F.col("volume") <= 0, 1.0).otherwise(0.0)
    g = rows.groupBy("window_id", "sigma", "n", "pre_bars", "move_bp", "move_z", "win_close").agg(
        F.max_by(F.when(win, F.struct("path", "k")), F.when(win, F.struct(F.abs("path").alias("a"), (-F.col("k")).alias("k")))).alias("peak"),
        F.max(F.when(win, F.col("path"))).alias("top"), F.count_if(post).alias("post_bars"),
        F.max_by(F.when(post, F.col("close")), F.when(post, F.col("minute"))).alias("post_close"),
        F.max_by(F.when(snap, F.col("close")), F.when(snap, F.col("minute"))).alias("snap_close"),
        avg("volume", win).alias("v_win"), avg("volume", post).alias("v_post"), med("volume", pre).alias("v_pre"), med("volume", win).alias("v_med"),
        avg("rng", win).alias("r_win"), med("rng", pre).alias("r_pre"), med("rng", win).alias("r_med"), avg("wick", win).alias("wick_share"),
        F.avg(F.when(win, dry)).alias("zero_volume_share"), F.avg(F.when(pre, dry)).alias("zero_volume_share_before"),
    )
    peak, k = F.col("peak.path"), F.col("peak.k")
    peak_z = peak / (F.col("sigma") * F.sqrt((k + 1).cast("double")))
    post_move = F.ln(F.col("post_close") / F.col("win_close")) * 1e4
    final = F.col("move_bp") + F.coalesce(F.ln(F.col("snap_close") / F.col("win_close")) * 1e4, F.lit(0.0))
    retrace = F.when(F.abs(peak_z) >= MIN_JUDGED_Z, 1.0 - final * F.signum(peak) / F.abs(peak))
    giveback = F.when(F.abs("move_z") >= MIN_JUDGED_Z, -post_move / F.col("move_bp"))
    vol_base = F.greatest(F.coalesce("v_pre", "v_med"), F.lit(1.0))
    rng_base = F.greatest(F.coalesce("r_pre", "r_med"), F.lit(0.1))

    def r2(c: Column) -> Column:
        return rnd(c, 2)

    out = g.select(
        "window_id", F.col("n").alias("minutes"), "pre_bars", "post_bars", r2(F.col("sigma")).alias("sigma_1min_bp"), r2(F.col("move_bp")).alias("move_bp"),
        r2(F.col("move_z")).alias("move_z"), r2(peak).alias("peak_excursion_bp"), r2(peak_z).alias("peak_excursion_z"), k.cast("long").alias("peak_minute_offset"),
        r2(F.greatest("top", F.lit(0.0)) / (F.col("sigma") * F.sqrt(F.col("n").cast("double")))).alias("max_run_up_z"),
        F.when(retrace.isNotNull(), rnd(clip(retrace, -1.0, 1.0) * 100, 0)).alias("retrace_pct_by_5min_after"), r2(post_move).alias("post_30min_move_bp"),
        F.when(giveback.isNotNull(), rnd(clip(giveback, -3.0, 3.0) * 100, 0)).alias("giveback_pct"),
        r2(F.col("v_win") / vol_base).alias("volume_ratio"), r2(F.col("v_post") / vol_base).alias("volume_ratio_after"), r2(F.col("r_win") / rng_base).alias("range_ratio"),
        r2(F.col("wick_share")).alias("wick_share"), r2(F.col("zero_volume_share")).alias("zero_volume_share"), r2(F.col("zero_volume_share_before")).alias("zero_volume_share_before"),
    )
    return out.join(peers, "window_id", "left").fillna(0, ["n_comoving", "n_comoving_same_sector"])


def _verdict(tests: list[Column], benign: Column, unverifiable: bool, hard: Column) -> tuple[Column, Column]:
    passed = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    share = passed / F.lit(float(len(tests)))
    full, half = passed == len(tests), share >= 0.5
    good = "consistent (unverifiable)" if unverifiable else "consistent"
    name = (F.when(full & hard, "likely benign").when(full, good).when(half & hard, "likely benign").when(half, "partial").otherwise("not consistent"))
    base = 0.5 if unverifiable else 0.75
    conf = F.when(full & hard, 0.2).when(full, F.when(benign, base * 0.7).otherwise(base)).when(half, 0.3 * share).otherwise(0.1 * share)
    return name, rnd(conf, 2)


def check(ev: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """Verdict and confidence per persona, benign explanations and the best match.

    Optional columns ``fixed_events`` and ``possible_events`` count scheduled events.
    """
    R = {**RULES, **(rules or {})}
    for c in ("fixed_events", "possible_events"):
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(0))
    v = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("max_run_up_z", "volume_ratio", "move_bp", "peak_excursion_bp", "move_z", "peak_excursion_z", "retrace_pct_by_5min_after", "wick_share", "zero_volume_share")}
    ratio9, range9 = F.coalesce("volume_ratio", F.lit(9.0)), F.coalesce("range_ratio", F.lit(9.0))
    # A ratio of exactly zero counts as unknown in the upper-bound tests.
    ratio9, range9 = F.when(ratio9 == 0, 9.0).otherwise(ratio9), F.when(range9 == 0, 9.0).otherwise(range9)
    together = (F.col("n_comoving_same_sector") >= 1) | (F.col("n_comoving") >= 2)
    hard = (F.col("fixed_events") > 0) | together
    reasons = F.array_compact(F.array(
        F.when(F.col("fixed_events") > 0, "scheduled event"), F.when(F.col("possible_events") > 0, "usual release window"),
        F.when(together, "moved with other commodities"), F.when(v["zero_volume_share"] >= R["thin_zero_volume"], "thin market"),
    ))
    benign = F.size(reasons) > 0
    late = F.col("post_bars") >= R["min_post_bars"]
    peak_z = F.abs(v["peak_excursion_z"])
    tests = {
        "pump_and_dump": ([v["max_run_up_z"] >= R["run_up_z"], v["volume_ratio"] >= R["pd_volume_ratio"], late & (F.col("giveback_pct") >= R["giveback"] * 100),
                           (v["move_bp"] > 0) | (v["peak_excursion_bp"] > 0)], False),
        "wash_trading": ([v["volume_ratio"] >= R["wash_volume_ratio"], F.abs(v["move_z"]) <= R["wash_max_move_z"], range9 <= R["wash_max_range_ratio"]], True),
        "spoofing": ([peak_z >= R["spoof_push_z"], ratio9 <= R["spoof_max_volume_ratio"], v["retrace_pct_by_5min_after"] >= R["spoof_retrace"] * 100,
                      v["wick_share"] >= R["spoof_wick"]], True),
        "layering": ([peak_z >= R["layer_push_z"], F.col("peak_minute_offset") + 1 >= R["layer_min_minutes"], ratio9 <= R["spoof_max_volume_ratio"],
                      v["retrace_pct_by_5min_after"] >= R["layer_retrace"] * 100], True),
    }
    cols, ranked = {}, []
    order = F.array(*[F.lit(x) for x in VERDICTS])
    for i, (p, (t, unverifiable)) in enumerate(tests.items()):
        cols[f"verdict_{p}"], cols[f"confidence_{p}"] = _verdict(t, benign, unverifiable, hard)
        ranked.append(F.struct(F.array_position(order, F.col(f"verdict_{p}")).alias("v"), (-F.col(f"confidence_{p}")).alias("c"), F.lit(i).alias("i"), F.lit(p).alias("p")))
    out = ev.withColumns({"benign": F.array_join(reasons, "; "), "hard_benign": hard}).withColumns(cols)
    return out.withColumn("best_match", F.array_min(F.array(*ranked))["p"])


def event_counts(events: DataFrame) -> DataFrame:
    """(window_id) -> scheduled events in its span, by certainty."""
    n = [F.count_if(F.col("certainty") == c).alias(f"{c}_events") for c in ("fixed", "possible")]
    return events.groupBy("window_id").agg(*n)


def mechanism_checks(windows: DataFrame, bars: DataFrame, sectors: DataFrame, events: DataFrame | None = None, rules: dict[str, float] | None = None) -> DataFrame:
    """Evidence and verdicts of all windows (window_id, commodity, start, end minutes).

    ``events``: rows of ``scheduled_events`` for the same windows, when their times are real. A window without a bar of
    its commodity has insufficient data for every persona, confidence 0 and no best match.
    """
    moved = moves(windows, bars)
    ev = evidence(windows, bars, moved, comovers(moved, sectors))
    counts = ["fixed_events", "possible_events"]
    if events is not None:
        ev = ev.join(event_counts(events), "window_id", "left").fillna(0, counts)
    judged = windows.select("window_id", "commodity", "start", "end").join(check(ev, rules), "window_id", "left")
    verdicts = [c for c in judged.columns if c.startswith("verdict_")]
    filled = {v: F.coalesce(v, F.lit("insufficient data")) for v in verdicts}
    filled |= {c: F.coalesce(c, F.lit(0.0)) for c in (v.replace("verdict", "confidence") for v in verdicts)}
    return judged.withColumn("available", F.col("minutes").isNotNull()).withColumns(filled)


def prediction_summary(scores: DataFrame, personas: tuple[str, ...]) -> DataFrame:
    """Minutes scored and flagged, flag rate and flagged minutes per persona."""
    return scores.agg(
        F.count(F.lit(1)).alias("minutes_scored"), F.count_if("flag").alias("minutes_flagged"), rnd(F.avg(F.col("flag").cast("double")), 4).alias("flag_rate"),
        *[F.count_if(F.col("predicted_persona") == p).alias(p) for p in personas],
    )


# Recurring scheduled events. days: 0 = Monday.
WEEK = (0, 1, 2, 3, 4)
NEW_YORK, LONDON = "America/New_York", "Europe/London"
CALENDAR = (
    ("US economic data releases (8:30 ET)", 8, 30, NEW_YORK, ("all",), WEEK, "scheduled release", "possible"),
    ("US economic data releases (10:00 ET)", 10, 0, NEW_YORK, ("all",), WEEK, "scheduled release", "possible"),
    ("FOMC statement window (14:00 ET)", 14, 0, NEW_YORK, ("all",), WEEK, "scheduled release", "possible"),
    ("Daily Globex halt starts (17:00 ET)", 17, 0, NEW_YORK, ("all",), WEEK, "session", "fixed"),
    ("Globex reopen, thin liquidity (18:00 ET)", 18, 0, NEW_YORK, ("all",), (6, 0, 1, 2, 3), "session", "fixed"),
    ("NYMEX energy day session open", 9, 0, NEW_YORK, ("energy",), WEEK, "session", "fixed"),
    ("EIA weekly petroleum status report", 10, 30, NEW_YORK, ("crude_oil_wti", "brent_crude"), (2,), "scheduled release", "fixed"),
    ("EIA weekly natural gas storage report", 10, 30, NEW_YORK, ("natural_gas",), (3,), "scheduled release", "fixed"),
    ("API weekly crude inventory", 16, 30, NEW_YORK, ("crude_oil_wti", "brent_crude"), (1,), "scheduled release", "fixed"),
    ("NYMEX energy settlement window", 14, 28, NEW_YORK, ("energy",), WEEK, "settlement", "fixed"),
    ("COMEX metals day session open", 8, 20, NEW_YORK, ("metals",), WEEK, "session", "fixed"),
    ("LBMA gold price (AM auction)", 10, 30, LONDON, ("gold",), WEEK, "benchmark fix", "fixed"),
    ("LBMA gold price (PM auction)", 15, 0, LONDON, ("gold",), WEEK, "benchmark fix", "fixed"),
    ("LBMA silver price auction", 12, 0, LONDON, ("silver",), WEEK, "benchmark fix", "fixed"),
    ("COMEX copper settlement window", 12, 58, NEW_YORK, ("copper",), WEEK, "settlement", "fixed"),
    ("COMEX silver settlement window", 13, 24, NEW_YORK, ("silver",), WEEK, "settlement", "fixed"),
    ("COMEX gold settlement window", 13, 29, NEW_YORK, ("gold",), WEEK, "settlement", "fixed"),
    ("CBOT grains day session open", 9, 30, NEW_YORK, ("grains",), WEEK, "session", "fixed"),
    ("USDA reports (12:00 ET, e.g. WASDE)", 12, 0, NEW_YORK, ("grains",), WEEK, "scheduled release", "possible"),
    ("CBOT grains close and settlement", 14, 14, NEW_YORK, ("grains",), WEEK, "settlement", "fixed"),
    ("USDA crop progress (Mondays 16:00 ET)", 16, 0, NEW_YORK, ("grains",), (0,), "scheduled release", "fixed"),
)
BEFORE_MIN, AFTER_MIN = 3, 15


def calendar(spark: SparkSession) -> DataFrame:
    """The 21 recurring events, one row per event and scope."""
    schema = "event string, hour int, minute int, tz string, scope array<string>, days array<int>, kind string, certainty string"
    return spark.createDataFrame(list(CALENDAR), schema).withColumn("scope", F.explode("scope"))


def scheduled_events(windows: DataFrame, cal: DataFrame, sectors: DataFrame) -> DataFrame:
    """Events whose [-3, +15] minute span meets a window; start_utc/end_utc are epoch seconds.

    Windows and events meet on scope (everything, sector or commodity), then on the local days
    around the window.
    """
    w = windows.join(sectors.select("commodity", "sector"), "commodity", "left")
    w = w.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), "commodity", "sector"))))
    j = w.join(cal, "scope")
    day = F.explode(F.sequence(
        F.to_date(F.timestamp_seconds(F.col("start_utc") - 2 * 86400)), F.to_date(F.timestamp_seconds(F.col("end_utc") + 2 * 86400))
    ))
    j = j.withColumn("day", day).filter(F.array_contains("days", F.weekday("day")))
    wall = F.concat_ws(" ", F.col("day").cast("string"), F.format_string("%02d:%02d:00", "hour", "minute"))
    local = F.to_timestamp_ntz(wall, F.lit("yyyy-MM-dd HH:mm:ss"))
    at = F.unix_timestamp(F.convert_timezone(F.col("tz"), F.lit("UTC"), local).cast("timestamp"))
    hit = j.withColumn("at", at).filter((F.col("at") - BEFORE_MIN * 60 <= F.col("end_utc")) & (F.col("at") + AFTER_MIN * 60 >= F.col("start_utc")))
    return hit.select("window_id", "event", "kind", "certainty", F.col("at").alias("at_utc")).distinct()
