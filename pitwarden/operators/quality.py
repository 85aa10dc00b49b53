"""Table contracts, log invariants, calibration fits and stylized facts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.functions.exprs import rnd
from pitwarden.operators.bars import bucket
from pitwarden.operators.overview import correlation
from pitwarden.operators.ranges import overlap_join
from pitwarden.operators.steps import log_order
from pitwarden.schema import SCHEMAS, TableContract


def violations(df: DataFrame, contract: TableContract) -> DataFrame:
    """Every broken rule of a table with its number of rows; empty when the table is valid.

    Column presence and types are compared on the plan; value rules are one aggregation, and
    uniqueness a second one on the key.
    """
    spark = df.sparkSession
    have, want = {f.name: f.dataType.simpleString() for f in df.schema.fields}, dict(contract.columns)
    broken = [(f"column {c}: missing", 1) for c in want if c not in have]
    broken += [(f"column {c}: not in contract", 1) for c in have if c not in want]
    broken += [(f"column {c}: {have[c]} instead of {want[c]}", 1) for c in want if c in have and have[c] != want[c]]
    out = spark.createDataFrame(broken, "rule string, n long")
    rules = [(n, e) for n, cols, e in contract.rules if all(c in have for c in cols)]
    if rules:
        counts = df.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(f"r{i}") for i, (_, e) in enumerate(rules)])
        named = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n")) for i, (n, _) in enumerate(rules)]))
        out = out.unionByName(counts.select(named.alias("x")).select("x.*"))
    if contract.unique and contract.unique in have:
        dup = df.groupBy(contract.unique).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
        out = out.unionByName(dup.select(F.lit(f"{contract.unique}: not unique").alias("rule"), "n"))
    return out.filter("n > 0")


def check_table(df: DataFrame, name: str) -> None:
    """Raise with all broken rules of the named contract."""
    found = violations(df, SCHEMAS[name]).orderBy("rule").collect()
    if found:
        raise ValueError(f"{name}: " + "; ".join(f"{r['rule']} ({r['n']})" for r in found))


def log_invariants(trades: DataFrame, tick_size: float) -> DataFrame:
    """Volume conservation, positive values, unique ids and prices on the contract grid, per market."""
    on_grid = F.abs(F.col("price") / tick_size - F.round(F.col("price") / tick_size)) < 1e-6
    base = trades.groupBy("commodity").agg(
        F.sum("quantity").alias("volume"), F.count_if(F.col("quantity") <= 0).alias("bad_quantity"), F.count_if(F.col("price") <= 0).alias("bad_price"),
        F.count_if(~on_grid).alias("off_grid"), F.count_if(F.col("buyer_trader_id") == F.col("seller_trader_id")).alias("self_trades"),
    )
    net = trades.select("commodity", F.explode(F.array(
        F.struct(F.col("buyer_trader_id").alias("a"), F.col("quantity").alias("q")), F.struct(F.col("seller_trader_id").alias("a"), (-F.col("quantity")).alias("q"))
    )).alias("x")).groupBy("commodity").agg(F.sum("x.q").alias("net_position"))
    dup = trades.groupBy("commodity", "trade_id").count().filter("count > 1").groupBy("commodity").agg(F.sum("count").alias("duplicate_ids"))
    return base.join(net, "commodity").join(dup, "commodity", "left").fillna(0, ["duplicate_ids"])


def roll_gaps(series: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Price jumps above the threshold and missing closes, flagged and left in place."""
    w = Window.partitionBy("commodity").orderBy("at")
    prev = F.lag("close").over(w)
    change = F.when(prev > 0, F.col("close") / prev - 1)
    return series.withColumn("change", change).groupBy("commodity").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("close").isNull()).alias("missing_closes"),
        F.count_if(F.abs("change") > threshold).alias("gaps"), F.max(F.abs("change")).alias("largest_gap"),
    )


def _lag_pairs(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("commodity").orderBy("at")
    p = series.filter("close IS NOT NULL").withColumn("y", F.ln("close"))
    return p.withColumn("x", F.lag("y").over(w))


def ou_fit(series: DataFrame, dt: float = 1.0, min_rows: int = 30) -> DataFrame:
    """Mean-reversion speed, long-run mean, volatility and drift from AR(1) on log prices.

    The residual spread uses the unclamped slope; a slope outside (0, 1) is clamped for the
    speed and mean only.
    """
    p = _lag_pairs(series)
    n = p.groupBy("commodity").agg(F.count(F.lit(1)).alias("n"))
    m = p.filter("x IS NOT NULL").groupBy("commodity").agg(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg(F.col("y") - F.col("x")).alias("drift")
    )
    res = p.filter("x IS NOT NULL").join(m, "commodity").withColumn("e", F.col("y") - (F.col("a") + F.col("b") * F.col("x")))
    s = res.groupBy("commodity").agg(F.stddev_pop("e").alias("sd"))
    beta = F.when((F.col("b") > 0) & (F.col("b") < 1), F.col("b")).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("b"))))
    return m.join(s, "commodity").join(n, "commodity").filter(F.col("n") >= min_rows).select(
        "commodity", "n", F.greatest(-F.ln(beta) / dt, F.lit(1e-6)).alias("mean_reversion_speed"), F.exp(F.col("a") / (1 - beta)).alias("long_run_mean"),
        (F.col("sd") / math.sqrt(dt)).alias("volatility"), "drift",
    )


def volume_fit(series: DataFrame, min_rows: int = 10) -> DataFrame:
    """Mean and coefficient of variation of volume."""
    g = series.filter("volume IS NOT NULL").groupBy("commodity").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean_volume"), F.stddev_samp("volume").alias("sd"))
    return g.filter(F.col("n") >= min_rows).select("commodity", "n", "mean_volume", F.when(F.col("mean_volume") > 0, F.col("sd") / F.col("mean_volume")).otherwise(0.4).alias("volume_cv"))


def stylized_facts(series: DataFrame, trades: DataFrame, orders: DataFrame, events: DataFrame, maker: str = "mm_") -> DataFrame:
    """Return kurtosis and autocorrelations, order-to-trade ratio, maker spread and cancel ratios."""
    w = Window.partitionBy("commodity").orderBy("at")
    r = series.withColumn("r", F.ln(F.col("close") / F.lag("close").over(w))).filter("r IS NOT NULL")
    r = r.withColumns({"r1": F.lag("r").over(w), "a": F.abs("r"), "a1": F.abs(F.lag("r").over(w))})
    ret = r.groupBy("commodity").agg(F.kurtosis("r").alias("excess_kurtosis"), F.count(F.lit(1)).alias("n_returns"))
    lagged = r.filter("r1 IS NOT NULL").groupBy("commodity").agg(correlation("a", "a1").alias("abs_autocorr"), correlation("r", "r1").alias("raw_autocorr"))
    t = trades.groupBy("commodity").agg(F.count(F.lit(1)).alias("n_trades"))
    is_maker = F.col("trader_id").startswith(maker)
    o = orders.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("n_orders"),
        (F.avg(F.when(is_maker & (F.col("side") == "sell"), F.col("price"))) - F.avg(F.when(is_maker & (F.col("side") == "buy"), F.col("price")))).alias("maker_spread"),
    )
    per_tick = orders.groupBy("commodity", "tick").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "cancelled").alias("c"))
    spans = events.select("commodity", "start_tick", "end_tick")
    inside = overlap_join(per_tick, spans, ["commodity"], ("tick", "tick"), ("start_tick", "end_tick"), how="left_semi").withColumn("inside", F.lit(True))
    marked = per_tick.join(inside.select("commodity", "tick", "inside"), ["commodity", "tick"], "left")

    def share(cond: Column) -> Column:
        n = F.sum(F.when(cond, F.col("n")).otherwise(0))
        return F.when(n > 0, F.sum(F.when(cond, F.col("c")).otherwise(0)) / n).otherwise(0.0)

    c = marked.groupBy("commodity").agg(share(F.col("inside").isNull()).alias("normal_cancel_ratio"), share(F.col("inside").isNotNull()).alias("manip_cancel_ratio"))
    j = ret.join(lagged, "commodity").join(t, "commodity").join(o, "commodity").join(c, "commodity")
    return j.withColumn("order_to_trade", F.col("n_orders") / F.col("n_trades")).drop("n_orders", "n_trades")


def realised_volatility(trades: DataFrame, horizons: tuple[int, ...], target: Column | float, day_ticks: int = 23400) -> DataFrame:
    """Population deviation of log returns at each horizon over the target scaled to it."""
    out = None
    w = Window.partitionBy("commodity").orderBy("b")
    for h in horizons:
        px = trades.groupBy("commodity", bucket(h).alias("b")).agg(F.max_by("price", log_order()).alias("p"))
        r = px.withColumn("r", F.ln("p") - F.ln(F.lag("p").over(w))).groupBy("commodity").agg(F.stddev_pop("r").alias("realised"))
        scaled = (F.lit(target) if not isinstance(target, Column) else target) / math.sqrt(day_ticks / h)
        part = r.select("commodity", F.lit(h).alias("horizon"), "realised", (F.col("realised") / scaled).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out


def bar_statistics(series: DataFrame) -> DataFrame:
    """Standard deviation of simple returns and one minus the AR(1) slope of log prices."""
    w = Window.partitionBy("commodity").orderBy("at")
    r = series.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).groupBy("commodity").agg(F.stddev_samp("r").alias("volatility"))
    m = _lag_pairs(series).filter("x IS NOT NULL").groupBy("commodity").agg((1 - F.regr_slope("y", "x")).alias("mean_reversion"))
    return r.join(m, "commodity")


def number_tokens(text: Column | str) -> Column:
    """Distinct numbers written in a text, single digits left out."""
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"^0*\d$")))


def ungrounded_numbers(notes: DataFrame, note: str = "note", facts: str = "facts") -> DataFrame:
    """Numbers a note states that its facts do not contain; grounded when none."""
    extra = F.array_sort(F.array_except(number_tokens(note), number_tokens(facts)))
    return notes.withColumn("unsupported", extra).withColumn("grounded", F.size("unsupported") == 0)
