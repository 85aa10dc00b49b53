"""Ground-truth labels of account windows and minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitwarden.config import ACTIVITY_TAGS, LABEL_MIN_OVERLAP, PERSONAS, BarConfig
from pitwarden.functions.exprs import order_tag
from pitwarden.operators.ranges import overlap_join

WINDOW_KEYS = ("commodity", "window_start", "trader_id")


def episode_accounts(events: DataFrame) -> DataFrame:
    """One row per episode and distinct account."""
    return events.select(
        "event_id", "commodity", "persona", "start_tick", "end_tick",
        F.explode(F.array_distinct("trader_ids")).alias("trader_id"),
    )


def _spread_personas(windows: DataFrame, hits: DataFrame, personas: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """0/1 column per persona on every window; ``hits`` has (keys, persona) rows."""
    flags = hits.groupBy(*keys).agg(*[F.max((F.col("persona") == p).cast("int")).alias(p) for p in personas])
    return windows.join(flags, list(keys), "left").fillna(0, list(personas))


def span_labels(windows: DataFrame, events: DataFrame, personas: tuple[str, ...] = PERSONAS) -> DataFrame:
    """Account takes part in an episode that overlaps the window by at least 15 ticks."""
    w = windows.select(*WINDOW_KEYS, "window_end")
    pairs = overlap_join(w, episode_accounts(events), ["commodity", "trader_id"], ("window_start", "window_end"), ("start_tick", "end_tick"))
    overlap = F.least("window_end", "end_tick") - F.greatest("window_start", "start_tick")
    return _spread_personas(w, pairs.filter(overlap >= LABEL_MIN_OVERLAP), personas, WINDOW_KEYS)


def activity_labels(windows: DataFrame, events: DataFrame, orders: DataFrame, personas: tuple[str, ...] = PERSONAS) -> DataFrame:
    """Account placed an order tagged for the persona inside both the window and its episode."""
    w = windows.select(*WINDOW_KEYS, "window_end")
    acts = orders.filter("event_type = 'placed'").select(
        "commodity", "trader_id", "tick", order_tag("order_id").alias("tag")
    ).filter(F.col("tag") != "").distinct()
    wanted = F.lit(False)
    for p in personas:
        wanted = wanted | ((F.col("persona") == p) & F.col("tag").isin(*ACTIVITY_TAGS.get(p, ())))
    marked = overlap_join(acts, episode_accounts(events), ["commodity", "trader_id"], ("tick", "tick"), ("start_tick", "end_tick"))
    marked = marked.filter(wanted).select("commodity", "trader_id", "persona", "tick").distinct()
    pairs = overlap_join(w, marked, ["commodity", "trader_id"], ("window_start", "window_end"), ("tick", "tick"))
    return _spread_personas(w, pairs, personas, WINDOW_KEYS)


def minute_labels(bars: DataFrame, events: DataFrame, personas: tuple[str, ...] = PERSONAS, cfg: BarConfig | None = None) -> DataFrame:
    """Minute overlaps an episode of the persona by at least 30 seconds."""
    cfg = cfg or BarConfig()
    b = bars.select("commodity", "segment", "minute", (F.col("minute") * cfg.bar_ticks).alias("_a"), ((F.col("minute") + 1) * cfg.bar_ticks).alias("_z"))
    e = events.select("commodity", "persona", "start_tick", "end_tick")
    pairs = overlap_join(b, e, ["commodity"], ("_a", "_z"), ("start_tick", "end_tick"))
    overlap = F.least("_z", "end_tick") - F.greatest("_a", "start_tick")
    keys = ("commodity", "segment", "minute")
    return _spread_personas(b.select(*keys), pairs.filter(overlap >= cfg.label_min_overlap), personas, keys)


def merge_episode_rows(events: DataFrame) -> DataFrame:
    """Rows of one episode (same market, persona and span) as one, accounts concatenated."""
    return events.groupBy("commodity", "persona", "start_tick", "end_tick").agg(
        F.min("event_id").alias("event_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("trader_ids")))).alias("trader_ids"),
    )


def family_labels(labels: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """A family is positive when any member is."""
    return labels.withColumns({f: F.greatest(*[F.col(m) for m in members]) for f, members in families.items()})
