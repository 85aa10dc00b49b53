"""Table contracts: columns, types, value rules and keys of the six stored tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableContract:
    """``rules`` are (name, columns used, SQL condition every row must meet)."""

    columns: tuple[tuple[str, str], ...]
    rules: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    unique: str | None = None


def _c(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((p.split(" ", 1)[0], p.split(" ", 1)[1]) for p in text.split("; "))


def _positive(c: str, nullable: bool = False) -> tuple[str, tuple[str, ...], str]:
    return (f"{c}: not positive", (c,), f"{c} > 0" + (f" OR {c} IS NULL" if nullable else ""))


def _from_zero(c: str) -> tuple[str, tuple[str, ...], str]:
    return (f"{c}: negative", (c,), f"{c} >= 0")


def _unit(c: str, nullable: bool = False) -> tuple[str, tuple[str, ...], str]:
    return (f"{c}: outside [0, 1]", (c,), f"{c} BETWEEN 0 AND 1" + (f" OR {c} IS NULL" if nullable else ""))


def _present(c: str) -> tuple[str, tuple[str, ...], str]:
    return (f"{c}: missing", (c,), f"{c} IS NOT NULL")


def _one_of(c: str, values: str, nullable: bool = False) -> tuple[str, tuple[str, ...], str]:
    quoted = ", ".join(f"'{v}'" for v in values.split())
    return (f"{c}: unknown value", (c,), f"{c} IN ({quoted})" + (f" OR {c} IS NULL" if nullable else ""))


PERSONA_VALUES = "spoofing wash_trading pump_and_dump layering cornering"
SCHEMAS = {
    "trade_log": TableContract(
        _c("trade_id string; commodity string; tick bigint; price double; quantity bigint; buyer_trader_id string; seller_trader_id string; aggressor_side string"),
        (_present("trade_id"), _present("commodity"), _from_zero("tick"), _positive("price"), _positive("quantity"), _present("buyer_trader_id"),
         _present("seller_trader_id"), _one_of("aggressor_side", "buy sell")),
        "trade_id",
    ),
    "order_log": TableContract(
        _c("order_id string; commodity string; trader_id string; side string; price double; quantity bigint; tick bigint; event_type string"),
        (_present("order_id"), _present("commodity"), _present("trader_id"), _one_of("side", "buy sell", True), _positive("price", True), _positive("quantity", True),
         _from_zero("tick"), _one_of("event_type", "placed cancelled filled partial_fill rejected_cancel requote")),
    ),
    "manipulation_events": TableContract(
        _c("event_id string; commodity string; persona string; start_tick bigint; end_tick bigint; trader_ids array<string>; parameters map<string,string>"),
        (_present("event_id"), _present("commodity"), _one_of("persona", PERSONA_VALUES), _from_zero("start_tick"), _from_zero("end_tick"), _present("trader_ids"), _present("parameters"),
         ("end before start", ("start_tick", "end_tick"), "end_tick >= start_tick")),
        "event_id",
    ),
    "ohlcv_bars": TableContract(
        _c("bar_start bigint; commodity string; open double; high double; low double; close double; volume bigint"),
        (_from_zero("bar_start"), _present("commodity"), _positive("open", True), _positive("high", True), _positive("low", True), _positive("close", True), _from_zero("volume"),
         ("high below open, close or low", ("open", "high", "low", "close"), "close IS NULL OR high >= greatest(open, close, low)"),
         ("low above open or close", ("open", "low", "close"), "close IS NULL OR low <= least(open, close)")),
    ),
    "flags": TableContract(
        _c("commodity string; window_start bigint; trader_id string; window_end bigint; final_flag boolean; final_score double; iso_score double; predicted_persona string; "
           "triggered_by array<string>; top_shap_features map<string,double>; persona_scores map<string,double>; alert_tier string"),
        (_present("commodity"), _from_zero("window_start"), _present("trader_id"), _from_zero("window_end"), _present("final_flag"), _unit("final_score"), _unit("iso_score"),
         _one_of("alert_tier", "alert review none")),
    ),
    "round_metrics": TableContract(
        _c("round_num bigint; commodity string; persona string; precision double; recall double; f1 double; fpr double; detection_latency_ticks double; is_post_retrain boolean"),
        (_from_zero("round_num"), _present("commodity"), _present("persona"), _unit("precision", True), _unit("recall", True), _unit("f1", True), _unit("fpr", True), _present("is_post_retrain")),
    ),
}
