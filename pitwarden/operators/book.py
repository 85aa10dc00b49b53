"""The order book from its log: what rested, best prices over time, depth near the touch, inversions.

Two lookups carry it, both without a window over a whole market:

* The best price at a tick is the extreme over the intervals that orders rest. An interval is cut at buckets of ticks;
  inside its first and last bucket, and over the whole buckets between them, it is a few dyadic nodes, of which only the
  extreme is kept. A tick asks the nodes above it.
* Depth up to a price is a sum over two dimensions, time and price. The changes before a tick are the levels that rest
  when its bucket starts, and dyadic nodes inside the bucket; in each of them a running sum over prices answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.functions.exprs import safe_div
from pitwarden.operators.lineage import cut

BAND = 0.002  # of the mid price, on either side
BUCKET_BITS = 9  # ticks of a bucket: 512
GONE = ("filled", "cancelled", "expired")


def resting_orders(orders: DataFrame) -> DataFrame:
    """(commodity, order_id, trader_id, side, price, quantity, start, finish, filled): one row per placed order.

    The order rests from ``start`` on, up to the tick before ``finish`` (null: to the end).
    """
    placed, gone = F.col("event_type") == "placed", F.col("event_type").isin(*GONE)
    first = F.min(F.when(placed, F.struct("tick", "side", "price", "quantity", "trader_id"))).alias("p")
    return (
        orders.groupBy("commodity", "order_id")
        .agg(first, F.min(F.when(gone, F.col("tick"))).alias("finish"), F.sum(F.when(F.col("event_type") == "partial_fill", F.col("quantity"))).alias("filled"))
        .filter("p IS NOT NULL")
        .select("commodity", "order_id", "p.trader_id", "p.side", "p.price", "p.quantity", F.col("p.tick").alias("start"), "finish", F.coalesce("filled", F.lit(0)).alias("filled"))
    )


def book_changes(orders: DataFrame) -> DataFrame:
    """(commodity, side, price, tick, change): signed quantity by level and tick; an order that ends takes its rest away."""
    rest = resting_orders(orders)
    ends = F.array(
        F.struct(F.col("start").alias("tick"), F.col("quantity").alias("change")),
        F.struct(F.col("finish").alias("tick"), (F.col("filled") - F.col("quantity")).alias("change")),
    )
    own = rest.select("commodity", "side", "price", F.explode(ends).alias("e")).select("commodity", "side", "price", "e.tick", "e.change").filter("tick IS NOT NULL")
    part = orders.filter("event_type = 'partial_fill'").select("commodity", "order_id", "tick", (-F.col("quantity")).alias("change"))
    part = part.join(rest.select("commodity", "order_id", "side", "price"), ["commodity", "order_id"]).select(own.columns)
    return own.unionByName(part).groupBy("commodity", "side", "price", "tick").agg(F.sum("change").alias("change"))


def _nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Dyadic nodes (level, node) that make up [lo, hi); at most two a level."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = F.ceil(lo / size).cast("long"), F.floor(hi / size).cast("long")
        pick = lambda ok, n: F.when((a < b) & ok, F.struct(k.alias("level"), n.alias("node")))
        return F.array(pick(a % 2 == 1, a), pick(b % 2 == 1, b - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def _above(place: Column, levels: int) -> Column:
    """The nodes (level, node) that hold ``place``."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place, k).alias("node")))


def _before(place: Column, levels: int) -> Column:
    """The nodes (level, node) that make up [0, place): one for every set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.call_function("shiftright", place, k) % 2 == 1)
    return F.transform(bits, lambda k: F.struct(k.alias("level"), (F.call_function("shiftright", place, k) - 1).alias("node")))


def live_extreme(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, finish: str, value: str, largest: bool, bits: int = BUCKET_BITS) -> DataFrame:
    """(keys, at, extreme): the largest (or smallest) ``value`` of the intervals start <= at < finish, for distinct points.

    A missing ``finish`` is after all points. Points without a live interval are missing from the result.
    """
    asked = points.select(*keys, F.col(at).cast("long").alias("at")).distinct()
    low, high = asked.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return asked.join(intervals.select(*keys, F.col(value).alias("extreme")).limit(0), keys)
    size, top = 1 << bits, ((high - low) >> bits).bit_length()
    best = F.max if largest else F.min
    a = F.greatest(F.col(start), F.lit(low)) - low
    b = F.least(F.coalesce(F.col(finish), F.lit(high + 1)), F.lit(high + 1)) - low
    held = intervals.select(*keys, F.col(value).alias("v"), a.cast("long").alias("a"), b.cast("long").alias("b")).filter("a < b")
    held = held.withColumns({"first": F.call_function("shiftright", "a", F.lit(bits)), "last": F.call_function("shiftright", F.col("b") - 1, F.lit(bits))})
    one = F.col("first") == F.col("last")
    pieces = F.filter(F.array(
        F.struct(F.col("first").alias("bucket"), (F.col("a") % size).alias("l"), F.when(one, (F.col("b") - 1) % size + 1).otherwise(size).alias("r")),
        F.when(~one, F.struct(F.col("last").alias("bucket"), F.lit(0).cast("long").alias("l"), ((F.col("b") - 1) % size + 1).alias("r"))),
    ), lambda x: x.isNotNull())
    inner = held.select(*keys, "v", F.explode(pieces).alias("x")).select(*keys, "v", "x.bucket", F.explode(_nodes(F.col("x.l"), F.col("x.r"), bits)).alias("n"))
    inner = inner.groupBy(*keys, "bucket", "n").agg(best("v").alias("v"))
    outer = held.filter("last - first > 1").select(*keys, "v", F.explode(_nodes(F.col("first") + 1, F.col("last"), top)).alias("n")).groupBy(*keys, "n").agg(best("v").alias("v"))
    bucket = F.call_function("shiftright", F.col("at") - low, F.lit(bits))
    placed = asked.withColumn("bucket", bucket)
    near = placed.select(*keys, "at", "bucket", F.explode(_above((F.col("at") - low) % size, bits)).alias("n")).join(inner, [*keys, "bucket", "n"])
    near = near.groupBy(*keys, "at", "bucket").agg(best("v").alias("near"))
    far = placed.select(*keys, "bucket").distinct().select(*keys, "bucket", F.explode(_above(F.col("bucket"), top)).alias("n")).join(outer, [*keys, "n"])
    far = far.groupBy(*keys, "bucket").agg(best("v").alias("far"))
    both = F.greatest("near", "far") if largest else F.least("near", "far")
    return placed.join(near, [*keys, "at", "bucket"], "left").join(far, [*keys, "bucket"], "left").select(*keys, "at", both.alias("extreme")).filter("extreme IS NOT NULL")


def sums_before(queries: DataFrame, changes: DataFrame, keys: list[str], at: str, place: str, value: str, out: str, bits: int = BUCKET_BITS) -> DataFrame:
    """``queries`` with ``out``: the sum of ``value`` over the changes before ``at`` whose ``place`` is not above theirs.

    A running sum holds one bucket of one key, whose rows are the places that count when it starts and its own changes.
    """
    asked = queries.select(*keys, F.col(at).cast("long").alias("at"), F.col(place).alias("place")).filter("place IS NOT NULL").distinct()
    low, high = changes.agg(F.min(at), F.max(at)).first()
    if low is None:
        return queries.withColumn(out, F.lit(0).cast("long"))
    tick = F.least(F.greatest(F.col("at") - low, F.lit(0)), F.lit(high - low + 1)).cast("long")  # after all changes: alike
    size = 1 << bits
    asked = cut(asked.withColumns({"bucket": F.call_function("shiftright", tick, F.lit(bits)), "y": tick % size}))
    base = changes.groupBy(*keys, (F.col(at) - low).cast("long").alias("at"), F.col(place).alias("place")).agg(F.sum(value).alias("v"))
    base = cut(base.withColumns({"bucket": F.call_function("shiftright", "at", F.lit(bits)), "y": F.col("at") % size}))
    # What rests when a bucket starts: a level's total lasts until the bucket after its next change.
    per_level = Window.partitionBy(*keys, "place").orderBy("bucket")
    level = base.groupBy(*keys, "place", "bucket").agg(F.sum("v").alias("v"))
    level = level.select(*keys, "place", "bucket", F.sum("v").over(per_level).alias("v"), F.lead("bucket").over(per_level).alias("until"))
    lasts = F.sequence(F.col("bucket") + 1, F.coalesce("until", F.lit((high - low + 1) >> bits)))
    level = level.filter((F.col("v") != 0) & (F.coalesce("until", F.lit((high - low + 1) >> bits)) > F.col("bucket")))
    start = F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node"))
    rows = level.select(*keys, "place", "v", F.explode(lasts).alias("bucket")).withColumn("n", start)
    rows = rows.join(asked.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")
    inside = base.select(*keys, "place", "v", "bucket", F.explode(_above(F.col("y"), bits - 1)).alias("n")).groupBy(*keys, "place", "bucket", "n").agg(F.sum("v").alias("v"))
    wanted = asked.select(*keys, "at", "place", "bucket", F.explode(F.concat(F.array(start), _before(F.col("y"), bits - 1))).alias("n"))
    merged = rows.unionByName(inside).withColumns({"at": F.lit(None).cast("long"), "q": F.lit(0)}).unionByName(wanted.withColumns({"v": F.lit(None).cast("long"), "q": F.lit(1)}))
    running = Window.partitionBy(*keys, "bucket", "n").orderBy("place", "q").rowsBetween(Window.unboundedPreceding, 0)
    got = merged.withColumn("s", F.sum("v").over(running)).filter("q = 1").groupBy(*keys, "at", "place").agg(F.coalesce(F.sum("s"), F.lit(0)).alias(out))
    got = got.withColumnsRenamed({"at": "_at", "place": "_place"})
    joined = queries.withColumns({"_at": F.col(at).cast("long"), "_place": F.col(place)}).join(got, [*keys, "_at", "_place"], "left")
    return joined.drop("_at", "_place").withColumn(out, F.coalesce(out, F.lit(0)))


def best_prices(points: DataFrame, resting: DataFrame, at: str = "tick") -> DataFrame:
    """(commodity, at, bid, ask) when the events of tick ``at`` are done; a side without orders is missing."""
    bid = live_extreme(points, resting.filter("side = 'buy'"), ["commodity"], at, "start", "finish", "price", True)
    ask = live_extreme(points, resting.filter("side = 'sell'"), ["commodity"], at, "start", "finish", "price", False)
    asked = points.select("commodity", F.col(at).cast("long").alias("at")).distinct()
    return asked.join(bid.withColumnRenamed("extreme", "bid"), ["commodity", "at"], "left").join(ask.withColumnRenamed("extreme", "ask"), ["commodity", "at"], "left")


def near_touch_depth(orders: DataFrame, tags: tuple[str, ...] = ("s", "l"), band: float = BAND) -> DataFrame:
    """Bait orders placed by an account in one tick and side, and their share of the depth near the touch.

    The book is the one before the tick: ``existing`` is what rests on the side within ``band`` of the mid price,
    ``placed`` what the bait adds there. Without a mid price the share is 0.
    """
    baits = orders.filter((F.col("event_type") == "placed") & F.substring("order_id", -1, 1).isin(*tags)).withColumn("before", F.col("tick") - 1)
    baits = cut(baits.select("commodity", "trader_id", "side", "tick", "before", "price", "quantity"))
    resting = cut(resting_orders(orders))
    best = best_prices(baits, resting, "before").select("commodity", (F.col("at") + 1).alias("tick"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    near = F.abs(F.col("price") - F.col("mid")) / F.col("mid") <= band
    batch = (
        baits.join(best, ["commodity", "tick"], "left").groupBy("commodity", "trader_id", "side", "tick", "mid")
        .agg(F.count(F.lit(1)).alias("legs"), F.coalesce(F.sum(F.when(near, F.col("quantity"))), F.lit(0)).alias("placed"))
    )
    # Places grow away from the touch: falling prices of bids, rising ones of asks.
    buy = F.col("side") == "buy"
    batch = cut(batch.withColumn("edge", F.when(buy, -F.col("mid") * (1 - band)).otherwise(F.col("mid") * (1 + band))))
    changes = book_changes(orders).withColumn("edge", F.when(buy, -F.col("price")).otherwise(F.col("price")))
    out = sums_before(batch, changes, ["commodity", "side"], "tick", "edge", "change", "existing")
    share = F.when(F.col("mid") > 0, safe_div(F.col("placed").cast("double"), F.col("existing") + F.col("placed"))).otherwise(0.0)
    return out.select("commodity", "trader_id", "side", "tick", "mid", "legs", "placed", "existing", share.alias("share"))


def inverted_book(orders: DataFrame) -> DataFrame:
    """Per market: ticks with events, those with both sides, and those where the best bid is not below the best ask."""
    best = best_prices(orders, cut(resting_orders(orders)))
    crossed = F.col("bid") >= F.col("ask")
    return best.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.count_if(F.col("bid").isNotNull() & F.col("ask").isNotNull()).alias("n_two_sided"), F.count_if(crossed).alias("n_inverted"),
        F.min(F.when(crossed, F.col("at"))).alias("first_inverted"), F.max(F.when(crossed, F.col("bid") - F.col("ask"))).alias("deepest"),
    )
