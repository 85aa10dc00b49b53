"""Temperature mixing: source shares raised to an exponent, realised as budgeted block permutations.

The token share of a source, raised to an exponent between 0 and 1 and normalised, is its weight: 1 keeps the corpus as
it is, 0 gives every source the same. The exponent is found by repeated section so that the entropy of the weights
reaches a target, by default half way from the entropy of the corpus to the greatest one, so that it binds wherever the
sources differ; a repetition limit may ask for a larger exponent. Budgets (weight times total tokens) are whole tokens:
all are rounded down and what is missing to the total goes, a token each, to the largest remainders. A budget is spent
in epochs. Each epoch goes through the source's blocks in an order of its own; the last one stops at the block, and in
it at the document, where the budget ends.

Only DataFrame expressions are used. The tables that decide are small: one row per (source, block) and per source; the
blocks of a source are a fixed number, so a hot source is spread over them and only its last block is ever put in order.

Defined results: a null source is the source ''; a null text has no tokens; sources without any tokens are passed once;
rows with equal ids are taken or left together; an empty table gives an empty result; a column named like a result
column gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRule:
    lift: float = 0.5  # target entropy: so far from the corpus's own (0) to the greatest, all sources alike (1)
    entropy: float | None = None  # or a target as a share of the greatest entropy
    max_epochs: float = 4.0  # no source is repeated more often, on average over its tokens
    budget: float = 1.0  # tokens of the mixture as a multiple of the input's
    blocks: int = 256  # per source
    seed: int = 17
    sections: int = 16  # of the bracket in one pass
    passes: int = 6


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    """60 bits of the md5 of the parts, a missing one left out."""
    joined = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def block_of(doc_id: Column, rule: MixRule) -> Column:
    return F.pmod(_hash(rule.seed, "block", doc_id), F.lit(rule.blocks)).cast("int")


def block_tokens(docs: DataFrame, rule: MixRule) -> DataFrame:
    """(src, block, tokens, docs): pre-aggregated before its shuffle."""
    return docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), block_of(F.col("doc_id"), rule).alias("block"), tokens_of(F.col("text")).alias("t"),
    ).groupBy("src", "block").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def find_exponent(shares: DataFrame, rule: MixRule) -> float:
    """The largest exponent whose weights reach the target entropy, or the least that keeps the repetition limit if that
    is larger. ``shares``: one row per source with ``p`` > 0. Each pass cuts the bracket into sections with one aggregate.
    """
    n = shares.count()
    if n < 2:
        return 1.0
    def measure(points: list[float]) -> list[tuple[float, float]]:
        p = F.col("p")
        sums = [c for i, a in enumerate(points) for c in (
            F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.ln(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{i}"))]
        row = shares.agg(*sums).head()
        return [(math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], rule.budget * row[f"m{i}"] / row[f"z{i}"]) for i, a in enumerate(points)]

    # Entropy falls and repetition falls as the exponent rises, so each condition has one boundary.
    bounds = {"entropy": (0.0, 1.0), "epochs": (0.0, 1.0)}
    (_, low_r), (high_h, high_r) = measure([0.0, 1.0])
    target = rule.entropy * math.log(n) if rule.entropy is not None else high_h + rule.lift * (math.log(n) - high_h)
    if high_h >= target:
        bounds["entropy"] = (1.0, 1.0)
    if low_r <= rule.max_epochs:
        bounds["epochs"] = (0.0, 0.0)
    elif high_r > rule.max_epochs:
        bounds["epochs"] = (1.0, 1.0)
    for _ in range(rule.passes):
        points, at = [], {}
        for name, (lo, hi) in bounds.items():
            at[name] = range(len(points), len(points) + (rule.sections - 1 if hi > lo else 0))
            points += [lo + (hi - lo) * i / rule.sections for i in range(1, rule.sections)] if hi > lo else []
        if not points:
            break
        found = measure(points)
        for name, span in at.items():
            lo, hi = bounds[name]
            for i in span:
                enough = found[i][0] >= target if name == "entropy" else found[i][1] > rule.max_epochs
                if enough:
                    lo = points[i]
                else:
                    hi = points[i]
                    break
            bounds[name] = (lo, hi)
    return max(bounds["entropy"][0], bounds["epochs"][1])


def source_plan(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """One row per source: tokens, weight, whole epochs, and where the last, partial epoch ends.

    ``last_rank``: order of the block in which it ends; ``last_order``: order of the last document taken from that block
    (null: none).
    """
    blocks = stage(block_tokens(docs, rule), "blocks")
    sources = stage(blocks.groupBy("src").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).head()[0] or 0
    shares = sources.filter("tokens > 0").select("src", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    alpha = find_exponent(shares, rule)
    norm = shares.agg(F.sum(F.pow("p", F.lit(alpha)))).head()[0] or 1.0
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(alpha)) / F.lit(norm)).otherwise(F.lit(0.0))
    exact = sources.withColumns({"exponent": F.lit(alpha), "weight": weight}).withColumn("exact", F.col("weight") * F.lit(rule.budget * total))
    floors = stage(exact.withColumn("floor", F.floor("exact").cast("long")), "floors")
    missing = max(0, math.floor(rule.budget * total + 0.5) - (floors.agg(F.sum("floor")).head()[0] or 0))
    lifted = floors.filter("tokens > 0").orderBy((F.col("exact") - F.col("floor")).desc(), "src").limit(missing).select("src", F.lit(1).alias("one"))
    planned = floors.join(lifted, "src", "left").withColumn("budget", F.col("floor") + F.coalesce("one", F.lit(0))).drop("exact", "floor", "one").withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"),
        "rest": F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0),
    })
    # Blocks in the order of the partial epoch; at most ``blocks`` rows per source are put in order.
    rank = _hash(rule.seed, "epoch", F.col("epochs"), F.col("src"), F.col("block"))
    ordered = blocks.select("src", "block", F.col("tokens").alias("t")).join(planned, "src").withColumn("rank", rank)
    upto = F.sum("t").over(Window.partitionBy("src").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, 0))
    last = (
        ordered.withColumn("upto", upto).filter("upto > rest")
        .groupBy("src").agg(F.min(F.struct("upto", "rank", "block", "t")).alias("x"))
        .select("src", F.col("x.rank").alias("last_rank"), F.col("x.block").alias("last_block"), (F.col("x.upto") - F.col("x.t")).alias("before"))
    )
    cut = stage(planned.join(last, "src", "left"), "cuts")
    inside = (
        docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), F.col("doc_id"), "text", block_of(F.col("doc_id"), rule).alias("block"))
        .join(cut.select("src", F.col("last_block").alias("block"), "epochs", "rest", "before"), ["src", "block"])
        .groupBy("src", _hash(rule.seed, "document", F.col("epochs"), F.col("doc_id")).alias("order"), F.col("rest"), F.col("before")).agg(F.sum(tokens_of(F.col("text"))).alias("t"))
    )
    run = F.sum("t").over(Window.partitionBy("src").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    ends = inside.withColumn("run", run).filter("before + run <= rest").groupBy("src").agg(F.max("order").alias("last_order"))
    return stage(cut.join(ends, "src", "left"), "plan")


RESULT = ("n_tokens", "epoch", "block", "block_rank", "document_rank", "weight")


def mix(docs: DataFrame, rule: MixRule = MixRule(), plan: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` as often as their source's budget takes them, with all columns and where each copy stands.

    Sorting a source's rows by (epoch, block_rank, document_rank) gives its permutation.
    """
    plan = source_plan(docs, rule) if plan is None else plan
    own = [c for c in docs.columns if c.lower() not in RESULT]
    decide = plan.select(
        F.col("src").alias("__src"), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("last_rank").alias("__rank"),
        F.col("last_block").alias("__block"), F.col("last_order").alias("__order"), F.col("weight").alias("weight"),
    )
    given = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__src")).withColumn("block", block_of(F.col("doc_id"), rule))
    joined = given.join(decide, "__src")
    rank = lambda epoch: _hash(rule.seed, "epoch", epoch, F.col("__src"), F.col("block"))
    order = lambda epoch: _hash(rule.seed, "document", epoch, F.col("doc_id"))
    partial = rank(F.col("__epochs"))
    before = (partial < F.col("__rank")) | ((partial == F.col("__rank")) & (F.col("block") < F.col("__block")))
    within = (F.col("block") == F.col("__block")) & F.coalesce(order(F.col("__epochs")) <= F.col("__order"), F.lit(False))
    extra = (F.col("__rest") > 0) & (before | within)
    copies = F.col("__epochs") + F.when(extra, 1).otherwise(0)
    taken = joined.withColumn("n_tokens", tokens_of(F.col("text"))).withColumn("__copies", copies).filter("__copies > 0")
    out = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return out.select(*[F.col(f"`{c}`") for c in own], "n_tokens", "epoch", "block", rank(F.col("epoch")).alias("block_rank"), order(F.col("epoch")).alias("document_rank"), "weight")
