"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Every text becomes a sparse vector: its distinct words hashed into slots, and a few statistics of its shape (lengths,
shares of letters, capitals, digits and marks, repetition, line forms). The machine adds to a linear score the
interactions of all pairs through low-rank factors, in time linear in the non-zero entries by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

It is fitted by Adam on a bounded sample of labelled rows; label, language, source and id are never inputs.

Defined results: a null or empty text is scored from its (zero) statistics; repeated rows each get their own result; an
empty table gives an empty result; without labels of both kinds the score is the share of label 1 (0.5 without any); a
column named like a result column gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import md5
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.llm.common import add_columns, by_batch

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"#$%&*+/<=>@[\\]^_`{|}~!?"
N_STATS = 14


@dataclass(frozen=True)
class FactorRule:
    bits: int = 14  # hashed words go to 2**bits slots
    rank: int = 6
    max_documents: int = 6_000  # labelled documents in the training sample
    epochs: int = 12
    batch: int = 256
    rate: float = 0.02
    ridge: float = 1e-4
    seed: int = 5
    threshold: float = 0.3


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def statistics(raw: bytes, words: list[bytes], n_chars: int) -> list[float]:
    n = max(1, len(raw))
    k = len(words)
    lines = raw.count(b"\n") + 1
    if not k:
        return [1.0] + [0.0] * (N_STATS - 1)
    marked = len(raw) - len(raw.translate(None, MARKS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    distinct = len(set(words))
    stays = sum(map(bytes.__eq__, words, words[1:]))
    return [
        0.0, math.log1p(n_chars) / 12, math.log1p(k) / 10, min(1.0, 5 * marked / n), min(1.0, upper / n * 2), min(1.0, digits / n * 5),
        distinct / k, stays / k, min(1.0, n / k / 20), min(1.0, math.log1p(k / lines) / 6), min(1.0, 10 * raw.count(b"|") / k),
        min(1.0, 10 * raw.count(b"!!") / k), min(1.0, 10 * (raw.count(b"$$") + raw.count(b"**") + raw.count(b"%%") + raw.count(b"&&") + raw.count(b"##")) / k),
        min(1.0, 4 * (raw.count(b".") + raw.count(b",")) / k),
    ]


def vector_of(text: str | None, rule: FactorRule) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text: hashed words of joint unit length, then the statistics."""
    raw = (text or "").encode()
    words = raw.split()
    size = 1 << rule.bits
    slots = np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)) & np.uint32(size - 1)).astype(np.int32)
    stats = np.array(statistics(raw, words, len(text or "")), np.float32)
    values = np.full(len(slots), 1 / math.sqrt(max(1, len(slots))), np.float32)
    return np.concatenate([slots, np.arange(size, size + N_STATS, dtype=np.int32)]), np.concatenate([values, stats])


def margins(machine: Machine, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows laid end to end (each starts at ``starts``), their factor sums, and the scaled factors."""
    scaled = machine.factors[slots] * values[:, None]
    sums = np.add.reduceat(scaled, starts, axis=0)
    squares = np.add.reduceat((scaled * scaled).sum(1), starts)
    linear = np.add.reduceat(machine.linear[slots] * values, starts)
    return machine.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, scaled


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rule: FactorRule) -> Machine:
    size = (1 << rule.bits) + N_STATS
    share = float(labels.mean()) if len(labels) else 0.5
    flat = Machine(math.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.zeros(size, np.float32), np.zeros((size, rule.rank), np.float32))
    if not len(labels) or not 0 < share < 1:
        return flat
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))  # both kinds count the same
    rng = np.random.default_rng(rule.seed)
    params = [np.zeros(1, np.float32), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, rule.rank)).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(rule.epochs):
        order = rng.permutation(len(vectors))
        for lo in range(0, len(order), rule.batch):
            own = order[lo : lo + rule.batch]
            length = np.array([len(vectors[i][0]) for i in own])
            starts = np.cumsum(length) - length
            slots = np.concatenate([vectors[i][0] for i in own])
            values = np.concatenate([vectors[i][1] for i in own])
            z, sums, scaled = margins(Machine(float(params[0][0]), params[1], params[2]), slots, values, starts)
            miss = ((sigmoid(z) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            each = np.repeat(miss, length) * values
            pull = each[:, None] * (np.repeat(sums, length, axis=0) - scaled)
            grads = [
                np.array([miss.sum()], np.float32),
                np.bincount(slots, each, size) + rule.ridge * params[1],
                np.stack([np.bincount(slots, pull[:, f], size) for f in range(rule.rank)], 1) + rule.ridge * params[2],
            ]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rule.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Machine(float(params[0][0]), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of five. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rule: FactorRule = FactorRule()) -> Machine:
    """Fit on at most ``max_documents`` labelled rows outside the held-out fold, the lowest by hash of the id."""
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64(F.lit(rule.seed), "doc_id"), "doc_id").limit(rule.max_documents)
    )
    # Bounded by max_documents, so it may be broadcast; the texts are read where they are.
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def run(batches):
        for batch in batches:
            ids, texts, ys = (batch.column(i).to_pylist() for i in range(3))
            pairs = [vector_of(t, rule) for t in texts]
            digests = [md5((t or "").encode()).hexdigest() for t in texts]  # orders rows of one id
            yield {"doc_id": ids, "digest": digests, "label": ys, "slots": [p[0] for p in pairs], "vals": [p[1] for p in pairs]}

    table = by_batch(drawn, "doc_id long, digest string, label int, slots array<int>, vals array<float>", run).toArrow().sort_by([("doc_id", "ascending"), ("digest", "ascending")])
    rows = list(zip(table["slots"].to_numpy(), table["vals"].to_numpy(), strict=True))
    return fit(rows, table["label"].to_numpy().astype(np.float32), rule)


def score_quality(docs: DataFrame, machine: Machine, rule: FactorRule = FactorRule(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (high: label 1 likelier) and ``predicted``."""
    # Plain arrays, which workers read without this package: 2**bits * (rank + 1) numbers.
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(texts):
        pairs = [vector_of(t, rule) for t in texts]
        length = np.array([len(p[0]) for p in pairs])
        z, _, _ = margins(Machine(*shared.value), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.cumsum(length) - length)
        score = sigmoid(z.astype(np.float64))
        return {"score": score, "predicted": (score >= rule.threshold).astype(np.int32)}

    return add_columns(docs, (text,), "score double, predicted int", run, rows=128)


def reject_poor(docs: DataFrame, machine: Machine, rule: FactorRule = FactorRule(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the machine does not reject, with their own columns only."""
    names = {"score", "predicted"}
    own = [F.col(f"`{c}`").alias(f"own_{c}") if c.lower() in names else F.col(f"`{c}`") for c in docs.columns]
    kept = score_quality(docs.select(*own), machine, rule, text).filter("predicted = 1").drop("score", "predicted")
    return kept.select(*[F.col(f"`own_{c}`").alias(c) if c.lower() in names else F.col(f"`{c}`") for c in docs.columns])
