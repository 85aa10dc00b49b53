"""Quality rule: a linear-chain conditional random field marks each line as content or boilerplate.

Lines are the pieces of a text between ``\\n``. A trained field scores each line (symbols, capitals, bars, repeated
words, ...) and each step from line to line; Viterbi decoding gives the best labelling of the whole text, and the share
of words in content lines decides whether the text stays.

The field is trained from document labels, as there are none for lines: lines of good texts are content; lines of bad
texts start as boilerplate and are decoded anew between the rounds, so that sound lines in bad texts change sides.

Defined results: a null or empty text has no words and fails the base rules; repeated rows each get their own result; an
empty table gives an empty result; a column that is named like a result column gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pitwarden.llm.common import add_columns, by_batch

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?#*$%&|<>[]{}=_~^+/\\"
CONTENT, BOILERPLATE = 0, 1
N_FEATURES = 13
WINDOW = 8

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long"


@dataclass(frozen=True)
class LineField:
    """Weights of the field: (state, feature), (state, next state) and first state."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class LabelRule:
    """Settings of training and verdict."""

    max_documents: int = 600  # labelled documents in the training sample
    rounds: int = 3
    epochs: int = 50
    content_share: float = 0.5  # least share of words in content lines
    seed: int = 11


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    s = np.sort(acc)
    if not (s[1:] == s[:-1]).any():
        return 0
    # Equal hashes are settled on exact word numbers, doubled from one word to eight.
    ids: dict[bytes, int] = {}
    number = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    span = 1
    while span < WINDOW:
        pair = number[:-span] * (int(number.max()) + 1) + number[span:]
        number = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    twice = np.bincount(number)[number] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_features(line: bytes, repeated: bool) -> list[float]:
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return [1.0, 1.0] + [0.0] * (N_FEATURES - 2)
    packed = n - line.count(b" ")
    marks = packed - len(line.translate(None, MARKS + b" "))
    upper = len(line) - len(line.translate(None, UPPER))
    digits = len(line) - len(line.translate(None, DIGITS))
    ends = sum(w[-1] in MARKS for w in words)
    distinct = len(set(words))
    stays = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        1.0, 0.0, min(1.0, 8.0 * marks / packed), float(marks > 2), min(1.0, 2.0 * upper / packed), min(1.0, 2.0 * digits / packed),
        ends / k, stays / k, 1.0 - distinct / k if k > 3 else 0.0, float(k < 4), min(1.0, math.log1p(k) / 5.0),
        float(line.rstrip()[-1] in b".!?:"), float(repeated),
    ]


def features_of(text: bytes) -> tuple[np.ndarray, list[int], int]:
    """Features and word count of every line, and how many lines with a word repeat an earlier one."""
    seen: set[bytes] = set()
    rows, counts, again = [], [], 0
    for line in text.split(b"\n"):
        k = len(line.split())
        dup = k > 0 and line in seen
        if k:
            seen.add(line)
        again += dup
        rows.append(line_features(line, dup))
        counts.append(k)
    return np.array(rows, np.float64), counts, again


def viterbi(emission: np.ndarray, step: np.ndarray, first: np.ndarray) -> list[int]:
    """Best state sequence of one text; ties go to content."""
    (s00, s01), (s10, s11) = step.tolist()
    rows = emission.tolist()
    a, b = rows[0][0] + first[0], rows[0][1] + first[1]
    back: list[tuple[int, int]] = []
    for e0, e1 in rows[1:]:
        from0, from1 = a + s00, b + s10
        to_a = 0 if from0 >= from1 else 1
        from0b, from1b = a + s01, b + s11
        to_b = 0 if from0b >= from1b else 1
        back.append((to_a, to_b))
        a, b = (from1 if to_a else from0) + e0, (from1b if to_b else from0b) + e1
    state = CONTENT if a >= b else BOILERPLATE
    path = [state]
    for choice in reversed(back):
        state = choice[state]
        path.append(state)
    return path[::-1]


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-2)
    return top + np.log(np.exp(a - top[..., None, :]).sum(axis=-2))


def _padded(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, states and which lines are there, of texts of like length."""
    shape = (len(texts), max(len(y) for _, y in texts))
    x, y, live = np.zeros((*shape, N_FEATURES)), np.zeros(shape, np.int64), np.zeros(shape, bool)
    for i, (f, s) in enumerate(texts):
        x[i, : len(s)], y[i, : len(s)], live[i, : len(s)] = f, s, True
    return x, y, live


def _gradient(x, y, live, emit, step, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the texts of what was seen less what the field expects."""
    n, long = y.shape
    rows = np.arange(n)
    last = live.sum(1) - 1
    both = live[:, 1:]
    pair_seen = np.zeros((2, 2))
    np.add.at(pair_seen, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    hot = np.eye(2)[y] * live[..., None]
    e = x @ emit.T
    fwd = np.zeros((n, long, 2))
    fwd[:, 0] = e[:, 0] + first
    for t in range(1, long):
        fwd[:, t] = _log_sum(fwd[:, t - 1, :, None] + step) + e[:, t]
    bwd = np.zeros((n, long, 2))
    for t in range(long - 2, -1, -1):
        nxt = _log_sum(np.swapaxes(step[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 1, 2))
        bwd[:, t] = np.where(live[:, t + 1, None], nxt, 0.0)
    total = np.logaddexp(*fwd[rows, last].T)
    # Places after a text's end have no meaning and are left out before the exponential, where they could overflow.
    gamma = np.exp(np.where(live[..., None], fwd + bwd - total[:, None, None], -np.inf))
    pairs = fwd[:, :-1, :, None] + step + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]
    xi = np.exp(np.where(both[..., None, None], pairs, -np.inf))
    return np.einsum("nts,ntf->sf", hot - gamma, x), pair_seen - xi.sum((0, 1)), (hot[:, 0] - gamma[:, 0]).sum(0)


def fit_field(texts: list[tuple[np.ndarray, np.ndarray]], rule: LabelRule, chained: bool = True) -> LineField:
    """Maximum likelihood by forward-backward sums, over texts given as (features, states).

    Texts are padded to the next power of two of their lines, so a long one does not widen the others.
    Without ``chained`` the step and first-state scores stay zero: every line is for itself.
    """
    emit, step, first = np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.zeros(2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, step, first)]
    buckets: dict[int, list] = {}
    for f, s in texts:
        buckets.setdefault((len(s) - 1).bit_length(), []).append((f, s))
    padded = [_padded(b) for b in buckets.values()]
    size, n = sum(len(s) for _, s in texts), len(texts)
    for epoch in range(1, rule.epochs + 1):
        sums = [np.sum(g, axis=0) for g in zip(*(_gradient(*p, emit, step, first) for p in padded), strict=True)]
        grads = (sums[0] / size - 0.002 * emit, sums[1] / size - 0.002 * step, sums[2] / n - 0.01 * first)
        for p, g, (m, v) in list(zip((emit, step, first), grads, moments, strict=True))[: 3 if chained else 1]:
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return LineField(emit, step, first)


def train(docs: DataFrame, labels: DataFrame, rule: LabelRule = LabelRule()) -> LineField:
    """Fit the field on at most ``max_documents`` labelled texts, half of each quality, drawn by hash of the id.

    Without texts of both kinds the field is flat and calls every line content.
    """
    half = max(1, rule.max_documents // 2)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = [known.filter(F.col("quality") == q).orderBy(F.xxhash64(F.lit(rule.seed), "doc_id"), "doc_id").limit(half) for q in (0, 1)]
    # Bounded by max_documents, so it may be broadcast; the texts are read where they are.
    sample = drawn[0].unionByName(drawn[1])
    found = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "quality", "text")

    def run(batches):
        # Only numbers of whole texts reach the driver.
        for batch in batches:
            ids, qualities, texts = (batch.column(i).to_pylist() for i in range(3))
            lines = []
            for t in texts:
                x, counts, _ = features_of(t.encode())
                lines.append(x[np.array(counts) > 0].ravel())
            yield {"id": ids, "quality": qualities, "lines": lines}

    table = by_batch(found, "id string, quality int, lines array<double>", run).toArrow()
    data = []
    for _, q, flat in sorted(zip(table["id"].to_pylist(), table["quality"].to_pylist(), (np.asarray(v.values) for v in table["lines"]), strict=True), key=lambda r: (r[0], r[2].tobytes())):
        if len(flat):
            x = flat.reshape(-1, N_FEATURES)
            data.append((x, np.full(len(x), BOILERPLATE if q == 0 else CONTENT), q))
    if len({q for *_, q in data}) < 2:
        return LineField(np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.array([1.0, 0.0]))
    data.sort(key=lambda d: len(d[1]))
    field = None
    for turn in range(rule.rounds):
        # At first a bad text is bad in all its lines, from which no steps between states can be learnt.
        field = fit_field([(x, y) for x, y, _ in data], rule, chained=turn > 0)
        again = []
        for x, y, q in data:
            if q == 0:
                scores = x @ field.emit.T
                y = np.array(viterbi(scores, field.step, field.first))
                if not y.any():  # a bad text has at least one bad line
                    y[int(np.argmax(scores[:, 1] - scores[:, 0]))] = BOILERPLATE
            again.append((x, y, q))
        data = again
    return field


def judge(text: str | None, field: LineField, rule: LabelRule) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    x, counts, again = features_of(raw)
    repeats = repeated_words(words)
    states = viterbi(x @ field.emit.T, field.step, field.first)
    good = sum(k for k, s in zip(counts, states, strict=True) if s == CONTENT)
    share = good / n if n else 0.0
    failed = n < 20 or 100 * repeats > 30 * n
    return n, chars, symbols, again, repeats, failed, not failed and share >= rule.content_share, share, len(states), sum(states)


def label_lines(text: str | None, field: LineField) -> list[tuple[int, str]]:
    """(state, line) of every line of one text."""
    raw = (text or "").encode()
    x, _, _ = features_of(raw)
    return list(zip(viterbi(x @ field.emit.T, field.step, field.first), (text or "").split("\n"), strict=True))


def line_quality(docs: DataFrame, field: LineField, rule: LabelRule = LabelRule(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the base counts, the content share and the verdict."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(texts):
        return dict(zip(names, zip(*[judge(t, field, rule) for t in texts], strict=True), strict=True))

    return add_columns(docs, (text,), RESULT, run)
