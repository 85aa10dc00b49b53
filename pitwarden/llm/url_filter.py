"""URL filter: allow and block rules first, then a logistic regression on hashed character n-grams.

Host and path are cut from the url by SQL expressions; the longest rule that fits decides. Urls that no rule fits get the
verdict of a logistic regression on the hashed 3- to 5-grams of host and path, trained on a small labelled table.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
model's intercept; repeated rows each get their own result; an empty table gives an empty result; a column named like a
result column gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.llm.common import add_columns

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class NgramModel:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 16
    epochs: int = 200
    ridge: float = 1e-3
    max_rows: int = 20_000  # labelled urls that are fitted at most
    block_from: float = 0.5


# A small labelled table of invented urls (host, path, 1 for unwanted).
_UNWANTED = ("cheap-pills", "casino-win", "free-bets", "online-casino", "poker-bonus", "buy-meds", "xxx-videos", "adult-cams", "payday-loans", "free-download-crack", "hot-singles", "bet-slots")
_WANTED = ("library", "university", "docs.python", "news.daily", "recipes", "history-museum", "weather", "travel-notes", "science.review", "gardening", "city-council", "open-maps", "parish-choir", "bird-watching", "school-board", "railway-timetable")
_PATHS = ("/", "/index.html", "/about/contact", "/item/4711", "/archive/2021/05/", "/list.php")
_SUFFIXES = ("com", "org", "net", "info", "co.uk")
_PREFIXES = ("", "www.", "blog.", "m.")
LABELLED = tuple(
    (f"https://{_PREFIXES[(i + j) % 4]}{name}.{_SUFFIXES[(i + j) % 5]}{path}", label)
    for names, label in ((_UNWANTED, 1), (_WANTED, 0)) for i, name in enumerate(names) for j, path in enumerate(_PATHS)
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...], value: str = "name") -> Column:
    """The longest fitting rule's name or verdict; null if none fits. Ties go to the earlier rule."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def ngram_slots(hosts: list[str], paths: list[str], model: NgramModel) -> tuple[np.ndarray, np.ndarray]:
    """(slots, rows): hashed n-grams of ``^host|path$`` of every row, computed over all rows at once."""
    raw = [f"^{h}|{p}$".encode() for h, p in zip(hosts, paths, strict=True)]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(data))  # bytes to the row's end
    slots, rows = [], []
    with np.errstate(over="ignore"):
        for n in model.sizes:
            h = np.full(max(0, len(data) - n + 1), n, np.uint64)
            for j in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ data[j : len(h) + j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            inside = left[: len(h)] >= n
            slots.append((h[inside] >> np.uint64(64 - model.bits)).astype(np.int64))
            rows.append(row[: len(h)][inside])
    return np.concatenate(slots), np.concatenate(rows)


def margins(slots: np.ndarray, rows: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Linear scores; a row's n-grams share unit length."""
    count = np.bincount(rows, minlength=n)
    return np.bincount(rows, weights[slots], n) / np.sqrt(np.maximum(count, 1)) + weights[-1]


def fit(labelled: DataFrame, model: NgramModel = NgramModel()) -> np.ndarray:
    """Weights (the last is the intercept) from rows (url, label), at most ``max_rows`` by hash of the url."""
    parts = labelled.filter("url IS NOT NULL AND label IS NOT NULL").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("h"), "url",
    ).orderBy("h", "url", "label").limit(model.max_rows).collect()
    weights = np.zeros((1 << model.bits) + 1)
    if not parts:
        return weights
    n = len(parts)
    slots, rows = ngram_slots([r.host for r in parts], [r.path for r in parts], model)
    y = np.array([r.label for r in parts])
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    square = np.full_like(weights, 1e-8)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(model.epochs):
        miss = (1 / (1 + np.exp(-margins(slots, rows, n, weights))) - y) * balance / n
        grad = np.append(np.bincount(slots, (miss * scale)[rows], 1 << model.bits), miss.sum()) + model.ridge * np.append(weights[:-1], 0) / n
        square += grad * grad
        weights -= 0.5 * grad / np.sqrt(square)
    return weights


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...], weights: np.ndarray, model: NgramModel = NgramModel(), url: str = "url") -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, verdict and the model's score (high: unwanted)."""
    taken = {"host", "path", "rule", "verdict", "score"}
    given = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in taken], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers

    def run(hosts, paths):
        slots, rows = ngram_slots(hosts, paths, model)
        return {"score": 1 / (1 + np.exp(-margins(slots, rows, len(hosts), shared.value)))}

    scored = add_columns(given, ("host", "path"), "score double", run)
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_for(host, path, rules, "verdict"), F.when(F.col("score") >= model.block_from, "block").otherwise("allow"))
    return scored.withColumns({"rule": rule_for(host, path, rules), "verdict": verdict})
