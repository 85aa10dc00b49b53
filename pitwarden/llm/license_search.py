"""License scan: exact base phrases by word, and a fuzzy search for short notices.

Base phrases stand in the text as consecutive words (lower-cased, split at ASCII signs). The fuzzy search looks for
longer notices with up to ``errors`` edits: a notice is cut into ``errors + 1`` pieces, of which one must stand unedited
(pigeonhole), so the exact finds of all pieces give the candidate places; there the bounded-error matching of the
``regex`` library verifies the notice and reports its span.

Defined results: a null or empty text has no words and no labels and score 0; repeated rows each get their own result;
an empty table gives an empty result; a column named like a result column gives way to it.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from pitwarden.llm.common import add_columns

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DIGITS = re.compile(r"[0-9]+")

# Base phrases with their labels, and notices with theirs.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license version 2", "mpl-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
)


@dataclass(frozen=True)
class NoticeRule:
    """``letters_per_error``: one edit is allowed for so many letters of a notice, up to ``max_errors``."""

    notices: tuple[tuple[str, str], ...] = NOTICES
    base: tuple[tuple[str, str], ...] = BASE
    letters_per_error: int = 12
    max_errors: int = 3

    def errors(self, notice: str) -> int:
        # Short codes differ from each other by a letter, so notices with one allow none.
        short_code = re.search(r"\bby (nc|sa)\b", notice)
        return 0 if short_code else min(self.max_errors, len(notice) // self.letters_per_error)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors + 1`` pieces of nearly equal length."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=16)
def _compiled(rule: NoticeRule):
    seeds: dict[str, list[tuple[int, int]]] = {}
    matchers = []
    for i, (notice, _) in enumerate(rule.notices):
        e = rule.errors(notice)
        matchers.append((regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={e}}}"), e, len(notice)))
        for at, piece in pieces(notice, e):
            seeds.setdefault(piece, []).append((i, at))
    return seeds, matchers


def find_notices(text: str, rule: NoticeRule) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) of the verified places in ``text`` (words joined by single spaces)."""
    seeds, matchers = _compiled(rule)
    windows: dict[int, list[tuple[int, int]]] = {}
    for seed, uses in seeds.items():
        at = text.find(seed)
        while at >= 0:
            for i, offset in uses:
                _, e, n = matchers[i]
                windows.setdefault(i, []).append((max(0, at - offset - e), at - offset + n + e))
            at = text.find(seed, at + 1)
    found = []
    for i, spans in windows.items():
        matcher = matchers[i][0]
        places = set()
        # Each place in its own window: in a joined one the best match hides an edited notice before it.
        for lo, hi in set(spans):
            for m in matcher.finditer(text, lo, hi):
                # A changed number names another version, which no count of edits excuses.
                if m.end() > m.start() and DIGITS.findall(m[0]) == DIGITS.findall(rule.notices[i][0]):
                    places.add((sum(m.fuzzy_counts), m.start(), m.end()))
        # Windows that see one place with different ends: the match with the fewest edits stays.
        taken: list[tuple[int, int]] = []
        for e, a, b in sorted(places):
            at = bisect.bisect_left(taken, (b,))
            if not at or taken[at - 1][1] <= a:
                bisect.insort(taken, (a, b))
                found.append((i, a, b, e))
    return sorted(found)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,errors:int>>"


def scan(text: str | None, rule: NoticeRule) -> tuple:
    words = WORD.findall((text or "").encode().lower().decode())  # bytes.lower() changes A-Z only
    joined = " ".join(words)
    padded = f" {joined} "
    gaps = [end - 1 for end in accumulate(len(w) + 1 for w in words)]  # places of the spaces in ``joined``, and its end

    def before(at: int) -> int:
        """Words that end before a place."""
        return bisect.bisect_left(gaps, at)

    starts, labels = [], set()
    for phrase, label in rule.base:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append(before(at - 1) + 1 if at else 0)
            labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    found = find_notices(joined, rule)
    spans = [{"label": rule.notices[i][1], "start": before(a), "end": before(max(a, b - 1)) + 1, "errors": e} for i, a, b, e in found]
    best = max([1.0 if labels else 0.0, *(1.0 - e / len(rule.notices[i][0]) for i, _, _, e in found)])
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {s["label"] for s in spans})), best, spans,
    )


def license_notices(docs: DataFrame, rule: NoticeRule = NoticeRule(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with base counts, labels, a score and the spans (in words) of fuzzy finds."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(texts):
        return dict(zip(names, zip(*[scan(t, rule) for t in texts], strict=True), strict=True))

    return add_columns(docs, (text,), RESULT, run)
