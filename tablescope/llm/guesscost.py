"""Secrets in texts: fixed patterns, and a guess-cost search of credential values.

The cost of a value is the least log10 number of guesses over all ways to cut
it into words, dates, repeats, keyboard walks and brute-force characters.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no match of their own
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Words that announce a credential.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key"""
    r"""|credentials?|auth(?:orization)?|bearer|login)["']?[\x20\t]*(?:=>|[:=])[\x20\t]*(?:bearer\x20+)?["']?"""
    r"""([^\s"'<>,;]{6,})""", re.I | re.A)
# Rows of the keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
# Common substitutions of letters.
SWAPS = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
DATES = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)")
YEAR = re.compile(r"(?:19|20)\d\d")


def ranked_words(vocabulary: str) -> dict[str, int]:
    """Whole words of a tokenizer's vocabulary file, ranked by id (frequent ones come first)."""
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    found = sorted((i, t[:-4]) for t, i in vocab.items() if t.endswith("</w>") and len(t) >= 7 and t[:-4].isalpha() and t[:-4].isascii())
    return {w: r for r, (_, w) in enumerate(found, 1)}


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            near[key] = {other[d] for q, other in enumerate(KEY_ROWS) if abs(q - r) <= 1
                         for d in (c - 1, c, c + 1) if 0 <= d < len(other)}
    return near


NEAR = _neighbours()
PLACE = {key: (r, c) for r, row in enumerate(KEY_ROWS) for c, key in enumerate(row)}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """How far the second key lies from the first, in rows and columns."""
    if a not in PLACE or b not in PLACE:
        return None
    return PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]


def _class_size(ch: str) -> int:
    if ch.isascii():
        return 10 if ch.isdigit() else 26 if ch.isalpha() else 33
    return 100


def _repeat_ends(value: str, period: int) -> list[int]:
    """For each position, where the text of this period that starts there ends."""
    n = len(value)
    ends = [min(i + period, n) for i in range(n)]
    for i in range(n - period - 1, -1, -1):
        if value[i] == value[i + period]:
            ends[i] = ends[i + 1]
    return ends


def _walks(low: str) -> tuple[list[int], list[int]]:
    """For each position, where the keyboard walk from there ends; turns before each position."""
    n = len(low)
    ends, turns = [i + 1 for i in range(n)], [0] * n
    for i in range(n - 2, -1, -1):
        if low[i] != low[i + 1] and low[i + 1] in NEAR.get(low[i], ()):
            ends[i] = ends[i + 1]
    for i in range(2, n):
        turns[i] = turns[i - 1] + (_step(low[i - 1], low[i]) != _step(low[i - 2], low[i - 1]))
    return ends, turns


def _stops(least: int, end: int, most: int, last: int) -> list[int]:
    """Ends from ``least`` to ``most``, and from ``last`` characters before ``end``."""
    if end < least:
        return []
    return [*range(least, min(end, most) + 1), *range(max(least, most + 1, end - last), end + 1)]


def guess_cost(value: str, ranks: dict[str, int], longest_word: int | None = None,
               longest_run: int = 64) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 guesses for ``value`` and the segments (kind, start, end) that give it.

    Dynamic programming over prefixes.  Words of up to ``longest_word``
    characters (the longest of ``ranks`` unless given) are looked up directly
    and with substitutions.  Repeats and walks end anywhere up to
    ``longest_run`` characters, and beyond that within a word's or date's
    length of where they break off: only a segment that leaves the run gains
    by starting inside it.  So the work is linear in the length.  A walk turns
    where the step between two keys, in rows and columns, changes.  Each
    segment costs one bit more, for where it ends.  The empty value costs 0.
    """
    n = len(value)
    if longest_word is None:
        longest_word = max(map(len, ranks), default=0)
    last = max(longest_word, 10)
    low = value.replace("\u0130", "i").lower()  # the one letter whose lower case is longer
    plain = low.translate(SWAPS)
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    cut = math.log10(2)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        total = best[i] + cost + (0.0 if kind == "brute" and back[i][0] == "brute" else cut)
        if total < best[j]:
            best[j], back[j] = total, (kind, i)

    repeats = [_repeat_ends(value, period) for period in range(1, 5)]
    walks, turns = _walks(low)
    for i in range(n):
        offer("brute", i, i + 1, math.log10(_class_size(value[i])))
        for j in range(i + 3, min(n, i + longest_word) + 1):
            word = value[i:j]
            rank = ranks.get(low[i:j])
            extra = 0.0
            if rank is None and low[i:j] != plain[i:j]:
                rank, extra = ranks.get(plain[i:j]), cut * sum(a != b for a, b in zip(low[i:j], plain[i:j]))
            if rank is not None:
                caps = sum(ch.isupper() for ch in word)
                if caps:
                    extra += cut if caps == len(word) or caps == 1 and word[0].isupper() else math.log10(math.comb(len(word), caps) + 1)
                offer("word", i, j, math.log10(rank) + extra)
        for found, cost in ((DATES.match(value, i), math.log10(119 * 365)), (YEAR.match(value, i), math.log10(119))):
            if found:
                offer("date", i, found.end(), cost)
        for period, ends in enumerate(repeats, 1):
            block = sum(math.log10(_class_size(ch)) for ch in value[i:i + period])
            for j in _stops(i + max(3, 2 * period), ends[i], i + longest_run, last):
                offer("repeat", i, j, block + math.log10((j - i) / period))
        for j in _stops(i + 4, walks[i], i + longest_run, last):
            offer("walk", i, j, math.log10(47 * (j - i)) + math.log10(4) * (turns[j - 1] - turns[i + 1]))
    cuts: list[tuple[str, int, int]] = []
    j = n
    while j:
        kind, i = back[j]
        if kind == "brute" and cuts and cuts[-1][0] == "brute":
            cuts[-1] = ("brute", i, cuts[-1][2])
        else:
            cuts.append((kind, i, j))
        j = i
    return best[n], cuts[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    return spans


def guessed_spans(text: str, ranks: dict[str, int], min_cost: float, longest_word: int | None = None) -> list[tuple[str, int, int, float]]:
    """("guess", start, end, cost) of credential values that cost at least 10**min_cost guesses."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        cost, _ = guess_cost(m[1], ranks, longest_word)
        if cost >= min_cost:
            out.append(("guess", *m.span(1), cost))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


COLUMNS = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_cost double"


def find_secrets(docs: DataFrame, vocabulary: str, text_col: str = "text", min_cost: float = 9.0) -> DataFrame:
    """``docs`` with a struct column ``secrets`` of counts, digest and spans of every whole text.

    Base spans (assign, access, hex) come from fixed patterns and always stay.
    A value that a credential word announces adds a ``guess`` span when the
    cheapest cut into words, dates, repeats, keyboard walks and brute force
    costs at least ``10**min_cost`` guesses.  Spans are ``kind:start:end`` in
    code points, end exclusive, by start and kind.  ``max_cost`` is the largest
    cost of a guess span, null without one.  Null and empty texts have no spans;
    every row stays, repeated rows too; an empty table gives an empty table;
    a column ``secrets`` of the input is replaced.  Very long texts are searched whole.
    ``vocabulary`` is a tokenizer file whose whole words rank the word list.
    """
    words = ranked_words(vocabulary)
    longest = max(map(len, words), default=0)
    ranks = docs.sparkSession.sparkContext.broadcast(words)

    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                guesses = guessed_spans(text, ranks.value, min_cost, longest)
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(guesses), digest,
                             joined(base + [g[:3] for g in guesses]), max((g[3] for g in guesses), default=None)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")], index=texts.index
                               ).astype({"max_cost": float})

    return docs.withColumn("secrets", F.pandas_udf(scan, COLUMNS)(F.col(f"`{text_col}`")))
