"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended into runs.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every
run of at least two periods has a root that is the longest Lyndon word at its start, under an
order of the words or under its reverse (runs theorem). Per document:

1. Words are cut into stretches outside which no run can lie: a run of at least 24 words and
   three periods repeats each of its eight-word windows within a third of its stretch. Windows
   are matched by hash, which can only keep too much.
2. In each stretch, phase one of Baier's suffix sorting groups the suffixes by their longest
   Lyndon prefix, under both orders, and gives the Lyndon arrays without a suffix array.
3. A root that is followed by itself is extended to both sides by longest common extensions.
   Words are compared by their bytes, so no run is wrong or missing by a clash.

Texts are worked off in slices of a bounded size and never cut; all but the extension of single
runs is linear in the text. A null text has no words. Texts that are empty or too short for a run have none.
Repeated rows are rows of their own, a null doc_id is kept, an empty table gives an empty
result, and no column but the two named is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.llm.textkit import NON_BLANK, Hasher, mix, slices, word_hashes

#: Words to a window when stretches are cut; a run must have at least three windows' words.
GRAM = 8

#: Gives, for a doc_id and a number of words, the numbers of the words that stand in their place, or None.
Rewrite = Callable[[int | None, int], np.ndarray | None]


@dataclass(frozen=True)
class Rule:
    """Which runs count: at least ``least`` words and ``periods`` periods (24 and 3 or more)."""

    least: int = 24
    periods: int = 3

    def __post_init__(self) -> None:
        if self.least < 3 * GRAM or self.periods < 3:
            raise ValueError(f"runs need at least {3 * GRAM} words and 3 periods")


def lyndon_lengths(ids: np.ndarray) -> list[int]:
    """Length of the longest Lyndon word at each position, for integers in their order.

    Groups stand in ascending order in ``suffixes`` and are closed from the last to the first.
    When a group closes, the nearest open suffix to the left of each member joins the member's
    Lyndon word to its own; suffixes that gain equally many words from one group move together
    to a new group right behind their old one.
    """
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ids) else order
    stops = np.append(heads[1:], len(ids))
    place_of = np.empty(len(ids), dtype=np.int64)
    place_of[order] = np.arange(len(ids))
    begin_of = np.empty(len(ids), dtype=np.int64)
    begin_of[order] = np.repeat(heads, stops - heads)
    stop_at = np.zeros(len(ids), dtype=np.int64)
    stop_at[heads] = stops
    suffixes, place, begin, stop = order.tolist(), place_of.tolist(), begin_of.tolist(), stop_at.tolist()
    width = [1] * len(ids)
    closed = [False] * len(ids)
    left = list(range(-1, len(ids) - 1))
    out = [1] * len(ids)

    def open_left(s: int) -> int:
        p = left[s]
        while p >= 0 and closed[p]:
            q = left[p]
            if q >= 0 and closed[q]:
                left[p] = left[q]
            p = q
        left[s] = p
        return p

    def move(p: int, to: int) -> None:
        other, at = suffixes[to], place[p]
        suffixes[at], place[other] = other, at
        suffixes[to], place[p] = p, to

    end = len(ids)
    while end:
        start = begin[suffixes[end - 1]]
        own = width[start]
        if end - start == 1:
            s = suffixes[start]
            closed[s] = True
            out[s] = own
            p = open_left(s)
            if p >= 0:
                b = begin[p]
                to = stop[b] - 1
                move(p, to)
                total = width[b] + own
                stop[b] = to
                begin[p], stop[to], width[to] = to, to + 1, total
        else:
            members = suffixes[start:end]
            for s in members:
                closed[s] = True
                out[s] = own
            gains: dict[int, int] = {}
            for s in members:
                p = open_left(s)
                if p >= 0:
                    gains[p] = gains.get(p, 0) + 1
            levels: dict[int, list[int]] = {}
            for p, gain in gains.items():
                levels.setdefault(gain, []).append(p)
            for gain in sorted(levels, reverse=True):
                old_stop: dict[int, int] = {}
                for p in levels[gain]:
                    b = begin[p]
                    old_stop.setdefault(b, stop[b])
                    stop[b] -= 1
                    move(p, stop[b])
                fresh = {b: (stop[b], width[b] + gain * own) for b in old_stop}
                for p in levels[gain]:
                    begin[p] = fresh[begin[p]][0]
                for b, (to, total) in fresh.items():
                    stop[to], width[to] = old_stop[b], total
        end = start
    return out


def _common(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on are equal, to the right (step 1) or to the left (-1); a < b."""
    most = len(ids) - b if step == 1 else a + 1
    same, block = 0, 16
    while same < most:
        block = min(block, most - same)
        if step == 1:
            differ = ids[a + same : a + same + block] != ids[b + same : b + same + block]
        else:
            differ = (ids[a - same - block + 1 : a - same + 1] != ids[b - same - block + 1 : b - same + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return same + first
        same += block
        block *= 4
    return same


def runs_of(ids: np.ndarray, rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of integers, by start and period."""
    n = len(ids)
    if n < rule.least:
        return []
    found: set[tuple[int, int, int]] = set()
    # sums of codes times powers: equal words give equal sums, and the extension compares words
    powers = np.full(n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    ahead = np.concatenate(([np.uint64(0)], np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)))
    for order in (ids, ids.max() - ids):
        period = np.asarray(lyndon_lengths(order), dtype=np.int64)
        i = np.flatnonzero((np.arange(n) + 2 * period <= n) & (rule.periods * period <= n))
        p = period[i]
        i, p = (x[ids[i] == ids[i + p]] for x in (i, p))
        once = (ahead[i + p] - ahead[i]) * powers[p]
        again = once == ahead[i + 2 * p] - ahead[i + p]
        last: dict[int, tuple[int, int]] = {}
        for at, q in zip(i[again].tolist(), p[again].tolist()):
            low, high = last.get(q, (0, 0))
            if low <= at and at + 2 * q <= high:
                continue
            high = at + q + _common(ids, at, at + q, 1)
            low = at - _common(ids, at - 1, at + q - 1, -1) if at else 0
            if high - low < 2 * q:
                continue
            last[q] = (low, high)
            if high - low >= max(rule.least, rule.periods * q):
                found.add((low, high - low, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _near(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distance from each window to the nearest equal one of the same text; windows that cross an end have none."""
    n = len(grams)
    stops = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(n) + GRAM <= stops)
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    keys = mix(grams[at] ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    gap = np.diff(at[order])
    gap[(keys[order[1:]] != keys[order[:-1]]) | (text[order[1:]] != text[order[:-1]])] = n
    near = np.full(n, n, dtype=np.int64)
    near[at[order[:-1]]] = gap
    near[at[order[1:]]] = np.minimum(near[at[order[1:]]], gap)
    return near


def stretches(hashes: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold a run, for texts one after the other."""
    n = len(hashes)
    none = np.zeros(0, dtype=np.int64)
    if n < rule.least:
        return none, none
    factors = np.cumprod(np.full(GRAM, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        grams[: n - k] += hashes[k:] * factors[k]
    near = _near(grams, sizes)
    bound = np.full(n, n - 1, dtype=np.int64)
    opens_text = np.zeros(n, dtype=bool)
    opens_text[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    while True:
        marked = np.flatnonzero(near <= bound)
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[marked] += 1
        edge[marked + GRAM] -= 1
        inside = np.cumsum(edge[:n]) > 0
        start = np.flatnonzero(inside & (opens_text | ~np.concatenate(([False], inside[:-1]))))
        closes = np.append(opens_text[1:], True) | ~np.append(inside[1:], False)
        stop = np.flatnonzero(inside & closes) + 1
        # a period is at most its part of the stretch; shorter stretches hold no run
        reach = np.where(stop - start >= rule.least, (stop - start) // rule.periods, 0)
        tighter = np.zeros(n, dtype=np.int64)
        tighter[inside] = np.repeat(reach, stop - start)
        if (near[marked] <= tighter[marked]).all():
            return start, stop
        bound = tighter


@dataclass
class Found:
    """One text: its row in the batch, its words after rewriting, and its runs."""

    row: int
    words: list[bytes]
    runs: list[tuple[int, int, int]]

    def collapsed(self) -> bytes:
        """The words without what repeats a run's first period, joined by one space."""
        if not self.runs:
            return b" ".join(self.words)
        keep = np.ones(len(self.words), dtype=bool)
        for start, length, period in self.runs:
            keep[start + period : start + length] = False
        return b" ".join(w for w, k in zip(self.words, keep.tolist()) if k)


def search(ids: pa.Array, texts: pa.Array, rule: Rule, rewrite: Rewrite | None = None) -> Iterator[Found]:
    """The runs of every text of a batch."""
    hasher = Hasher(seed=13, fold_case=False)
    for first, data, starts in slices(texts):
        hashes, index, _, _ = word_hashes(data, starts, hasher, NON_BLANK)
        sizes = np.diff(index)
        moved = {}
        if rewrite is not None:
            for k, doc in enumerate(ids.slice(first, len(sizes)).to_pylist()):
                numbers = rewrite(doc, int(sizes[k])) if sizes[k] else None
                if numbers is not None:
                    moved[k] = numbers
                    hashes[index[k] : index[k + 1]] = hashes[index[k] + numbers]
        begin, end = stretches(hashes, sizes, rule)
        owner = np.searchsorted(index, begin, side="right") - 1
        per_text: dict[int, list[tuple[int, int]]] = {}
        for k, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()):
            per_text.setdefault(k, []).append((a - int(index[k]), b - int(index[k])))
        for k in range(len(sizes)):
            words = data[starts[k] : starts[k + 1] - 1].tobytes().split()
            if k in moved:
                words = [words[j] for j in moved[k].tolist()]
            runs = []
            for a, b in per_text.get(k, ()):
                seen: dict[bytes, int] = {}
                numbers = np.array([seen.setdefault(w, len(seen)) for w in words[a:b]], dtype=np.int64)
                runs += [(a + start, length, period) for start, length, period in runs_of(numbers, rule)]
            yield Found(first + k, words, runs)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def find_runs(
    docs: DataFrame, rule: Rule = Rule(), rewrite: Rewrite | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, start, length, period``: one row per run, words numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(keys[f.row], *r) for f in search(batch.column(0), batch.column(1), rule, rewrite) for r in f.runs]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "period"]
            )

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_runs(
    docs: DataFrame, rule: Rule = Rule(), rewrite: Rewrite | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, text``: the words of each text, joined by one space, with every run cut to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a text at a time: batches in, rows out, nothing piles up
            for f in search(batch.column(0), batch.column(1), rule, rewrite):
                kept = pa.array([f.collapsed()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(f.row, 1), kept], names=["doc_id", "text"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, text string")


REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
)


def run_report(
    docs: DataFrame, rule: Rule = Rule(), rewrite: Rewrite | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: how many runs, the one of most periods (then least start and period), and digests.

    ``runs_sha256`` is of every run's ``start,length,period`` and a line end, by start and period;
    ``collapsed_sha256`` of the text that ``collapse_runs`` gives. Documents without a run have nulls for it.
    """

    def row(f: Found) -> tuple:
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in f.runs)
        best = (None, None, None)
        for s, n, p in f.runs:
            if best[0] is None or n * best[2] > best[1] * p:
                best = (s, n, p)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        text = f.collapsed()
        digest = hashlib.sha256(text).hexdigest()
        kept = text.count(b" ") + 1 if text else 0
        return len(f.runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), digest, len(f.words), kept

    names, kinds = zip(*(f.split() for f in REPORT.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(f) for f in search(batch.column(0), batch.column(1), rule, rewrite)]
            columns = list(zip(*rows)) or [[]] * (len(names) - 1)
            arrays = [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(columns, kinds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=list(names))

    return _rows(docs, doc_id, text).mapInArrow(run, REPORT)
