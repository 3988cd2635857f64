"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The
automaton reads a document's words and tracks the longest match; where it reaches a window of
an item (ten words, or the whole of a shorter item) the window's words are hit. Words are 64-bit
hashes; runs of words that no item holds in this order are passed over by array operations, so
the automaton only sees places where it can find something.

The items are a query set that every document is held against. They are cut into blocks of a
set number of words; each block is one more pass over the rows as they stream by, without a
shuffle, so memory follows the block and not the benchmark.

Nulls: a null text has no words and a null item no windows; a null item_id is left out of the
lists. Equal items all count. Repeated documents are rows of their own, ties cannot arise,
empty tables give empty results (no items: nothing is hit). Only the named columns are read;
``remove_spans`` passes all other columns on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.llm.textkit import ALNUM, Hasher, mix, slices, word_hashes

WINDOW = 10
#: Words of items in one automaton (about 1 KB each while it is built).
BLOCK_WORDS = 100_000

#: Columns that a scan adds; the marks keep them apart from a table's own.
N_WORDS, HITS, FOUND = "#n_words", "#hits", "#found"

_HASHER = Hasher(seed=3)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, one fewer than there are words."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


class _Filter:
    """Membership in a fixed set of hashes: a table of bits first, then the set."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = np.unique(members)
        bits = max(16, int(16 * len(self.members)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.members >> self.shift).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        found = self.table[(hashes >> self.shift).astype(np.int64)]
        maybe = np.flatnonzero(found)
        if len(maybe):
            at = np.searchsorted(self.members, hashes[maybe])
            at[at == len(self.members)] = 0
            found[maybe] = self.members[at] == hashes[maybe]
        return found


class SuffixAutomaton:
    """All runs of words of a set of items, with the items that hold each run.

    ``length`` is a state's longest run, ``link`` the state of the longest run that ends alike
    but occurs in more places, ``items`` the items that hold the state's runs.
    """

    def __init__(self, items: list[tuple[int, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        words = [(number, w) for number, w in items if w]
        for _, w in words:
            state = 0
            for word in w:
                state = self._extend(state, word)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, w in words:
            state = 0
            for word in w:
                state = self.next[state][word]
                up = state
                while up > 0 and number not in self.items[up]:
                    self.items[up].add(number)
                    up = self.link[up]
            if len(w) < window:
                while self.length[self.link[state]] >= len(w):
                    state = self.link[state]
                self.short[state].append((len(w), number))
        # per state: where its run of `window` words is, and the short items that end here or at its links
        self.full = [-1] * len(self.next)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[state]
            self.ends[state] = self.ends[above] + self.short[state]
            if self.length[state] >= window:
                self.full[state] = state if self.length[above] < window else self.full[above]

    def _add(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int, there: int) -> int:
        """A state of its own for the runs of ``there`` that ``state`` reaches by ``word``."""
        part = self._add(self.length[state] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = part
        while state >= 0 and self.next[state].get(word) == there:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._add(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            exact = self.length[there] == self.length[state] + 1
            self.link[new] = there if exact else self._split(state, word, there)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, length, items) of each window that ends at a word."""
        state, length = 0, 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= self.window:
                yield at, self.window, self.items[self.full[state]]
            for size, number in self.ends[state]:
                if size <= length:
                    yield at, size, {number}


class Finder:
    """An automaton with the filters before it, for one block of items."""

    _kept: tuple | None = None

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        runs = []
        for number, text in items:
            for _, data, starts in slices(pa.array([text], pa.string())):
                runs.append((number, word_hashes(data, starts, _HASHER, ALNUM)[0]))
        self.automaton = SuffixAutomaton([(n, r.tolist()) for n, r in runs], window)
        self.words = _Filter(np.concatenate([r for _, r in runs] or [np.zeros(0, np.uint64)]))
        self.pairs = _Filter(np.concatenate([_pairs(r) for _, r in runs if len(r)] or [np.zeros(0, np.uint64)]))
        self.least = min([min(len(r), window) for _, r in runs if len(r)], default=window)

    @classmethod
    def shared(cls, items: list[tuple[int, str]], window: int) -> Finder:
        """The finder of the items this worker saw last."""
        if cls._kept is None or cls._kept[0] != (items, window):
            cls._kept = ((items, window), cls(items, window))
        return cls._kept[1]

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs [first, last) of words that follow each other in some item, long enough for a window."""
        if self.least == 1:
            known = self.words.of(hashes)
        else:
            known = np.zeros(len(hashes), dtype=bool)
            if len(hashes) > 1:
                known[:-1] = self.pairs.of(_pairs(hashes))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        first, last = edges[::2], edges[1::2] + (self.least > 1)
        keep = last - first >= self.least
        return first[keep], last[keep]


def _scan(blocks: list[tuple[int, str]], window: int, names: list[str], text_at: int):
    """Adds a block's hits to the lists HITS (starts and ends by turns, in words) and FOUND (items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder.shared(blocks, window)
        for batch in batches:
            for first_row, data, starts in slices(batch.column(text_at)):
                hashes, bounds, _, _ = word_hashes(data, starts, _HASHER, ALNUM)
                texts = len(starts) - 1
                part = batch.slice(first_row, texts)
                counts = np.diff(bounds)
                hits: list[list[int]] = part.column(names.index(HITS)).to_pylist()
                found: list[list[int]] = part.column(names.index(FOUND)).to_pylist()
                # a run may reach into the next text: cut at the texts' bounds
                for a, b in zip(*finder.candidates(hashes)):
                    text = int(np.searchsorted(bounds, a, side="right")) - 1
                    while a < b:
                        stop = min(b, bounds[text + 1])
                        if stop - a >= finder.least:
                            items: set[int] = set()
                            for end, size, numbers in finder.automaton.matches(hashes[a:stop].tolist()):
                                at = int(a - bounds[text]) + end
                                hits[text] += [at - size + 1, at + 1]
                                items |= numbers
                            found[text] += items
                        a, text = stop, text + 1
                columns = [
                    pa.array(counts, pa.int64()) if n == N_WORDS
                    else pa.array(hits, pa.list_(pa.int32())) if n == HITS
                    else pa.array(found, pa.list_(pa.int64())) if n == FOUND
                    else part.column(i)
                    for i, n in enumerate(names)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> list[list[tuple[int, str]]]:
    """The query set in blocks of at most ``block_words`` words (a longer item is a block of its own)."""
    out, room = [[]], block_words
    rows = items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).filter(F.col(text).isNotNull())
    for number, words in rows.orderBy(item_id, text).toLocalIterator():
        size = len(words.split()) + 1
        if size > room and out[-1]:
            out.append([])
            room = block_words
        out[-1].append((number, words))
        room -= size
    return out


def contamination_hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """All columns of docs, then N_WORDS, HITS (starts and ends of windows by turns) and FOUND (items)."""
    rows = docs.select(
        "*",
        F.lit(0).cast("long").alias(N_WORDS),
        F.array().cast("array<int>").alias(HITS),
        F.array().cast("array<long>").alias(FOUND),
    ).withColumn(text, F.col(text).cast("string"))
    for block in _blocks(items, item_id, item_text, block_words):
        rows = rows.mapInArrow(_scan(block, window, rows.columns, rows.columns.index(text)), rows.schema)
    return rows


def _merge(hits: list[int]) -> list[list[int]]:
    """Windows as disjoint spans in order."""
    out: list[list[int]] = []
    for start, end in sorted(zip(hits[::2], hits[1::2])):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merge(h) for h in batch.column(2).to_pylist()]
        found = [sorted({str(n) for n in f if n is not None}) for f in batch.column(3).to_pylist()]
        n_items = [len(set(f)) for f in batch.column(3).to_pylist()]
        hit = [sum(b - a for a, b in s) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(hit, pa.int64()),
                pa.array(n_items, pa.int64()),
                pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]),
                pa.array([h > 0 for h in hit]),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination_report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    rows = contamination_hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **options)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return rows.select(F.col("doc_id").cast("long"), *[f"`{c}`" for c in (N_WORDS, HITS, FOUND)]).mapInArrow(_digest, schema)


def remove_spans(
    docs: DataFrame, items: DataFrame, most_coverage: float = 0.5, least_span: int = 1, text: str = "text", **options
) -> DataFrame:
    """docs without the spans of items: spans of ``least_span`` words or more are cut out of the text,
    documents with more than ``most_coverage`` of their words hit are dropped. ``n_chars`` follows the text
    where there is such a column; documents without a hit are unchanged."""
    columns = docs.columns
    rows = contamination_hits(docs, items, text=text, **options)
    names = rows.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), [True] * batch.num_rows
            for row, hits in enumerate(batch.column(names.index(HITS)).to_pylist()):
                spans = [s for s in _merge(hits) if s[1] - s[0] >= least_span]
                if not spans:
                    continue
                n_words = batch.column(names.index(N_WORDS))[row].as_py()
                keep[row] = sum(b - a for a, b in spans) <= most_coverage * n_words
                for _, data, starts in slices(batch.column(at).slice(row, 1)):
                    _, _, first, last = word_hashes(data, starts, _HASHER, ALNUM)
                    parts, done = [], 0
                    for a, b in spans:
                        parts.append(data[done : first[a]].tobytes())
                        done = int(last[b - 1])
                    parts.append(data[done : len(data) - 1].tobytes())
                    texts[row] = b"".join(parts).decode()
            columns_out = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(columns))]
            out = pa.RecordBatch.from_arrays(columns_out, names=columns)
            yield out.filter(pa.array(keep))

    out = rows.mapInArrow(run, docs.withColumn(text, F.col(text).cast("string")).schema)
    if "n_chars" in columns:
        same = F.when(F.col(text).isNotNull(), F.char_length(text)).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", same)
    return out
