"""Personal data: fixed patterns, and a skip-chain conditional random field over them.

The base finds emails, IP addresses, card numbers and phone numbers by pattern; its spans always
stay. The field then labels all tokens with a digit or an `@`, the only ones that can be part of
such data. Neighbours in the text share chain potentials. Repeated or similar tokens, however far
apart in the document, share skip potentials: the same digits or address, the same last seven or first
eight digits, or the same part before the `@`. Loopy message passing over the whole document, with
the base's labels as given, lets a number that is clear in one place be found in a place where no
pattern matches. Tokens that it labels with confidence, that no base span covers and that
have the shape of their kind become spans of the method; neighbours are joined only where neither is
whole by itself.

Weights come from a bounded sample of documents (``most_docs``, chosen by a hash) with the
base's spans as labels, by pseudo-likelihood: each token's label given its features and its
neighbours' labels. A share of the tokens (``hidden``) is learned from once more with their surroundings
hidden, so that only links speak for them, as it will be where the base finds nothing. Of a document of the sample at most ``most_tokens`` neighbouring tokens are learned
from. All documents are searched over their whole text.

Nulls: a null text is empty and has no spans; a null doc_id is a row like others. Repeated rows
give repeated results, equal scores go to the first label, empty tables give empty results. Only
the two named columns are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.llm.textkit import NON_BLANK, Hasher, byte_set, slices, spans

KINDS = ("email", "ip", "card", "phone")
MOST_DOCS = 5_000
MOST_TOKENS = 1_024
#: Share of the tokens that a fit sees once more without their surroundings.
HIDDEN = 0.3

_LOCAL = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2E, 0x2E), (0x5F, 0x5F), (0x25, 0x25), (0x2B, 0x2B), (0x2D, 0x2D))
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried once: a later start inside it ends at the same place
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = byte_set((0x30, 0x39))
_MARKED = byte_set((0x30, 0x39), (0x40, 0x40))
_EDGE = b".,;:!?()[]{}<>\"'"
#: Last and first digits by which two numbers are similar.
SUFFIX, PREFIX = 7, 8
#: Digits of a span that the method may add: card and phone numbers, the latter also without their country.
_FITS = {2: (13, 19), 3: (7, 15)}

_HASHER = Hasher(seed=13)


def _count_digits(match: bytes) -> bytes:
    return bytes(c for c in match if 48 <= c <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = c - 48
        if place % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and kind."""
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL[text[start - 1]]:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, 0, match.end()))
            done = match.end()
        at = text.find(b"@", max(done, at + 1))
    for match in _IP.finditer(text):
        if all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in match.groups()):
            out.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _count_digits(match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((match.start(), 2, match.end()))
    for match in _PHONE.finditer(text):
        if 10 <= len(_count_digits(match[0])) <= 15:
            out.append((match.start(), 3, match.end()))
    return sorted(out)


#: Yes-or-no features of a token.
FEATURES = (
    "any", "at_sign", "address", "four_parts", "digits_1_2", "digits_3_6", "digits_7_9", "digits_10_13", "digits_14_19",
    "digits_20", "check_digit", "plus", "bracket", "hyphen", "dot", "letters", "after_plus", "only_digits",
)

#: Features that hang on a token's surroundings or its exact form, which differ where a pattern fails.
_SURROUNDINGS = [FEATURES.index(f) for f in ("check_digit", "plus", "bracket", "hyphen", "after_plus")]


def _features(token: bytes, digits: bytes, after_plus: bool) -> list[bool]:
    n = len(digits)
    match = _IP.fullmatch(token)
    return [
        True,
        b"@" in token,
        b"@" in token and _DOMAIN.fullmatch(token.rpartition(b"@")[2]) is not None,
        match is not None and all(len(p) <= 3 for p in match.groups()),
        1 <= n <= 2,
        3 <= n <= 6,
        7 <= n <= 9,
        10 <= n <= 13,
        14 <= n <= 19,
        n >= 20,
        14 <= n <= 19 and luhn(digits),
        token[:1] == b"+",
        b"(" in token or b")" in token,
        b"-" in token,
        b"." in token,
        re.search(rb"[A-Za-z\x80-\xff]", token) is not None,
        after_plus,
        n == len(token),
    ]


def _keys(core: bytes, digits: bytes) -> list[tuple[str, bytes]]:
    """What makes two tokens the same or similar; links are made per key."""
    if b"@" in core:
        address = core.lower()
        local = address.rpartition(b"@")[0]
        return [("same", address), *([("local", local)] if len(local) >= 4 else [])]
    if len(digits) < 4:
        return []
    keys = [("same", digits)]
    if len(digits) > SUFFIX:
        keys.append(("last", digits[-SUFFIX:]))
    if len(digits) > PREFIX + 1:
        keys.append(("first", digits[:PREFIX]))
    return keys


def _fits(kind: int, span: bytes) -> bool:
    """Whether bytes have the shape of their kind, which is wider than the base's pattern."""
    if kind == 0:
        return b"@" in span.strip(b"@")
    if kind == 1:
        match = _IP.fullmatch(span)
        return match is not None and all(len(part) <= 3 for part in match.groups())
    low, high = _FITS[kind]
    return low <= len(_count_digits(span)) <= high


@dataclass
class Graph:
    """Tokens of some documents: byte spans, features, base labels (0 is none) and links of both kinds."""

    document: np.ndarray
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray
    y: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def build_graph(texts: list[bytes], base: list[list[tuple[int, int, int]]], tokens: list[list[tuple[int, int]]]) -> Graph:
    """Tokens with edges; ``tokens`` has the byte spans of each text's marked words."""
    document, start, end, x, y, chain, skip = [], [], [], [], [], [], []
    for number, (text, found, words) in enumerate(zip(texts, base, tokens)):
        last: dict[tuple[str, bytes], int] = {}
        at, before, open_ = 0, None, False
        for a, b in words:
            word = text[a:b]
            core = word.strip(_EDGE) or word
            a += word.find(core)
            b = a + len(core)
            while at < len(found) and max(f[2] for f in found[at : at + 1]) <= a:
                at += 1
            label = next((k + 1 for s, k, e in found[at : at + 8] if s < b and e > a), 0)
            digits = _count_digits(core)
            near = before is not None and a - before <= 3
            open_ = near and (open_ or text[start[-1] : start[-1] + 1] == b"+")
            node = len(start)
            document.append(number)
            start.append(a)
            end.append(b)
            x.append(_features(core, digits, open_))
            y.append(label)
            if before is not None:
                chain.append((node - 1, node, int(near)))
            # each key links to its last place, so links stay few times as many as tokens
            linked = set()
            for key in _keys(core, digits):
                if key in last:
                    linked.add(last[key])
                last[key] = node
            skip.extend((other, node) for other in sorted(linked))
            before = b
    return Graph(
        np.array(document, dtype=np.int64),
        np.array(start, dtype=np.int64),
        np.array(end, dtype=np.int64),
        np.array(x, dtype=float).reshape(-1, len(FEATURES)),
        np.array(y, dtype=np.int64),
        np.array(chain, dtype=np.int64).reshape(-1, 3),
        np.array(skip, dtype=np.int64).reshape(-1, 2),
    )


@dataclass(frozen=True)
class Field:
    """Potentials: features by label, chain by (far or near, left label, right label), skip by both labels."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @staticmethod
    def empty() -> Field:
        n = len(KINDS) + 1
        return Field(np.zeros((len(FEATURES), n)), np.zeros((2, n, n)), np.zeros((n, n)))


def marginals(
    field: Field, graph: Graph, rounds: int = 50, damping: float = 0.3, tolerance: float = 1e-4, given: np.ndarray | None = None
) -> np.ndarray:
    """Label probabilities by loopy message passing, all messages of a round at once.

    ``given`` has the labels that are known, 0 where none is. Exact where links form no loop, once there were as many rounds as a chain is long; influence
    fades along longer chains.
    """
    labels = field.unary.shape[1]
    unary = graph.x @ field.unary
    if given is not None:
        seen = np.flatnonzero(given)
        unary[seen] = -30.0
        unary[seen, given[seen]] = 30.0
    left = np.concatenate((graph.chain[:, 0], graph.skip[:, 0]))
    right = np.concatenate((graph.chain[:, 1], graph.skip[:, 1]))
    potential = np.concatenate((field.chain[graph.chain[:, 2]], np.broadcast_to(field.skip, (len(graph.skip), labels, labels))))
    source, target = np.concatenate((left, right)), np.concatenate((right, left))
    potential = np.concatenate((potential, potential.transpose(0, 2, 1)))
    back = np.roll(np.arange(len(source)), -len(left))
    messages = np.zeros((len(source), labels))

    def beliefs() -> np.ndarray:
        total = [np.bincount(target, weights=messages[:, k], minlength=len(unary)) for k in range(labels)]
        return unary + np.stack(total, axis=1)

    for _ in range(rounds):
        if not len(source):
            break
        inner = (beliefs()[source] - messages[back])[:, :, None] + potential
        top = inner.max(axis=1)
        new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = damping * messages + (1 - damping) * new
        if change < tolerance:
            break
    out = beliefs()
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def fit_field(graph: Graph, ridge: float = 1e-4, rounds: int = 1000, hidden: float = HIDDEN) -> Field:
    """Pseudo-likelihood by gradient steps: a token's label given its features and its neighbours' labels.

    A token without a label that repeats one with a label is unknown, neither learned from nor seen by others.
    A share of the tokens without a label, and of those with a label that links confirm, is learned from again with
    the links as their only neighbours.
    """
    n, labels = len(graph.y), len(KINDS) + 1
    if not n:
        return Field.empty()
    marked, before = graph.y > 0, -1
    while marked.sum() != before:
        before = marked.sum()
        linked = marked[graph.skip].any(axis=1)
        marked[graph.skip[linked].ravel()] = True
    known = ~marked | (graph.y > 0)
    one = np.eye(labels)[graph.y] * known[:, None]
    parts = [graph.x]
    for near in (0, 1):
        edges = graph.chain[graph.chain[:, 2] == near]
        for a, b in ((0, 1), (1, 0)):
            seen = np.zeros((n, labels))
            np.add.at(seen, edges[:, b], one[edges[:, a]])
            parts.append(seen)
    seen = np.zeros((n, labels))
    np.add.at(seen, graph.skip[:, 0], one[graph.skip[:, 1]])
    np.add.at(seen, graph.skip[:, 1], one[graph.skip[:, 0]])
    x = np.concatenate([*parts, seen], axis=1)
    linked = seen[np.arange(n), graph.y] > 0
    again = known & ((graph.y == 0) | linked) & (np.random.default_rng(1).random(n) < hidden)
    alone = x[again]
    alone[:, _SURROUNDINGS] = 0
    alone[:, len(FEATURES) : -labels] = 0
    # equal rows are one row with a weight
    x, y = np.concatenate((x[known], alone)), np.concatenate((graph.y[known], graph.y[again]))
    code, inverse = np.unique(np.concatenate((x, y[:, None]), axis=1), axis=0, return_inverse=True)
    weight = np.bincount(inverse.ravel(), minlength=len(code)) / len(y)
    x, one = code[:, :-1], np.eye(labels)[code[:, -1].astype(int)]
    w = np.zeros((x.shape[1], labels))
    speed = np.zeros_like(w)
    # the largest curvature bounds the step; momentum does the rest
    step = 1.0 / (0.5 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + ridge)
    for turn in range(rounds):
        pull = turn / (turn + 3)
        ahead = w + pull * speed
        score = x @ ahead
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ ((p - one) * weight[:, None]) + ridge * ahead)
        speed, w = new - w, new
    f = len(FEATURES)
    sides = w[f:].reshape(5, labels, labels)  # neighbour's label, own label
    chain = np.stack([(sides[2 * k] + sides[2 * k + 1].T) / 2 for k in (0, 1)])
    # links agree or they do not: a skip potential is symmetric
    return Field(w[:f], chain, (sides[4] + sides[4].T) / 2)


def _batch(column: pa.Array) -> Iterator[tuple[int, int, list[int], list[bytes], list, list, np.ndarray, np.ndarray]]:
    """Per slice: first row, number of texts, and of the texts with marks: rows, bytes, base spans, tokens."""
    for first_row, data, starts in slices(column):
        marks = np.flatnonzero(_MARKED[data])
        rows = np.unique(np.searchsorted(starts, marks, side="right") - 1)
        word_a, word_b = spans(data, NON_BLANK)
        marked = np.searchsorted(marks, word_b) > np.searchsorted(marks, word_a)
        word_a, word_b = word_a[marked], word_b[marked]
        bounds = np.searchsorted(word_a, starts)
        texts, base, tokens = [], [], []
        for row in rows.tolist():
            text = data[starts[row] : starts[row + 1] - 1].tobytes()
            texts.append(text)
            base.append(base_spans(text))
            own = slice(bounds[row], bounds[row + 1])
            tokens.append(list(zip((word_a[own] - starts[row]).tolist(), (word_b[own] - starts[row]).tolist())))
        yield first_row, len(starts) - 1, rows.tolist(), texts, base, tokens


def _added(graph: Graph, field: Field, texts, base, least: float) -> list[tuple[int, int, int, int]]:
    """(document, start, kind, end) of confident tokens in the shape of their kind that no base span touches.

    Neighbouring tokens of one label are one span where neither is whole by itself.
    """
    if not len(graph.y):
        return []
    p = marginals(field, graph, given=graph.y)
    label = p.argmax(axis=1)
    sure = (label > 0) & (p.max(axis=1) >= least) & (graph.y == 0)
    near = np.zeros(len(label), dtype=bool)
    near[graph.chain[graph.chain[:, 2] == 1][:, 1]] = True
    out: list[tuple[int, int, int, int]] = []
    last = -2
    for i in np.flatnonzero(sure).tolist():
        d, a, k, b = int(graph.document[i]), int(graph.start[i]), int(label[i]) - 1, int(graph.end[i])
        if last == i - 1 and near[i] and out[-1][0] == d and out[-1][2] == k:
            before = out[-1][1], out[-1][3]
            if not _fits(k, texts[d][a:b]) and not _fits(k, texts[d][before[0] : before[1]]):
                a = out.pop()[1]
        out.append((d, a, k, b))
        last = i
    # tokens are words; a base span may begin inside the gap between two of them
    return [
        s for s in out if _fits(s[2], texts[s[0]][s[1] : s[3]]) and not any(x < s[3] and e > s[1] for x, _, e in base[s[0]])
    ]


def learn_field(
    docs: DataFrame,
    most_docs: int = MOST_DOCS,
    most_tokens: int = MOST_TOKENS,
    hidden: float = HIDDEN,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Field:
    """Fit on about ``most_docs`` documents; features of their tokens reach the driver, not their texts.

    A document with more than ``most_tokens`` tokens gives that many neighbouring ones, from a place in it that a
    checksum of the text chooses.
    """
    total = docs.count()
    picked = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 30)) < most_docs / max(1, total) * (1 << 30)
    schema = "x array<byte>, y array<byte>, chain array<int>, skip array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, texts, base, tokens in _batch(batch.column(0)):
                out = [[], [], [], []]
                for content, found, words in zip(texts, base, tokens):
                    at = zlib.crc32(content) % max(1, len(words) - most_tokens + 1)
                    words = words[at : at + most_tokens]
                    g = build_graph([content], [[f for f in found if f[2] > words[0][0]]], [words])
                    for to, values in zip(out, (g.x, g.y, g.chain, g.skip)):
                        to.append(values.astype(int).ravel().tolist())
                kinds = (pa.int8(), pa.int8(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.list_(k)) for v, k in zip(out, kinds)], names=["x", "y", "chain", "skip"]
                )

    rows = docs.filter(picked).select(F.col(text).cast("string")).mapInArrow(run, schema).collect()
    x, y, chain, skip, base = [], [], [], [], 0
    # rows arrive in no set order
    for row in sorted(rows):
        x.append(np.array(row.x, dtype=float).reshape(-1, len(FEATURES)))
        y.append(np.array(row.y, dtype=np.int64))
        chain.append(np.array(row.chain, dtype=np.int64).reshape(-1, 3) + [base, base, 0])
        skip.append(np.array(row.skip, dtype=np.int64).reshape(-1, 2) + base)
        base += len(row.y)
    if not base:
        return Field.empty()
    x, y, chain, skip = (np.concatenate(v) for v in (x, y, chain, skip))
    return fit_field(Graph(y, y, y, x, y, chain, skip), hidden=hidden)


def find_pii(
    docs: DataFrame, field: Field | None = None, least: float = 0.9, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``n_added`` for every row.

    Counts and the digest are of base spans, ``spans`` has all of them. ``field`` is learned from
    docs if not given.
    """
    field = field or learn_field(docs, doc_id=doc_id, text=text, **options)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for first, n, rows, texts, base, tokens in _batch(batch.column(1)):
                graph = build_graph(texts, base, tokens)
                every = [list(b) for b in base]
                for d, a, k, b in _added(graph, field, texts, base, least):
                    every[d].append((a, k, b))
                counts = np.zeros((n, len(KINDS) + 1), dtype=np.int64)
                digest, joined = [nothing] * n, [""] * n
                for row, content, own, found in zip(rows, texts, base, every):
                    if not found:
                        continue
                    # bytes to code points: bytes that do not begin one are passed over
                    point = np.cumsum((np.frombuffer(content, np.uint8) & 0xC0) != 0x80)
                    point = np.concatenate(([0], point))
                    say = lambda s: ",".join(f"{KINDS[k]}:{point[a]}:{point[b]}" for a, k, b in sorted(s))  # noqa: E731, B023
                    digest[row] = hashlib.sha256(say(own).encode()).hexdigest()
                    joined[row] = say(found)
                    for _, k, _ in own:
                        counts[row, k] += 1
                    counts[row, -1] = len(found) - len(own)
                columns = [pa.array(counts[:, k]) for k in range(len(KINDS) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *columns[:-1], pa.array(digest), pa.array(joined), columns[-1]], names=names
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)
