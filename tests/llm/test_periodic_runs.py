import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from relevia.llm import periodic_runs as R
from relevia.llm.queries import repeated_tail


def brute_lyndon(ids):
    n = len(ids)
    suffixes = [ids[i:] for i in range(n)]
    return [next((j for j in range(i + 1, n) if suffixes[j] < suffixes[i]), n) - i for i in range(n)]


def brute_runs(words, least=24, periods=3):
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if length >= 2 * q:
                found.setdefault((start, length), q)  # periods ascend, so the smallest stays
            start = end
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, periods * q)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_lyndon_arrays_equal_next_smaller_suffixes(letters):
    draw = random.Random(letters)
    for _ in range(300):
        ids = [draw.randrange(letters) for _ in range(draw.randrange(1, 40))]
        assert R.lyndon_lengths(np.array(ids)) == brute_lyndon(ids)
    assert R.lyndon_lengths(np.zeros(0, dtype=np.int64)) == []


def periodic(draw, letters):
    words = []
    while len(words) < draw.randrange(30, 140):
        root = [draw.randrange(letters) for _ in range(draw.randrange(1, 12))]
        words += (root * draw.randrange(1, 9))[: draw.randrange(1, 70)]
    return words


@pytest.mark.parametrize("letters", [1, 2, 4, 50])
def test_runs_equal_brute_force(letters):
    draw = random.Random(letters)
    some = 0
    for _ in range(150):
        words = periodic(draw, letters)
        expected = brute_runs(words)
        some += len(expected)
        assert R.runs_of(np.array(words)) == expected
        # the same through stretches, with another text before and behind
        hashes = R.mix(np.array([7, 8, 9, *words, 7, 8], dtype=np.uint64))
        start, stop = R.stretches(hashes, np.array([3, len(words), 0, 2]), R.Rule())
        got = []
        for a, b in zip((start - 3).tolist(), (stop - 3).tolist()):
            got += [(a + s, n, q) for s, n, q in R.runs_of(np.array(words[a:b]))]
        assert got == expected
    assert some > 20


def brute(rows, rewrite=None):
    out = []
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        if rewrite and doc is not None and words:
            h = zlib.crc32(str(doc).encode())
            if h % 10 == 0:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        out.append(
            (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            + tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
        )
    return sorted(out, key=str)


def some_rows():
    draw = random.Random(3)
    texts = [None, "", " \t\n", "one", "same " * 24, "same " * 23, "a b c " * 8, "a\nb\tc  " * 9 + "d", "é   x " * 12]
    texts += [" ".join(f"w{x}" for x in periodic(draw, k)) for k in (2, 5, 40) for _ in range(12)]
    texts += [" ".join(draw.choice("abcdefgh") * 3 for _ in range(n)) for n in (5, 24, 60, 90)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, "x y " * 20), (3, "twice " * 30), (3, "twice " * 30), (2**63 - 1, "z " * 30)]


@pytest.mark.parametrize("rewrite", [None, repeated_tail])
def test_report_equals_brute_force(spark, documents, rewrite):
    rows = some_rows()
    got = R.run_report(documents(rows).repartition(3), rewrite=rewrite).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == brute(rows, rewrite)


def test_runs_and_texts(spark, documents):
    rows = [(1, "p q r " * 9 + "end"), (2, "nothing here"), (3, None)]
    assert [tuple(r) for r in R.find_runs(documents(rows)).collect()] == [(1, 0, 27, 3)]
    got = {r.doc_id: r.text for r in R.collapse_runs(documents(rows)).collect()}
    assert got == {1: "p q r end", 2: "nothing here", 3: ""}
    assert R.run_report(documents([])).collect() == []


def test_long_text_of_one_word(spark, documents):
    row = R.run_report(documents([(5, "go " * 200_000)])).collect()[0]
    assert (row.n_runs, row.start, row.length, row.period, row.n_kept) == (1, 0, 200_000, 1, 1)


def test_rule_below_the_windows_is_refused():
    with pytest.raises(ValueError):
        R.Rule(least=10)
