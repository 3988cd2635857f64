import random
import re

import numpy as np
import pyarrow as pa
import pytest

from relevia.llm import minhash_dedup as D
from relevia.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def variants(seed, n, words=60, most=14):
    """Texts at many distances from each other around the threshold."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(most)):
            w[draw.randrange(words)] = f"v{draw.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_equals_brute_force(spark, documents, block):
    texts = variants(1, 60) + variants(2, 40, 25, 6) + variants(3, 30, 200, 60)
    texts += [None, "", " \n", "one", "One", "two", "a b", "b a", "a b a b", "x " * 20000, "x x", "É é", "é é"] + ["same copy of it"] * 30
    random.Random(4).shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "same copy of it"), (None, "alone with null id"), (7, "twice here"), (7, "twice here"), (7, "other text")]
    got = D.near_duplicates(documents(rows), D.Method(block=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_rows_of_a_bucket_grow_in_proportion(spark):
    """All pairs of different labels meet, and a class is copied a bounded number of times however large its bucket."""
    per_class = {}
    for m in (200, 800):
        members = spark.range(m).selectExpr("1L AS key", "struct(id AS d, id AS u) AS node", "if(id % 4 = 0, -1, id) AS label")
        tiles = D.tiles(members, 2)
        assert tiles.count() == m
        met, copies = set(), 0
        for group in D.in_groups(tiles, []).groupBy("key", "i", "j").agg({"d": "collect_list"}).collect():
            copies += len(group[3])
            met |= {(a, b) for a in group[3] for b in group[3] if a < b}
        assert met >= {(a, b) for b in range(m) for a in range(b) if a % 4 or b % 4}
        per_class[m] = copies / m
    assert per_class[800] < 1.2 * per_class[200]


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty(spark, documents):
    assert D.near_duplicates(documents([])).collect() == []
    assert [tuple(r) for r in D.near_duplicates(documents([(3, None)])).collect()] == [(3, 0, 3, True)]


def test_sketches_estimate_similarity():
    method = D.Method()
    texts = variants(9, 120, 300, 20)
    sets = [shingles(t) for t in texts]
    for _, values, bounds in D.shingle_sets(pa.array(texts)):
        _, sketch = D._signatures(values, bounds, method)
    errors = []
    for i in range(1, 120):
        bits = int(np.bitwise_count((sketch[i] ^ sketch[0]).view(np.uint64)).sum())
        true = len(sets[i] & sets[0]) / len(sets[i] | sets[0])
        estimate = 1 + method.bits / (4 * method.samples) * np.log(max(1e-9, 1 - 2 * bits / method.bits))
        errors.append(true - estimate)
        assert true < 0.8 or bits <= method.most_different_bits
    # the standard error of 192 samples is 0.03 to 0.036 from similarity 0.8 down to 0.5
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.06
