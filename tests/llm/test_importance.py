import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from relevia.llm import importance as I


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def buckets_of(text, buckets=10_000):
    w = words_of(text)
    runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target):
    counts = []
    for texts in ([t for _, t in rows], target):
        n = [0] * 10_000
        for t in texts:
            for b in buckets_of(t):
                n[b] += 1
        counts.append(n)
    s, t = counts
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10_000)]
    out = []
    for doc, text in rows:
        found = buckets_of(text)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r) for r in out), key=str)


def some_rows():
    draw = random.Random(4)
    pool = ["The", "the", "été", "x-1", "a_b", "日本", "long" * 30, "w" * 32, "v" * 33, "42"] + [f"word{i}" for i in range(60)]
    texts = [None, "", " .,- ", "One", "Z" * 5000 + " tail " * 30, "same word " * 4000]
    texts += [" ".join(draw.choice(pool) for _ in range(draw.randrange(1, 90))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[10] + " more" * 25)] + [(900, "again and again " * 9)] * 30


TARGET = ["word1 word2 word3 the", "été", None, "", "日本 x-1 " * 9]


def test_equals_brute_force(spark, documents):
    rows = some_rows()
    target = spark.createDataFrame([(str(i), t) for i, t in enumerate(TARGET)], "item_id string, text string")
    got = sorted((tuple(r) for r in I.resample(documents(rows).repartition(4), target).collect()), key=str)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in brute(rows, TARGET)]
    # repeated rows share a set of ranks; all others have one rank each
    assert got == brute(rows, TARGET)


def test_empty_tables(spark, documents):
    target = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    assert I.resample(documents([]), target).collect() == []
    rows = [(1, "a b " * 20), (2, None)]
    got = sorted(tuple(r) for r in I.resample(documents(rows), target.limit(0)).collect())
    assert got == brute(rows, [])


def test_drawn_documents(spark, documents):
    rows = [(i, f"word{i} " * 25) for i in range(40)]
    target = spark.createDataFrame([("a", "word3 word5")], "item_id string, text string")
    ranks = {r.doc_id for r in I.resample(documents(rows), target).collect() if r["rank"]}
    kept = I.drawn_documents(documents(rows), target)
    assert {r.doc_id for r in kept.collect()} == ranks and len(ranks) == 10
    assert kept.columns == documents(rows).columns


def test_crc_of_ranges_and_pairs():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 4000, dtype=np.uint8)
    starts = draw.integers(0, 2000, 300)
    ends = starts + np.concatenate((np.arange(100), draw.integers(0, 2000, 200)))
    crc = I.Crc32()
    states = crc.states(data, starts, ends)
    one = [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    assert (states ^ np.uint32(0xFFFFFFFF)).tolist() == one
    pairs = crc.pair(states[:-1], states[1:], (ends - starts)[1:]) ^ np.uint32(0xFFFFFFFF)
    cut = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert pairs.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(cut, cut[1:])]


@pytest.mark.parametrize("values", [[0], [-1, 1, 7], [-30000, 29999, 0, 5] * 40])
def test_planes_give_exact_sums(values):
    draw = np.random.default_rng(2)
    gain = np.array(values)
    text = np.sort(draw.integers(0, 9, 5000))
    bucket = draw.integers(0, len(values), 5000)
    expected = np.bincount(text, weights=gain[bucket], minlength=10).astype(np.int64)
    assert I.GainPlanes(gain).sums(text, bucket, 10).tolist() == expected.tolist()


def test_features_of_a_batch():
    found = list(I.features(pa.array(["Ab c", None, "AB  C"]), 10_000, I.Crc32()))
    assert [w.tolist() for _, w, _, _ in found] == [[2, 0, 2]]
    _, _, text, bucket = found[0]
    assert sorted(bucket[text == 0].tolist()) == sorted(buckets_of("ab c")) == sorted(bucket[text == 2].tolist())
