import hashlib
import random
import re

import numpy as np
import pytest

from relevia.llm import exact_dedup as D


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for doc, text in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in rows:
        group = groups[norm(text)]
        sha = hashlib.sha256(norm(text).encode()).hexdigest()
        out.append((doc, min(group)[3], len(group), sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("key_bits", [2, 63])
@pytest.mark.parametrize("bucket_bytes", [1, 1 << 26])
def test_equals_brute_force(spark, documents, key_bits, bucket_bytes):
    draw = random.Random(5)
    texts = [None, "", " \n\t", "a b", "ab", "a  b ", "é x", "long " * 40000] + ["hot text"] * 60
    texts += ["".join(draw.choice("ab ") for _ in range(draw.randrange(8))) for _ in range(150)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "ab"), (None, "only null id"), (7, "twice"), (7, "twice")]
    got = D.exact_dedup(documents(rows).repartition(5), key_bits, bucket_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark, documents):
    assert D.exact_dedup(documents([])).collect() == []


def test_directory_doubles_until_buckets_fit():
    sizes = np.array([1, 1, 1, 1, 9, 1, 0, 0])
    entries = D.directory(sizes, 4)
    assert entries.tolist() == [0, 0, 0, 0, 1, 2, 3, 3]
    assert D.directory(np.zeros(8), 4).tolist() == [0]
    for capacity in (1, 3, 100):
        entries = D.directory(sizes, capacity)
        assert (np.diff(entries) >= 0).all()
