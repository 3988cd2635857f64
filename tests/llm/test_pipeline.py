"""Each stage against the rows it should keep, worked out in plain Python from its input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import brute as brute_hits
from test_decontaminate import words
from test_minhash_dedup import brute as brute_near
from test_mixing import brute_targets

import corpus_pipeline as C
from relevia.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    """The documents before the first stage and after each."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(tables):
    for t in tables[1:-1]:
        assert dict(t.dtypes) == dict(tables[0].dtypes)


def test_quality(spark, tables, folder):
    kept = {r.doc_id for r in QUERIES["op6_quality"](spark, folder).collect() if r.predicted == 1}
    assert sorted(rows(tables[1])) == sorted(r for r in rows(tables[0]) if r[0] in kept)
    assert 0 < len(kept) < tables[0].count()


def test_decontamination(spark, tables, folder):
    items = rows(spark.read.parquet(f"{folder}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    before, after = rows(tables[2]), dict(rows(tables[3]))
    hits = {r[0]: r for r in brute_hits(before, items)}
    assert any(r[2] for r in hits.values())
    for doc, text in before:
        _, n_words, n_hit, *_ = hits[doc]
        if n_hit == 0:
            assert after[doc] == text
        elif 2 * n_hit > n_words:
            assert doc not in after
        else:
            assert len(words(after[doc])) == n_words - n_hit
    assert not any(r[2] for r in brute_hits(list(after.items()), items) if hits[r[0]][2] == 0)


def test_mixing(tables):
    before = tables[3].select("doc_id", "source", "text").collect()
    copies = Counter(r.doc_id for r in tables[4].select("doc_id").collect())
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in before}
    total, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        assert copies[r.doc_id] in (0, 1, 2)
        total[r.source] += size[r.doc_id]
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    target = brute_targets(dict(total))
    for source in total:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[d] == t for d, t in rows(tables[4]))


def test_token_output(tables):
    from tokenizers import Tokenizer

    from relevia.llm.encoder import default_vocabulary

    tokenizer = Tokenizer.from_file(default_vocabulary())
    start, want = 0, []
    for doc, text in sorted(rows(tables[4])):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tables[5].collect())) == want


def test_stages_take_nulls_repeats_and_empty_tables(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5), (None, "w", None, "b", 1)]
    for rows_in in (data, []):
        docs = spark.createDataFrame(rows_in, schema)
        for _, stage in C.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= 2 * len(rows_in)
    near = C.drop_near_duplicates(spark, spark.createDataFrame(data, schema), folder)
    assert Counter(r.doc_id for r in near.collect()) == {1: 1, 2: 1, 3: 1, None: 1}


def near_by_five(data):
    """One doc_id of each component of texts whose 5-word shingle sets have a similarity of 0.8 or more."""
    sets = []
    for _, text in data:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(data)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and label[i] != label[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return {min(doc for (doc, _), x in zip(data, label) if x == one) for one in set(label)}


def test_near_duplicates_by_five_words(spark, tables, folder):
    before = rows(tables[1])
    assert sorted(rows(tables[2])) == sorted(r for r in before if r[0] in near_by_five(before))


def test_lightly_edited_texts_stay(spark, folder):
    """One word in 20 replaced: 2-word sets are above 0.8, 5-word sets below."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"v{k}x{i}" if k and i % 20 == 10 else w for i, w in enumerate(base)) for k in (0, 1)]
    texts += [" ".join(base[:-1] + ["end"]), "one two three", "One two  three", "one two", "one two three four"]
    data = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in C.drop_near_duplicates(spark, docs, folder).collect()}
    assert kept == near_by_five(data) == {0, 1, 3, 5, 6}
    assert {doc for doc, _, _, keep in brute_near(data) if keep} != kept


def test_copies_among_null_and_equal_ids(spark, folder):
    texts = {name: " ".join(f"{name}{i}" for i in range(30)) for name in "wxyz"}
    data = [(2, "w"), (None, "w"), (None, "z"), (7, "y"), (9, "y"), (9, "x"), (9, "x"), (None, "z")]
    last = 2**63 - 1
    rows_in = [(d, texts[t], "en", "a", 1) for d, t in data] + [(last, "only here", "en", "a", 9), (5, "", "en", "a", 0), (6, None, None, None, None)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter((r.doc_id, r.text) for r in C.drop_near_duplicates(spark, docs, folder).collect())
    want = [(2, texts["w"]), (None, texts["z"]), (7, texts["y"]), (9, texts["x"]), (last, "only here"), (5, ""), (6, None)]
    assert got == Counter(want)


def test_workers_get_small_batches_and_give_them_back(spark, monkeypatch):
    import pyarrow as pa

    from relevia import session
    from relevia.llm import textkit

    before = spark.conf.get(session.BATCH_BYTES)
    try:
        spark.conf.set(session.BATCH_BYTES, "64m")
        session.bound_batches(spark)
        assert int(spark.conf.get(session.BATCH_BYTES).rstrip("b")) <= 2 << 20
    finally:
        spark.conf.set(session.BATCH_BYTES, before)

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(textkit.pa, "default_memory_pool", Pool)
    assert len(list(textkit.slices(pa.array(["a text"] * 3)))) == 1 and Pool.released == 1
