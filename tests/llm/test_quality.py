import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from relevia.llm import quality as Q


def corpus(n, seed=1):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.8
        words = [draw.choice(["alpha", "beta", "gamma", "of", "the", "in"]) + draw.choice(["", "", "."]) for _ in range(draw.randrange(5, 60))]
        if not good:
            words = [w + draw.choice(["$$$", "%%%", " |"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame([(*r, 0, "x") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_folds(spark, documents):
    rows, labels = corpus(600)
    truth = dict(labels)
    rows += [(9000, None), (9001, ""), (None, "alpha of the"), (9002, "x " * 30000), (5, rows[5][1])]
    got = Q.quality_report(documents(rows), label_table(spark, labels + [(9001, None), (9002, 7)])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    rows, labels = corpus(300)
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in Q.quality_report(documents(rows).repartition(n), label_table(spark, l)).collect()) for n, l in ((3, labels), (5, wrong))]
    assert scores[0] == scores[1]


def test_one_class_and_empty(spark, documents):
    rows, labels = corpus(30)
    got = Q.quality_report(documents(rows), label_table(spark, [(i, 1) for i, _ in labels])).collect()
    assert {r.score for r in got} == {0.5}
    assert Q.quality_report(documents([]), label_table(spark, labels)).collect() == []


def test_bradley_terry_recovers_the_order():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, Q.WIDTH))
    true = draw.normal(size=Q.WIDTH)
    y = (x @ true + draw.logistic(size=4000) > -3).astype(int)
    model = Q.fit_bradley_terry(x, y, float((y == 0).mean()), 50_000, 1)
    assert np.corrcoef(model.weights, true)[0, 1] > 0.98
    assert abs((model.score(x) < 0.5).mean() - (y == 0).mean()) < 0.005


def test_features_do_not_depend_on_slices():
    texts = ["A b. C", None, "", "x|y | z\nx|y | z", "ÄÖ ü 12"]
    whole = np.concatenate([x for _, x in Q.text_features(pa.array(texts, pa.string()))])
    single = np.concatenate([x for t in texts for _, x in Q.text_features(pa.array([t], pa.string()))])
    assert whole == pytest.approx(single)


def plain_features(text):
    """One text's features by plain loops."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    lines = [line for line in data.split(b"\n") if line]
    shares = [math.sqrt(sum(data.count(bytes([c])) for c in group) / max(1, len(data))) for group in Q._GROUPS]
    if not words:
        return [*shares, *[0.0] * 10]
    sizes, different = [len(w) for w in words], len(set(words))
    mean = sum(sizes) / len(sizes)
    plain = rb"[0-9A-Za-z\x80-\xff]"
    following = [data[at : at + 2] for at in (m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))]
    return [
        *shares, math.log1p(len(words)), mean, math.sqrt(sum((n - mean) ** 2 for n in sizes) / len(sizes)), math.log(max(sizes)),
        different / len(words), math.log1p(len(words) / different), sum(not re.match(plain, w[-1:]) for w in words) / len(words),
        sum(re.fullmatch(rb"[A-Z]{2}", two) is not None for two in following) / len(words),
        len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines))),
    ]


def test_scores_equal_plain_code(spark, documents):
    rows, labels = corpus(300, seed=4)
    rows += [(9000, None), (9001, ""), (9002, "É  Ü\tA1\nA1\n\nA1 XY?"), (5, "alpha BETA"), (5, "alpha BETA"), (6, rows[6][1]), (None, "x")]
    labels += [(9000, 0), (9001, 0), (9002, 1), (6, 0), (7, labels[7][1]), (777_777, 1), (None, 1)]
    docs, table = documents(rows).repartition(3), label_table(spark, labels)
    model = Q.fit_quality(docs, table)
    features = {text: plain_features(text) for _, text in rows}

    def strength(text):
        z = [min(6, max(-6, (f - c) / s)) for f, c, s in zip(features[text], model.center, model.scale)]
        return sum(a * b for a, b in zip(z, model.weights))

    # the threshold: all labelled rows that are not held out, each as often as it stands
    learned = [
        (strength(text), y) for doc, text in rows for other, y in labels
        if doc == other and doc is not None and zlib.crc32(str(doc).encode()) % 3 != 1
    ]
    zeros, order = sum(y == 0 for _, y in learned), sorted(v for v, _ in learned)
    assert model.threshold == pytest.approx((order[zeros - 1] + order[zeros]) / 2)
    want = sorted((str(doc), 1 / (1 + math.exp(model.threshold - strength(text)))) for doc, text in rows)
    got = sorted((str(r.doc_id), r.score) for r in Q.quality_report(docs, table).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9)


def test_weights_are_the_optimum_of_all_pairs(spark, documents):
    rows, labels = corpus(240, seed=5)
    model = Q.fit_quality(documents(rows), label_table(spark, labels), pairs=400_000)
    good, bad = [
        np.array([plain_features(t) for (i, t), (_, y) in zip(rows, labels) if y == label and zlib.crc32(str(i).encode()) % 3 != 1])
        for label in (1, 0)
    ]
    z = [np.clip((v - model.center) / model.scale, -6, 6) for v in (good, bad)]
    difference = (z[0][:, None, :] - z[1][None, :, :]).reshape(-1, Q.WIDTH)
    weights = np.zeros(Q.WIDTH)
    for _ in range(40):
        p = 1 / (1 + np.exp(-difference @ weights))
        gradient = (difference * (1 - p)[:, None]).mean(axis=0) - 1e-3 * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + 1e-3 * np.eye(Q.WIDTH)
        weights += np.linalg.solve(curve, gradient)
    assert np.abs(model.weights - weights).max() < 0.05 * np.abs(weights).max()


def test_repeated_ids_do_not_outgrow_the_sample(spark, documents, monkeypatch):
    rows, labels = corpus(400, seed=6)
    hot = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    rows += [(hot, f"{rows[i % 400][1]} {i}") for i in range(4000)] + [rows[hot]] * 500
    seen = []
    fit = Q.fit_bradley_terry
    monkeypatch.setattr(Q, "fit_bradley_terry", lambda x, y, *rest: seen.append((len(y), rest[-1].sum())) or fit(x, y, *rest))
    Q.fit_quality(documents(rows), label_table(spark, labels * 3), most_rows=100)
    assert 0 < seen[0][0] < 2 * 150
