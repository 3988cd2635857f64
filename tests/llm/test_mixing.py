import random

import pytest

from relevia.llm import mixing as M


def brute_targets(totals, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((n for n in totals if n is not None), key=lambda n: n.encode()) + [n for n in totals if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, total, full = {}, share * sum(totals.values()), set()
    while True:
        left = total - sum(most * totals[n] for n in full)
        open_ = sum(weight[n] for n in names if n not in full)
        target = {n: most * totals[n] if n in full else left * weight[n] / open_ for n in names}
        above = {n for n in names if n not in full and target[n] > most * totals[n] + 1e-9}
        if not above:
            return target
        full |= above


def make(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")


def rows_of(seed, n, names):
    draw = random.Random(seed)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 3, 10, 40])), draw.choice(names)) for i in range(n)]
    return rows + [(None, "a b", "x"), (None, None, "x"), (3, "a b c", "x"), (3, "a b c", "x"), (4, "x", None), (5, "\t y\n z", "Z")]


@pytest.mark.parametrize("chunk_rows,fan_in", [(2, 2), (16, 3), (1024, 64)])
def test_targets_and_words(spark, monkeypatch, chunk_rows, fan_in):
    rows = rows_of(1, 400, ["hot"] * 6 + ["b", "c", "é", "x"])
    make_copies = M.pivotal_copies
    monkeypatch.setattr(M, "pivotal_copies", lambda s, seed: make_copies(s, seed, chunk_rows, fan_in))
    got = M.mix(make(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    target = brute_targets(size)
    taken, largest = dict.fromkeys(size, 0), dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in size:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6
    again = M.mix(make(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rounding_keeps_expectation():
    sizes, masses = [3, 10, 1, 7, 4], [1.5, 2.5, 0.4, 6.0, 1.6]
    total = [0] * 5
    for seed in range(4000):
        taken, left, mass = M.round_masses(sizes, masses, [1, 2, 3, 4, 5], seed)
        for i, t in enumerate(taken):
            total[i] += sizes[i] * t
        if left is not None:
            total[left] += mass
        sums = sum(s * t for s, t in zip(sizes, taken)) + mass * (left is not None)
        assert sums == pytest.approx(12.0)
    assert [t / 4000 for t in total] == pytest.approx(masses, abs=0.2)


def test_empty_and_all_null(spark):
    assert M.mix(make(spark, [])).collect() == []
    got = M.mix(make(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
