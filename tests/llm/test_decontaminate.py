import hashlib
import random
import re

import pytest

from relevia.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            size = min(len(v), window)
            runs = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in runs:
                    hit.update(range(k, k + size))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def make_items(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hits string")


@pytest.mark.parametrize("letters,window,block_words", [("ab", 4, 10_000), ("ab", 10, 12), ("abcdé", 3, 20)])
def test_equals_brute_force(spark, documents, letters, window, block_words):
    draw = random.Random(window)
    text = lambda n: "".join(draw.choice(letters) + draw.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(draw.randrange(1, 16))) for i in range(12)] + [(40, None), (41, ""), (42, "!!"), (43, "a B a"), (44, "a B a")]
    docs = [(i, text(draw.randrange(40))) for i in range(40)] + [(50, None), (51, ""), (52, "..."), (53, items[0][1].upper())]
    docs += [(54, "a " * 20000), (54, "a " * 20000)]
    got = D.contamination_report(documents(docs), make_items(spark, items), window=window, block_words=block_words).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, items, window))


def test_no_items_and_no_documents(spark, documents):
    got = D.contamination_report(documents([(1, "a b")]), make_items(spark, [])).collect()
    assert tuple(got[0]) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert D.contamination_report(documents([]), make_items(spark, [(1, "a")])).collect() == []


def test_remove_spans(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Clean start, {passage.upper()}! And a clean end of more words than the passage has in all of it."),
            (2, passage), (3, "nothing here"), (4, None), (5, f"{passage} x {passage} and " + "y " * 60)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "a") for i, t in rows], "doc_id long, text string, n_chars int, hits string")
    got = {r.doc_id: r for r in D.remove_spans(docs, make_items(spark, [(9, passage)])).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text == "Clean start, ! And a clean end of more words than the passage has in all of it."
    assert got[1].n_chars == len(got[1].text) and got[1].hits == "a"
    assert got[5].text == " x  and " + "y " * 60
    assert got[3].text == "nothing here" and got[4].text is None and got[4].n_chars is None
