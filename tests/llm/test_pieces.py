import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from relevia.llm import pieces as P

TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  a  b ", "one two three", "tab\tand\nline\r\n end", "été ça ﬁne Å é",
    "日本語 テスト ｱｲｳ ①②", "emoji 👩‍👩‍👧 x 😀😀", "▁ ▁▁x▁ y", "a▁b  ▁c", "<s> </s> <unk> <0x41>", "word" * 3000, "w " * 5000,
    " nbsp em　wide", "\x00\x01\x7f", "x" * 40 + " " * 40 + "y", "¨ ½ ﷺ", "1234567890 12.5%", "é ö", "​zero﻿width",
]


def mixed(count):
    draw = random.Random(count)
    alphabet = ["the", "ing", " ", "  ", "\n", "é", "日", "😀", "▁", "A", "ﬁ", "\t", ".", "́", "42", " "]
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(count)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


@pytest.fixture(scope="module")
def folding(tmp_path_factory):
    """The public pieces behind a compiled map that folds characters, with blanks squeezed."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(P.default_model(), "rb") as file:
        proto.ParseFromString(file.read())
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_normalizer_spec())
    assert len(spec.precompiled_charsmap) > 1000
    proto.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path_factory.mktemp("model") / "folding.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def same_as_library(path, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = P.PieceEncoder(path)
    at = 0
    for found in encoder.column(pa.array(texts, pa.string())):
        stops = np.cumsum(found.counts)
        decoded = encoder.decoded(found.ids, found.counts)
        for k, (stop, count) in enumerate(zip(stops.tolist(), found.counts.tolist())):
            text = texts[at] or ""
            part = slice(stop - count, stop)
            proto = library.encode(text, return_type="proto")
            ids = found.ids[part].tolist()
            assert ids == [p.id for p in proto.pieces], text
            spans = [(p.begin, p.end) for p in proto.pieces]
            assert list(zip(found.start[part].tolist(), found.end[part].tolist())) == spans, text
            assert decoded[k].decode() == library.decode(ids), text
            at += 1
    assert at == len(texts)


def test_equals_the_library():
    same_as_library(P.default_model(), TEXTS + mixed(400))


def test_equals_the_library_with_a_character_map(folding):
    same_as_library(folding, TEXTS + mixed(400))


def test_chunk_table_starts_anew(monkeypatch):
    monkeypatch.setattr(P, "KEPT_CHUNKS", 3)
    encoder = P.PieceEncoder(P.default_model())
    one = [p.ids.tolist() for p in encoder.column(pa.array(["a b c d e f"]))]
    two = [p.ids.tolist() for p in encoder.column(pa.array(["g h", "a b c d e f"]))]
    assert two[0][-len(one[0]) :] == one[0]


def test_decode_of_any_ids(library):
    draw = random.Random(2)
    encoder = P.PieceEncoder(P.default_model())
    runs = [[], [1, 2], [0], [300, 301], [200, 13, 259], [29871, 29871]]
    runs += [[draw.randrange(32_000) for _ in range(draw.randrange(1, 12))] for _ in range(300)]
    runs += [[draw.randrange(3, 259) for _ in range(4)] + [300] for _ in range(50)]
    flat = np.array([i for r in runs for i in r])
    got = encoder.decoded(flat, np.array([len(r) for r in runs]))
    assert [t.decode() for t in got] == [library.decode(r) for r in runs]


def test_invalid_utf8(library):
    raw = [b"ok \xff\xfe bad \xe2\x82", b"\xe2\x96\x81\x80x", b"\xc0\xafy"]
    column = pa.Array.from_buffers(
        pa.string(), 3, [None, pa.py_buffer(np.cumsum([0, *map(len, raw)]).astype(np.int32)), pa.py_buffer(b"".join(raw))]
    )
    encoder = P.PieceEncoder(P.default_model())
    found = next(iter(encoder.column(column)))
    stop = np.cumsum(found.counts).tolist()
    got = [found.ids[a:b].tolist() for a, b in zip([0, *stop], stop)]
    assert got == [library.encode(r) for r in raw]
    assert found.end[[s - 1 for s in stop]].tolist() == [len(r) for r in raw]


def test_round_trip_of_a_table(spark, documents, library):
    texts = TEXTS + mixed(60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    got = P.round_trip(documents(rows).repartition(3)).collect()
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        size = len((text or "").encode())
        expected.append((doc, len(ids), *digest, size, size))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert P.round_trip(documents([])).collect() == []


def test_encode_and_decode_tables(spark, documents, library):
    rows = [(1, "été  x▁y"), (2, None), (3, "plain text")]
    encoded = P.encode_pieces(documents(rows))
    for r in encoded.collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.ids == library.encode(text)
        assert b"".join(text.encode()[a:b] for a, b in zip(r.starts, r.ends)) == text.encode()
    assert {r.doc_id: r.text for r in P.decode_pieces(encoded).collect()} == {1: "été  x y", 2: "", 3: "plain text"}
