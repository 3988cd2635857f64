"""Token encoding, the token files and the separator scan against the library on every text."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from relevia.llm import separator_scan, token_parquet
from relevia.llm.encoder import Encoder, default_vocabulary

ODD = [
    "", None, " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\nb", "don't stop we'll 'something",
    "l'eau c'est–à dire", "a–b.", "été́x.", "naïve “quote” x", "x y", "tab\tx", "12,345.67 foo@bar.com!!",
    "日本語 テキスト。", "a.b", "a\n.b\n9", "###\n%%%", "🙂 ok🙂.", "\x1cx", " \n a", "x'", "Ünïté. Ж", "word " * 30000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [4, 1 << 20])
def test_encoder_equals_library(library, kept, folder):
    texts = ODD + pq.read_table(f"{folder}/documents.parquet").column("text").to_pylist()[:60]
    encoder = Encoder(default_vocabulary(), kept=kept)
    got = []
    for _ in range(2):
        got = [x.tolist() for _, ids, n in encoder.column(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [library(t) for t in texts]


def test_words_are_learned_in_rows(library, monkeypatch):
    words = ["été", "ab", "Ж", "日本語", "naïve", "voilà", "x", "Ünïté", "ſ", "understanding"] * 30
    words = [w * (1 + n % 7) for n, w in enumerate(words)]
    text = "first " + " ".join(words)
    encoder, alone = Encoder(default_vocabulary()), []
    piece = Encoder._piece
    monkeypatch.setattr(Encoder, "_piece", lambda self, word, space: alone.append(word) or piece(self, word, space))
    assert [x for _, ids, _ in encoder.column(pa.array([text])) for x in ids.tolist()] == library(text)
    assert alone == ["first"]


def test_a_token_that_crosses_blanks_forbids_rows(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {c: i for i, c in enumerate(["a", "b", "Ġ", "Ċ", "aĠ", "Ġa", "ab"])}
    tokenizer = Tokenizer(models.BPE(vocabulary, [("a", "Ġ"), ("Ġ", "a"), ("a", "b")]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.save(str(tmp_path / "crossing.json"))
    encoder, text = Encoder(str(tmp_path / "crossing.json")), "ab a a ab ba\na ab"
    assert encoder.opens is None
    assert [x for _, ids, _ in encoder.column(pa.array([text])) for x in ids.tolist()] == tokenizer.encode(text).ids


def expected_index(rows, library):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library(text), 2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, documents, library):
    rows = [(i, t) for i, t in zip(range(3 * len(ODD), 0, -3), ODD)]
    got = token_parquet.write_and_index(documents(rows)).collect()
    assert sorted(map(tuple, got)) == expected_index(rows, library)


def test_token_files_keep_repeats_and_null_ids(spark, documents, library):
    rows = [(5, "same text"), (5, "same text"), (None, "no id"), (1, "a")]
    got = token_parquet.write_and_index(documents(rows)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_index(rows, library)
    assert token_parquet.write_and_index(documents([])).collect() == []


def test_token_file_format(spark, tmp_path, documents):
    rows = [(i, f"word{i % 50} and more text") for i in range(5000)]
    path = token_parquet.write_tokens(documents(rows), str(tmp_path / "t"), layout=token_parquet.Layout(page_rows=100))
    meta = pq.ParquetFile(sorted(glob.glob(path + "/*.parquet"))[0]).metadata.row_group(0)
    doc, tokens = meta.column(0), meta.column(1)
    assert "DELTA_BINARY_PACKED" in doc.encodings
    assert "RLE_DICTIONARY" in tokens.encodings
    assert doc.has_column_index and doc.has_offset_index
    some = token_parquet.read_tokens(spark, path).filter("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in some._jdf.queryExecution().toString()
    assert some.count() == 1


def test_op4_query(spark, folder, library):
    from relevia.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op4_token_output"](spark, folder).collect())) == expected_index(rows, library)


@pytest.mark.parametrize("block_bytes", [2, 64, 1 << 20])
def test_separator_scan(spark, documents, library, tmp_path, block_bytes):
    texts = [t for t in ODD if block_bytes > 2 or len(t or "") < 100]
    rows = list(enumerate(texts))
    path = separator_scan.write_flat(documents(rows).coalesce(2), str(tmp_path / "flat"))
    got = separator_scan.scan_flat(spark, path, block_bytes=block_bytes).orderBy("file", "doc_no").collect()
    assert [r.n_tokens for r in got] == [len(library(t)) + 1 for t in texts]
    assert all(r.ended for r in got)
    for r in got:
        file = np.fromfile(f"{path}/{r.file}", dtype="<u2")
        assert file[r.start + r.n_tokens - 1] == separator_scan.END_ID


def test_separator_scan_open_end_and_empty(spark, tmp_path, documents):
    end = separator_scan.END_ID
    np.array([1, 2, end, end, 5, 6, 7], dtype="<u2").tofile(tmp_path / "a.bin")
    np.array([3, end], dtype="<u2").tofile(tmp_path / "b.bin")
    np.array([4, 4, 4], dtype="<u2").tofile(tmp_path / "c.bin")
    np.array([], dtype="<u2").tofile(tmp_path / "d.bin")
    for size in (2, 4, 6, 100):
        got = separator_scan.scan_flat(spark, str(tmp_path), block_bytes=size).orderBy("file", "doc_no").collect()
        assert [tuple(r) for r in got] == [
            ("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 4, 3, False),
            ("b.bin", 0, 0, 2, True), ("c.bin", 0, 0, 3, False),
        ]
    assert separator_scan.count_tokens(documents([])).collect() == []


def test_op2_query(spark, folder, library):
    from relevia.llm.queries import QUERIES

    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    got = QUERIES["op2_token_counts"](spark, folder).orderBy("file", "doc_no").collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library(t)) + 1 for t in texts)


NAMED = ["<|endoftext|>", "a<|endoftext|>b", "x  <|endoftext|>\n<|endoftext|><|endoftext|> é", " <|endoftext|> end", "no name"]


def test_name_of_the_end_id_is_ordinary_text(spark, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_vocabulary())
    plain.encode_special_tokens = True
    want = [plain.encode(t, add_special_tokens=False).ids for t in NAMED]
    assert not any(separator_scan.END_ID in ids for ids in want)
    encoder = Encoder(default_vocabulary(), literal=True)
    got = [x.tolist() for _, ids, n in encoder.column(pa.array(NAMED)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want
    counts = separator_scan.count_tokens(documents(list(enumerate(NAMED))).coalesce(1)).orderBy("file", "doc_no").collect()
    assert [r.n_tokens for r in counts] == [len(ids) + 1 for ids in want]
    assert all(r.ended for r in counts)
