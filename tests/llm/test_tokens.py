import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("metricloom.llm")
from metricloom.llm.pieces import PieceEncoder  # noqa: E402
from metricloom.llm.queries import queries, tokenizer_path  # noqa: E402
from metricloom.llm.token_blocks import pack, read_token_blocks, token_blocks, unpack, write_token_blocks  # noqa: E402
from metricloom.llm.token_counts import frequent_pieces, token_counts  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


EDGES = ["", " ", "\n", "a", "a b", " a b", "a  b", "a\n\nb", "a\n b", "a b\n", "\ta b", "a\tb c", "a <|endoftext|> b", "don't  x", "ü\r\nz", "1 2 3\n4", "\x1cfoo bar",
         "日本語 テキスト", "é x", "Élan, naïve! don't_ 12,5 %", "word### x%%%", "foo.\nBar baz,\nQux", "a b  c", "x" * 5000, "Ünïcode İ ǅ ǆ"]


def test_pieces_equal_the_library(library):
    enc, counter = PieceEncoder(tokenizer_path()), PieceEncoder(tokenizer_path(), lengths_only=True)
    want = [library.encode(t, add_special_tokens=False).ids for t in EDGES]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(EDGES)] == want
    assert counter.encode(EDGES) == [len(w) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcDE éßñ\n\t .,'!12_|<> 　😀"), max_size=60))
def test_any_text_equals_the_library(text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(_ENC.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


_ENC = PieceEncoder(tokenizer_path(), cap=40)  # a small cache changes its generation all the time


def test_other_tokenizers_go_to_the_library_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = ["Hello  World", "", "a\nb"]
    assert PieceEncoder(path, lengths_only=True).encode(texts) == [len(lib.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=700), st.sampled_from([1, 7, 64, 256]), st.sampled_from([0.5, 0.95, 1.0]))
def test_blocks_round_trip(ids, block, covered):
    x = np.array(ids, np.uint32)
    raw = pack(x, block, covered)
    assert (unpack(raw) == x).all() and (unpack(raw, 1, 2) == x[block : 2 * block]).all()
    assert len(unpack(raw, 5, 5)) == 0


def test_not_a_segment():
    with pytest.raises(ValueError):
        unpack(b"\0" * 16)


def _documents(spark):
    rows = [(5, "five words are in here", 1), (None, "no id", 2), (1, None, 3), (2, "", 4), (3, "same", 5), (3, "same", 5), (4, "long " * 30_000, 6), (-7, "a  b", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").selectExpr("*", "doc_id AS n_tokens", "text AS shard")


def test_token_blocks_edges(spark, library, tmp_path):
    docs = _documents(spark)
    path = str(tmp_path / "blocks")
    write_token_blocks(docs, path, tokenizer_path(), 2, segment_ids=50)
    got = sorted(map(tuple, read_token_blocks(spark, path).collect()), key=lambda r: r[1])
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at, want = 0, []
    for r in order:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_blocks(docs.limit(0), tokenizer_path(), 2).collect() == []


def test_token_counts_edges(spark, library):
    docs = _documents(spark)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, tokenizer_path(), limit=3).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), n(r.text), n(r.text) > 3) for r in docs.collect())
    assert token_counts(docs.limit(0), tokenizer_path()).collect() == []


def test_sentencepiece_counts(spark):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "ünï\ncode")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, model).collect()} == {1: len(lib.encode("Hello world")), 2: 0, 3: len(lib.encode("ünï\ncode"))}


def test_frequent_pieces_are_the_frequent_ones(spark):
    docs = spark.createDataFrame([(" ".join(["often"] * 50 + [f"w{k}x{j}" for j in range(40)]),) for k in range(40)], "text string")
    assert "often" in frequent_pieces(docs, keep=5) and len(frequent_pieces(docs, keep=5)) <= 5


def test_queries_against_the_library(spark, sf, library):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    at, want = 0, {}
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op1_token_blocks"](spark, sf).collect()} == want
    counts = {r.doc_id: r for r in queries()["op8_token_counts"](spark, sf).collect()}
    assert all((counts[d].n_tokens, counts[d].over_limit, counts[d].n_bytes) == (want[d][1] - 1, want[d][1] - 1 > 1024, len((t or "").encode())) for d, t in docs)
