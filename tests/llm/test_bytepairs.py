"""Byte-level BPE against the library of its vocabulary, and its stated edge cases."""

import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import bytepairs, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return bytepairs.load_ranks()


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice("ab cdeé日本🎉\n\t 12.,'st—　\x1c") for _ in range(rng.randrange(200))) for _ in range(300)]
    out += ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(900))) for _ in range(60)]
    return out + ["", " ", "  ", "a ", " a", "a  b ", "\n", "a\n b", "a\n \nb", "\x1c a", "a\x1c b", "<|endoftext|>", "a" * 5000, "ab" * 3000, "日本語" * 2000, " " * 3000, "don't you'll"]


def cut(ids, counts):
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_as_the_library(model, library, texts):
    encoder = bytepairs.Encoder(model)
    for step in (7, len(texts)):
        found = [x for lo in range(0, len(texts), step) for x in cut(*encoder.encode(pa.array(texts[lo : lo + step])))]
        assert found == [library.encode_ordinary(t) for t in texts]


def test_long_and_short_matches_merge_alike(model, texts, monkeypatch):
    words = [t.encode() for t in texts if t]
    ids, n = model.encode_words(words)
    monkeypatch.setattr(bytepairs, "LONG_PAIRS", 0)
    one, m = model.encode_words(words)
    assert ids.tolist() == one.tolist() and n.tolist() == m.tolist()


def test_a_store_that_forgets(model, library, texts, monkeypatch):
    monkeypatch.setattr(bytepairs, "HELD_WORDS", 20)
    encoder = bytepairs.Encoder(model)
    for lo in range(0, len(texts), 9):
        assert cut(*encoder.encode(pa.array(texts[lo : lo + 9]))) == [library.encode_ordinary(t) for t in texts[lo : lo + 9]]


def test_listed_merges_only(texts):
    model = bytepairs.load_merges(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert cut(*bytepairs.Encoder(model).encode(pa.array(texts))) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_byte_must_be_a_token():
    with pytest.raises(KeyError):
        bytepairs.make_pairs({b"a": 0, b"b": 1, b"ab": 2}, [(0, 1, 0, 2)], {})


def test_operator_edge_cases(spark, model, library):
    rows = [(1, "the same text", "x"), (1, "the same text", "x"), (2, None, "y"), (3, "", "z"), (None, "null  id\n\n text ", "n"), (4, "word " * 40_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(2)
    got = sorted(((r.doc_id, r.text, r.ids, r.n_tokens, r.decoded) for r in bytepairs.decode(bytepairs.encode(docs, model), model).collect()), key=str)
    want = [(i, t, None if t is None else library.encode_ordinary(t), len(library.encode_ordinary(t or "")), None if t is None else bytearray(t.encode())) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert bytepairs.decode(bytepairs.encode(docs.limit(0), model), model).count() == 0
    odd = spark.createDataFrame([(1, [None, 1 << 30, 64, -5]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in bytepairs.decode(odd, model).orderBy("k").collect()] == [bytearray(model.surface[64]), None, bytearray()]


def test_query_on_whole_table(spark, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    found = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_pairs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(docs) == len(found)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text)
        assert found[doc_id] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
