"""Cross-tokenizer alignment against a plain version on the tokenizers' own libraries, and its stated edge cases."""

import collections
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import alignment, bytepairs, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    return bytepairs.load_merges(alignment.SIDE_A), alignment.load_side()


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        byte_of = {c: b for b, c in bytepairs.byte_alphabet().items()}
        self.a_bytes = {k: bytes(byte_of[c] for c in t) for t, k in self.a.get_vocab().items() if all(c in byte_of for c in t)}

    def b_bytes(self, k):
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """Groups of (A ids, B ids) and links."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sa, sb = [self.a_bytes[k] for k in a], [self.b_bytes(k) for k in b]
        if b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
            return [], []
        groups, links, i, j, x, y = [([], [])], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = x + len(sa[i]), y + len(sb[j])
            if end_a <= end_b:
                groups[-1][0].append(a[i])
            if end_b <= end_a:
                groups[-1][1].append(b[j])
            if end_a <= end_b:
                x, i = end_a, i + 1
            if end_b <= end_a:
                y, j = end_b, j + 1
            if end_a == end_b:
                groups.append(([], []))
        return groups[:-1], links

    def rows(self, docs):
        """(doc_id, measures, groups) of (doc_id, text)."""
        found = [(k, *self.groups(t)) for k, t in docs]
        count = collections.Counter(x for _, _, links in found for x in links)
        top = collections.defaultdict(int)
        for (_, b), n in count.items():
            top[b] = max(top[b], n)
        out = []
        for k, groups, links in found:
            told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), told))
        return out, count, top


COLUMNS = ("doc_id", *alignment.MEASURES, "groups")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(k, "".join(rng.choice(["the ", "Word", "ing ", "é", "日本", "🎉", "\n", "  ", " a", "x1.", "—", "\t", "st"]) for _ in range(rng.randrange(60)))) for k in range(150)]
    odd = ["", " ", "  ", "a ", " a", "a  b ", "\n", "a\n b", "▁x", "x▁ y", "<s> </s> <unk> <|endoftext|>", "ﬁ ① é", "a\0b", "\x1c a", "word " * 3000, "z" * 4000, None, "twice told", "twice told"]
    return out + [(200 + k, t) for k, t in enumerate(odd)] + [(None, "null id"), (201, "repeated id")]


def test_against_plain(spark, sides, rows):
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, extra string, RUN int").repartition(3)
    found = alignment.align(docs, *sides)
    assert found.columns == ["doc_id", "extra", "RUN", *alignment.MEASURES, "groups"]
    want, _, _ = Plain().rows(rows)
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str) == sorted(want, key=str)


def test_many_runs_stripes_and_slices(spark, sides, rows, monkeypatch):
    for name, value in (("RUN_BYTES", 2000), ("STEP_BYTES", 500), ("RUN_SEGMENTS", 40), ("GROUPS_A_TASK", 1)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = alignment.align(docs, *sides, stripe_bytes=1 << 30, slice_pairs=100)
    want, count, top = Plain().rows(rows)
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str) == sorted(want, key=str)
    pairs = alignment.pair_counts(docs, *sides, stripe_bytes=1 << 30)
    assert {tuple(r) for r in pairs.collect()} == {(a, b, n, n == top[b]) for (a, b), n in count.items()}


def test_empty_and_clashing(spark, sides):
    none = spark.createDataFrame([], "doc_id long, text string, n_A long, groups int")
    out = alignment.align(none, *sides)
    assert out.count() == 0 and out.columns == ["doc_id", *alignment.MEASURES, "groups"]
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(nulls, *sides).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_on_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, _, _ = Plain().rows(docs)
    found = queries.op11_alignment(spark, SF)
    got = sorted(tuple(r) for r in found.select("doc_id", *alignment.MEASURES, "groups_sha256").collect())
    assert got == sorted((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in want)
    assert found.where(F.col("n_links") > 0).count() > 0
