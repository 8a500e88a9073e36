"""Source divergence against a plain version with Python's whole numbers, and against its SQL."""

import collections
import glob
import os
import random
import re

import duckdb
import pytest

from folio.llm import divergence, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, min_docs=10, top=10):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in rows]
    seen, n = collections.Counter(), collections.Counter()
    for terms, lang, source in docs:
        seen.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for (x, t), k in seen.items() if x == lang and k >= min_docs]
        sources = sorted({d[2] for d in docs if d[1] == lang})
        of = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts.values()) + 2 * len(kept)) for t in kept}
        counts = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: of(counts[s]) for s in sources}
        q = of({t: sum(counts[s][t] for s in sources) for t in kept})
        for s in sources:
            ranked = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(ranked)]
            ranked = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows, schema="text string, lang string, source string", **more):
    return sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, schema).repartition(3), **more).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    terms = [a + b for a in ("the", "Über", "zug", "日本", "été", "prefix" * 9) for b in "abcdefghijklmnopqrstuvwxyzéß語🎉"] + ["prefix", "prefi", "a", "é"]
    out = [(" ".join(rng.choices(terms, k=rng.randrange(1, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "ü", None])) for _ in range(300)]
    out += [(" ".join(f"tie{k:03d}" for k in range(90)) + " tie tié ti", "en", "s1")] * 12  # many terms of one value
    return out + [(None, "fr", "s1"), ("", "fr", "s2"), ("one two", "fr", None), ("12 .. 34", "xx", "alone"), ("a-b_c9d\tE" * 50, "en", "s9")]


def test_against_plain(spark, rows, monkeypatch):
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, broadcast_groups=0) == want
    monkeypatch.setattr(divergence, "STEP_BYTES", 300)
    monkeypatch.setattr(divergence, "STEP_PAIRS", 7)
    assert found(spark, rows, top=3, min_docs=12) == plain(rows, 12, 3)


def test_edge_cases(spark):
    assert found(spark, []) == []
    assert found(spark, [("word " * 30, None, None)]) == []
    clashing = [("w x", "en", s, 1, "z") for s in ("a", "b") for _ in range(10)]
    assert found(spark, clashing, "text string, lang string, source string, value int, TERM string") == plain([r[:3] for r in clashing])


def test_radix_top_reads_values_whole(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), f"{'same' * 5}{k}", rng.choice([0, 1, 5, 1 << 14, 1 << 15, (1 << 30) - 1, rng.randrange(1 << 30)])) for k in range(900)]
    got = divergence.radix_top(spark.createDataFrame(rows, "g string, item string, value long"), ["g"], 200).collect()
    want = [r for g in "ab" for r in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1].encode()))[:200]]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_query_matches_sql(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(f"select {', '.join(COLUMNS)} from ({queries.ORACLE_SQL['op13_source_divergence']})").fetchall()
    assert len(want) > 100 and sorted(tuple(r) for r in queries.op13_source_divergence(spark, SF).select(*COLUMNS).collect()) == sorted(want)
