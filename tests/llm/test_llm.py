"""The training-data operators against plain versions, and their stated edge cases, on small tables."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import components, langid, lines, mixing, pieces, pii, quality, queries, resample, simhash, storage, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, ids string"
WORDS = [f"w{chr(97 + k % 26)}{k}" for k in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = prose(rng, 120)
    out = [(1, base), (2, base), (3, base.replace(base.split()[60], "other", 1)), (4, None), (5, ""), (6, "  \n\t\n "), (7, "one two"), (8, "line a\nLINE A \nx\n\nline a")]
    out += [(20 + k, f"{prose(rng, 40)}\n Shared Line \n{prose(rng, 12)}") for k in range(12)]
    out += [(40, prose(rng, 30_000)), (None, "null id text of some words"), (41, out[9][1]), (41, out[9][1]), (42, "ä ö ü 日本語 🎉 ▁ x" * 5)]
    return [(i, t, "en" if (i or 0) % 2 else "de", None if i == 7 else f"s{(i or 0) % 3}", len(t or ""), "clash", "clash") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, rows, docs, empty):
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] is None, r[0] or 0, f"{plain_fingerprint(r[1]):016x}") for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == want
    prints = [int(r.fingerprint, 16) for r in got]
    group = list(range(len(got)))
    for _ in got:
        for i in range(len(got)):
            group[i] = min(group[j] for j in range(len(got)) if (prints[i] ^ prints[j]).bit_count() <= 4)
    members = collections.defaultdict(list)
    for r, g in zip(got, group, strict=True):
        members[g].append(r)
    for own in members.values():
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert {r.component_id for r in own} == {min(ids) if ids else None}
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(members) and 2 not in ids and ids.count(41) <= 1


@pytest.mark.parametrize("rows", [(8_192, 1 << 17), (200, 1 << 17), (200, 90)])
def test_near_edges_find_all_components(spark, rows):
    rng = np.random.default_rng(3)
    far = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    centre = far[0]
    near = np.array([np.uint64(int(centre) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 9))))) for _ in range(700)])
    fps = np.unique(np.concatenate([far, near, far[:200] ^ np.uint64(0b1011)]))
    edges = simhash.near_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3), len(fps), 512, *rows)
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    label = np.arange(len(fps))
    links = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for _ in range(60):
        new = np.array([label[row].min() for row in links])
        if (new == label).all():
            break
        label = new
    want = collections.defaultdict(set)
    for x, k in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        want[k].add(x)
    have = collections.defaultdict(set)
    for x in fps.view(np.int64).tolist():
        have[got.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


@pytest.mark.parametrize("bytes_", [lines.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(spark, rows, docs, empty, bytes_, keep_first):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    docs_of, first = collections.Counter(), {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            docs_of[k] += 1
            if r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    got = lines.dedup_lines(docs, min_docs=10, keep_first=keep_first, broadcast_bytes=bytes_)
    assert sorted(got.columns) == sorted({*docs.columns, "n_dropped"})
    want = []
    for r in rows:
        own, kept, saved = (r[1] or "").split("\n"), [], set()
        for x in own:
            k = key(x)
            if k and docs_of[k] >= 10:
                if not (keep_first and first.get(k) == r[0] and k not in saved):
                    continue
                saved.add(k)
            kept.append(x)
        want.append((r[0] or -1, "\n".join(kept), len(own), len(own) - len(kept)))
    assert sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(want)
    assert lines.dedup_lines(empty, broadcast_bytes=bytes_).count() == 0


def test_two_filters_miss_no_repeat():
    rng = np.random.default_rng(5)
    own = lines.TwoFilters(1 << 12)
    a, b = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    own.add(a)
    own.add(np.concatenate([b, a[:50], b[:10]]))
    assert lines.has(own.twice, a[:50], own.bits).all() and lines.has(own.twice, b[:10], own.bits).all()
    assert lines.has(own.twice, a[50:], own.bits).mean() < 0.5


def brute_links(data):
    x = {k: np.array(v, float) for k, (v, _) in data.items()}
    out = collections.defaultdict(set)
    for a in data:
        for b in data:
            if a != b and data[a][1] == data[b][1] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93:
                out[a].add(b)
    return out


@pytest.mark.parametrize("passes", [0, vectors.FULL_PASSES])
def test_vectors(spark, passes):
    rng = np.random.default_rng(6)
    data = {k: (rng.standard_normal(16).tolist(), k % 2) for k in range(300)}
    centre = rng.standard_normal(16)
    data |= {300 + k: ((centre + 0.08 * rng.standard_normal(16)).tolist(), 1) for k in range(200)}
    data |= {600 + k: (data[k][0], data[k][1]) for k in range(40)} | {700: (data[0][0], 1), 701: ((2 * np.array(data[4][0])).tolist(), 0)}
    odd = [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] * 16, 1), (803, [1.0, None], 1), (804, data[0][0], None), (None, data[0][0], 0), (805, [], 0), (806, [1.0, 2.0], 0), (807, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(k, v, y) for k, (v, y) in data.items()] + odd, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r.vec_id: r for r in vectors.near_vectors(df, full_passes=passes).collect()}
    want = brute_links(data)
    assert len(got) == len(data) + len(odd)
    assert all(got[k].n_links == len(want[k]) for k in data)
    seen = {}
    for k in sorted(data):
        todo = [k] if k not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = k
                todo += want[x]
    assert all(got[k].component_id == seen[k] and got[k].kept == (seen[k] == k) for k in data)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (800, 801, 802, 803, 804, 805))
    assert got[806].n_links == 1 and got[807].component_id == 806 and got[None].n_links == 0 and not got[None].kept
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("passes", [0, vectors.FULL_PASSES, 60])
def test_vectors_of_a_concentrated_label(spark, passes):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.standard_normal(64)) * 0.8**0.5 + 0.2**0.5 * unit(rng.standard_normal((2_000, 64))))
    across = rng.standard_normal((400, 64))
    across = unit(across - (across * x[:400]).sum(1, keepdims=True) * x[:400])
    x = np.concatenate([x, 0.932 * x[:400] + (1 - 0.932**2) ** 0.5 * across])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)] + [(9_000, [1.0, 2.0], 1), (9_001, [2.0, 4.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df, full_passes=passes).collect()}
    links = x @ x.T >= vectors.COSINE
    want = links.sum(1) - 1
    share = sum(got[k].n_links for k in range(len(x))) / want.sum()
    assert got[9_001].component_id == 9_000 and want.sum() >= 800 and all(got[k].n_links <= want[k] for k in range(len(x)))
    assert share == 1 if passes == 0 else share >= 0.95


@pytest.mark.parametrize("part", [8, 1_024])
def test_full_edges_in_parts(spark, part):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + 0.25 * rng.standard_normal((15, 8)) for c in 2 * rng.standard_normal((8, 8))])
    rows = [(k, k % 2, 60, 1, x[k].tolist()) for k in range(120)]
    members = spark.createDataFrame(rows, "rid long, component long, n_members long, copies long, vector array<double>")
    edges = [(r.a, r.b) for r in vectors.full_edges(members, part_rows=part).collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.arange(120)[:, None] % 2 == np.arange(120) % 2)

    def groups(pairs):
        at = list(range(120))
        for a, b in pairs:
            old, new = at[a], at[b]
            at = [new if v == old else v for v in at]
        return {frozenset(k for k in range(120) if at[k] == v) for v in at}

    assert groups(edges) == groups(np.argwhere(linked)) and all(a % 2 == b % 2 for a, b in edges)


@pytest.mark.parametrize("part", [8, 1_024])
def test_exact_links_in_parts(spark, part):
    rng = np.random.default_rng(7)
    x = rng.standard_normal(8) + 0.25 * rng.standard_normal((60, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    members = spark.createDataFrame([(k, 0 if k < 50 else 50, 50 if k < 50 else 10, 1 + k % 3, x[k].tolist()) for k in range(60)], "rid long, component long, n_members long, copies long, vector array<double>")
    got = {r.rid: r.n_other for r in vectors.exact_links(members, part_rows=part).collect()}
    links = u @ u.T >= 0.93
    for k in range(60):
        group = range(50) if k < 50 else range(50, 60)
        assert got[k] == sum(1 + j % 3 for j in group if j != k and links[k, j])


def test_pii(spark, empty):
    luhn = "4539 1488 0343 6467"
    texts = [
        (1, f"write to a.b@c-d.example.org, or x@y.z_w@q.r! card {luhn} and 4539148803436468"), (2, "1.2.3.4 999.1.1.1 0001.2.3.255.7.8.9.10.11"),
        (3, "+1 (803) 555-5351 and +12 and + 5"), (4, None), (5, ""), (6, "IBAN DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00"),
        (7, "é🎉 a@b.c " * 300), (8, "9" * 20_000), (9, "my ssn is 123-45-6789"), (None, "1.1.1.1"), (10, "a" * 20_000 + "@"), (11, "1 " * 9_000), (11, "1 " * 9_000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = pii.find_pii(df).collect()
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "card": r"[0-9]([\x20-]?[0-9])+"}

    def passes(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    by = {r.doc_id: r.spans for r in got}
    assert len(got) == len(texts)
    for i, t in texts:
        if i in (10, 8, 11):  # quadratic for the plain patterns
            continue
        want = [(k, m.start(), m.end()) for k in pii.BASE for m in re.finditer(patterns[k], t or "") if passes(k, m.group())]
        assert [(s.kind, s.start, s.end) for s in by[i] if s.kind in pii.BASE] == want
    assert [s.kind for s in by[6]] == ["iban"] and [s.kind for s in by[9]] == ["ssn"] and by[10] == []
    red = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert red[None] == "[ip]" and red[4] == "" and red[7] == "é🎉 [email] " * 300
    assert pii.find_pii(empty).count() == 0


def test_quality(spark, rows, docs, empty):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        kept = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if n[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        r = by[(i, len(words))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(kept) - len(set(kept)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and (not r.base_failed or not r.kept)
    assert quality.quality_rules(empty).count() == 0
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.5, 0.5])
    assert abs(quality.js_distance(p, q)[0] - np.sqrt(0.5)) < 1e-12 and quality.js_distance(p, p[0])[0] == 0


def test_mixing_targets(spark):
    sizes = [("a", 100), ("b", 900), ("ä", 50), ("c", 10), (None, 400), ("", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2.0 * n for s, n in sizes}
    left, open_, want = 1.5 * sum(n for _, n in sizes), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    assert all(abs(got[s] - want[s]) < 1e-6 for s in order)


def test_fit_counts():
    rng = np.random.default_rng(8)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 400, 12))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum())))
        taken = mixing.fit_counts(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
        assert (taken >= 0).all() and (taken <= counts).all() and (lengths * taken).sum() == max(sums)
    lengths, counts = np.arange(50, 4000, 7), np.full(565, 40)
    assert (lengths * mixing.fit_counts(lengths, counts, 20_000_001)).sum() == 20_000_001
    assert mixing.fit_counts(np.array([7]), np.array([3]), 13).tolist() == [1]


def test_mixing_ranges_agree(spark):
    docs = spark.createDataFrame([(k if k % 50 else None, "one two three " * (1 + k // 450), "s" if k % 3 else None) for k in range(900)], "doc_id long, text string, source string")
    few, many = mixing.mix_sources(docs, ranked_rows=20).collect(), mixing.mix_sources(docs.repartition(6)).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == 900


def test_mixing(spark, rows, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.times in (0, 1, 2) for r in got)
    assert sorted((r.doc_id or -1, r.times) for r in got) == sorted((r.doc_id or -1, r.times) for r in mixing.mix_sources(docs.repartition(7)).collect())
    per = collections.defaultdict(int)
    for r in got:
        per[(r.source, r.target, r.source_size)] += r.size * r.times
    biggest = max(r.size for r in got)
    assert all(abs(n - t) <= biggest for (_, t, _), n in per.items())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({i: n for i, n in ((i, sum(r.times for r in got if r.doc_id == i)) for i in {r.doc_id for r in got}) if n})
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def plain_viterbi(text, scores, low):
    best = {0: (0.0, None)}
    for k in range(len(text)):
        if k not in best:
            continue
        options = [(n, scores[text[k : k + n]]) for n in range(1, len(text) - k + 1) if text[k : k + n] in scores]
        options += [] if any(n == 1 for n, _ in options) else [(1, low)]
        for n, s in options:
            if k + n not in best or best[k][0] + s > best[k + n][0] + 1e-12:
                best[k + n] = (best[k][0] + s, k)
    return best[len(text)][0]


def test_pieces_against_plain_viterbi():
    rng = np.random.default_rng(9)
    names = sorted({"".join(rng.choice(list("abc "), rng.integers(1, 4))) for _ in range(40)} - {""})
    names = [n for n in names if " " not in n.lstrip(" ")]
    scores = {n: -float(rng.integers(1, 900)) / 100 for n in names}
    surface = [bytes([k]) for k in range(256)] + [b"?"] + [n.encode() for n in names]
    model = pieces.make_pieces(surface, [n.encode() for n in names], list(range(257, 257 + len(names))), list(scores.values()), {k: k for k in range(256)}, 256)
    texts = ["".join(rng.choice(list("abcd é"), rng.integers(0, 40))) for _ in range(200)] + ["ab" * 300, "", " "]
    ids, counts = model.encode([t.encode() for t in texts])
    assert model.decode(ids, counts) == texts
    at = 0
    for t, n in zip(texts, counts, strict=True):
        got = 0.0
        for i in ids[at : at + n]:
            got += scores[names[i - 257]] if i >= 257 else 0.0
        raw = b"".join(bytes([i]) for i in ids[at : at + n] if i < 256)
        got += model.lowest * len(raw.decode())
        at += n
        assert not t or abs(got - plain_viterbi(" " + t, scores, model.lowest)) < 1e-6


def test_pieces_round_trip(spark, rows, docs, empty):
    model = pieces.load_pieces()
    coded = pieces.encode(docs, model)
    assert sorted(coded.columns) == sorted({*docs.columns, "n_ids"})
    for r in pieces.decode(coded, model).collect():
        assert r.decoded == r.text and (r.ids is None) == (r.text is None) and r.n_ids == len(r.ids or ())
    assert pieces.encode(empty, model).count() == 0


def test_double_array():
    keys = [f"{a}{b}".encode() for a in ("", "x", "é", "longer") for b in range(300)]
    trie = pieces.DoubleArray(keys)
    flat = np.frombuffer(b" ".join(keys), np.uint8)
    start, end, key = trie.matches(flat, np.arange(len(flat)), np.full(len(flat), len(flat)))
    found = {(int(s), int(e)): keys[k] for s, e, k in zip(start, end, key, strict=True)}
    assert all(bytes(flat[s:e]) == k for (s, e), k in found.items())
    whole = bytes(flat)
    assert len(found) == sum(whole[s : s + n] in set(keys) for s in range(len(whole)) for n in {len(k) for k in keys} if s + n <= len(whole))


def test_language(spark, empty):
    rng = np.random.default_rng(10)
    vocab = {"aa": ["the", "and", "thing", "other", "this"], "bb": ["und", "der", "schon", "nicht", "eine"], "cc": ["que", "los", "cion", "para", "mente"]}
    rows = [(k, " ".join(rng.choice(vocab[x], 30)), x) for k, x in enumerate(list(vocab) * 40)]
    mixed = (900, " ".join(rng.choice(vocab["aa"], 60)) + " " + " ".join(rng.choice(vocab["bb"], 40)), None)
    odd = [(901, None, None), (902, "", None), (903, "12 34 !!", None), (904, "ß", None), (None, "the and", None)]
    df = spark.createDataFrame([*rows, mixed, *odd], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, df.where("doc_id < 60")).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows)
    shares = {s.lang: s.share for s in got[900].languages}
    assert got[900].lang_pred == "aa" and abs(shares["aa"] - 0.6) < 0.08 and abs(shares["bb"] - 0.4) < 0.08
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (901, 902, 903)) and got[904].lang_pred in vocab and got[None].lang_pred == "aa"
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}
    assert langid.identify(empty, df).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(11)
    a = np.array([[0.9, 0.1], [0.4, 0.6]])
    n_words = np.array([0, 1, 5, 70, 33, 0, 64])
    e = rng.standard_normal(n_words.sum())
    got = toxicity.marginals(e, n_words, a)
    at = 0
    for n in n_words:
        m = [a * np.array([1, np.exp(x)]) for x in e[at : at + n]]
        for k in range(n):
            left, right = np.array([1.0, 0.0]), np.ones(2)
            for x in m[: k + 1]:
                left = left @ x
                left /= left.sum()
            for x in m[:k:-1]:
                right = x @ right
                right /= right.sum()
            assert abs(got[at + k] - (left * right)[1] / (left * right).sum()) < 1e-9
        at += n


def test_toxicity(spark, empty):
    rng = np.random.default_rng(12)
    bad = ["vile", "nasty", "awful", "rotten"]
    rows, marks = [], []
    for k in range(600):
        words = list(rng.choice(WORDS, 30))
        if k % 5 == 0:
            for j in rng.choice(30, 3, replace=False):
                words[j] = str(rng.choice(bad))
        rows.append((k, " ".join(words)))
        marks.append((k, 1 if k % 5 == 0 else 0))
    odd = [(900, None), (901, ""), (902, "a VILE, and nasty! thing " * 2000), (None, "plain words")]
    docs, labels = spark.createDataFrame(rows + odd, "doc_id long, text string"), spark.createDataFrame(marks + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k].predicted == y for k, y in marks)
    text = dict(rows)
    assert {text[k][s.start : s.end] for k, y in marks if y for s in got[k].spans} == set(bad)
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score and got[902].predicted == 1 and len(got[902].spans) == 4000
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_calibration_settles():
    rng = np.random.default_rng(14)
    for n, share, gap in ((5000, 0.1, 9.0), (5000, 0.4, 2.0), (300, 0.02, 30.0)):
        y = (rng.random(n) < share).astype(int)
        z = np.stack([np.ones(n), np.clip(y + 0.05 * rng.standard_normal(n), 0, 1), np.abs(gap * y + rng.standard_normal(n)), np.abs(rng.standard_normal(n))], 1)
        w = toxicity._logistic(z, y, np.where(y == 1, 0.1 / y.mean(), 0.9 / (1 - y.mean())))
        p = 1 / (1 + np.exp(-z @ w))
        assert (w[1:] >= 0).all() and p[y == 1].mean() > 0.7 and p[y == 0].mean() < 0.1


def test_copies_count_once_and_long_clean_texts_stay(spark):
    rng = np.random.default_rng(15)
    copied = f"{prose(rng, 60)} vile {' '.join(f'only{k}here' for k in range(30))}"
    rows = [(k, copied + f" end{k}", 1) for k in range(80)] + [(100 + k, prose(rng, 30) + " vile", 1) for k in range(60)] + [(200 + k, prose(rng, 30), 0) for k in range(400)]
    clean = [(900, prose(rng, 20_000), None), (901, " ".join(f"only{k}here" for k in range(30)), None), (902, prose(rng, 25) + " vile vile", None)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()}
    assert (got[900], got[901], got[902]) == (0, 0, 1)
    assert sum(got[k] for k, _, y in rows if y == 0) == 0 and all(got[k] for k, _, y in rows if y)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.05


def test_resample(spark, docs, labels, rows, empty):
    keys = spark.createDataFrame([(int(x),) for x in np.random.default_rng(13).integers(0, 1 << 50, 500)], "k long")
    order = sorted((r.k for r in keys.collect()), reverse=True)
    assert [resample.kth_largest(keys, "k", n) for n in (1, 7, 500, 0, 501)] == [order[0], order[6], order[-1], None, 0]
    good = labels.where("doc_id < 30").select("doc_id")
    got = resample.resample(docs, good, share=0.5).collect()
    assert len(got) == len(rows) and abs(sum(r.kept for r in got) - round(0.5 * len(rows))) <= 1
    assert min(r.sample_key for r in got if r.kept) >= max(r.sample_key for r in got if not r.kept) - 2e-6
    by = {r.doc_id: r for r in got}
    words = rows[6][1].lower().split()
    assert by[7].n_grams == 2 * len(words) - 1 and by[4].n_grams == 0 and by[4].log_ratio == 0
    assert {r.log_ratio for r in resample.resample(docs, labels.limit(0).select("doc_id")).collect()} == {0.0}
    assert resample.resample(empty, good).count() == 0


def test_resample_against_a_plain_version(spark, docs, labels, rows):
    """Keys and choice from their definitions: hashed n-grams, smoothed log-ratios, Gumbel noise from the seeded hash."""
    mask = (1 << 64) - 1
    spread = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64(F.lit(resample.SEED), F.coalesce("doc_id", F.lit(-1))).alias("h"))
    noise = {r.doc_id: -np.log(-np.log((((r.h & mask) >> 11) + 0.5) / 2.0**53)) for r in spread.collect()}

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.lower().encode(), resample.SEED) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        two = [(((a * 0x9E3779B97F4A7C15 & mask) ^ (b >> 7) ^ b) * 0xC2B2AE3D27D4EB4F & mask) >> 48 for a, b in zip(h, h[1:])]
        return [x >> 48 for x in h] + two

    target, raw = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for r in rows:
        for at in grams(r[1]):
            raw[at] += 1
            target[at] += r[0] is not None and r[0] < 30
    share = lambda n: (n + resample.ADDED) / (n.sum() + resample.ADDED * len(n))
    ratio = np.log(share(target)) - np.log(share(raw))
    want = [(r[0], ratio[grams(r[1])].sum() if grams(r[1]) else 0.0) for r in rows]
    last = sorted((x + noise[i] for i, x in want), reverse=True)[round(0.5 * len(rows)) - 1]
    for bound in (resample.BROADCAST_IDS, 0):
        got = resample.resample(docs, labels.where("doc_id < 30").select("doc_id"), share=0.5, broadcast_ids=bound).collect()
        order = lambda xs: sorted(xs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        have = order((r.doc_id, r.log_ratio, r.sample_key, r.kept) for r in got)
        for (i, x, key, kept), (j, y) in zip(have, order(want), strict=True):
            assert i == j and abs(x - y) < 1e-5 and abs(key - y - noise[i]) < 1e-5
            assert kept == (y + noise[i] >= last) or abs(y + noise[i] - last) < 1e-5


def test_quality_against_a_plain_version(spark):
    """Distances and verdicts from their definitions, character by character and word by word."""
    rng = np.random.default_rng(21)
    kinds = {"lower": str.islower, "upper": str.isupper, "digit": str.isdigit}

    def kind(c):
        if ord(c) >= 0x80:
            return "beyond"
        named = next((k for k, own in quality._SETS.items() if c in own), None)
        return named or next((k for k, fits in kinds.items() if fits(c)), "other")

    vocab = {"aa": [f"a{k}" for k in range(150)], "bb": [f"Bé{k}" for k in range(150)], None: [f"#{k}!" for k in range(50)]}
    draw = lambda lang, n: " ".join(rng.choice(vocab[lang], n, p=np.arange(len(vocab[lang]), 0, -1) / sum(range(len(vocab[lang]) + 1))))
    rows = [(k, draw(("aa", "bb")[k % 2], int(rng.integers(5, 160))), ("aa", "bb")[k % 2]) for k in range(120)]
    rows += [(200 + k, draw(None, 30 + k), (None, "aa")[k % 2]) for k in range(20)] + [(300 + k, draw("aa", 40) + draw(None, 60), None) for k in range(10)]
    plain = lambda w: w.strip(".,;:!?'\"()-").lower()
    bucket = lambda w: xxhash.xxh64_intdigest(plain(w).encode()) % quality.BUCKETS
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)

    def failed(t):
        w = split(t)
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        return len(w) < 10 or 100 * len({j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}) > 20 * len(w)

    refs = {}
    for lang in ("aa", "bb"):
        own = [t for _, t, x in rows if x == lang and not failed(t) and len(split(t)) >= quality.LEAST_WORDS]
        chars, words = collections.Counter(kind(c) for t in own for c in t), collections.Counter(bucket(w) for t in own for w in split(t))
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
        refs[lang] = {c: n / sum(chars.values()) for c, n in chars.items()}, {b: n / sum(words.values()) for b, n in top}

    def distance(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        return np.sqrt(max(0.0, sum(x.get(k, 0) * np.log2(x[k] / m[k]) for x in (p, q) for k in x if x[k] > 0) / 2))

    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        words, near = split(t), []
        for chars, common in refs.values():
            mine = collections.Counter(bucket(w) if bucket(w) in common else "rest" for w in words)
            near.append((distance({c: n / len(t) for c, n in collections.Counter(map(kind, t)).items()}, chars), distance({b: n / len(words) for b, n in mine.items()}, common | {"rest": 1 - sum(common.values())})))
        by_char, by_word = (min(x) for x in zip(*near))
        far = (len(words) >= quality.LEAST_CHAR_WORDS and by_char > quality.MOST_CHAR_DISTANCE) or (len(words) >= quality.LEAST_WORDS and by_word > quality.MOST_WORD_DISTANCE)
        assert (got[i].char_distance is None) == (len(words) < quality.LEAST_CHAR_WORDS) and (got[i].word_distance is None) == (len(words) < quality.LEAST_WORDS)
        assert abs((got[i].char_distance or by_char) - by_char) < 1e-9 and abs((got[i].word_distance or by_word) - by_word) < 1e-9
        assert got[i].kept == (not failed(t) and not far)
    assert 0 < sum(r.kept for r in got.values()) < len(rows)


def test_many_languages(spark):
    """Every language has its model and its reference, and a text may hold as many as the likelihood finds."""
    rng = np.random.default_rng(22)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåæžšč"
    vocab = {f"l{k:02}": ["".join(rng.choice(list(letters), 6)) for _ in range(12)] for k in range(70)}
    rows = [(100 * k + j, " ".join(rng.choice(words, 60)), lang) for k, (lang, words) in enumerate(vocab.items()) for j in range(3)]
    four = " ".join(" ".join(rng.choice(vocab[x], 80)) for x in ("l03", "l19", "l44", "l69"))
    long_ = " ".join(rng.choice(vocab["l64"], 200_000))
    df = spark.createDataFrame([*rows, (90_000, four, None), (90_001, long_, None)], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in langid.identify(df, df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert {s.lang for s in got[90_000].languages} == {"l03", "l19", "l44", "l69"} and all(abs(s.share - 0.25) < 0.05 for s in got[90_000].languages)
    assert got[90_001].lang_pred == "l64" and got[90_001].score > 0.99
    assert len(quality.language_references(df)) == 70


def test_language_against_a_plain_version(spark):
    """Shares from their definition: models of byte n-grams, expectation-maximisation word by word, penalised choice."""
    rng = np.random.default_rng(23)
    vocab = {"aa": ["the", "and", "Thing,", "other"], "bb": ["und", "der", "schön", "nicht"], "cc": ["que", "los", "ción", "para"]}
    rows = [(k, " ".join(rng.choice(vocab[x], 8)), x) for k, x in enumerate(list(vocab) * 5)]
    texts = [(100 + k, " ".join(w for x in rng.choice(list(vocab), rng.integers(1, 4), replace=False) for w in rng.choice(vocab[x], rng.integers(1, 9))) + " zzz 12") for k in range(30)]

    def grams(word):
        b = b" " + word.strip(".,;:!?'\"()-[]{}|*#%&$<>=_0123456789").lower().encode() + b" "
        out = []
        for n in langid.SIZES if len(b) > 2 else ():
            for at in range(len(b) - n + 1):
                g = b[at : at + n]
                if b" " in g[1:-1] or (n == 1 and g == b" "):
                    continue
                code = n
                for c in g:
                    code = code << 8 | c
                out.append((code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)
        return out

    langs, models = sorted(vocab), []
    for lang in langs:
        n = np.full(langid.BUCKETS, langid.ADDED)
        for _, t, x in rows:
            for g in (g for w in t.split() for g in grams(w) if x == lang):
                n[g] += 1
        models.append(np.log(n / n.sum()))

    def mix(likes, share, rounds):
        for _ in range(rounds):
            own = likes * share
            share = (own / own.sum(1, keepdims=True)).mean(0)
        return share, np.log((likes * share).sum(1)).sum()

    def chosen(text):
        logs = np.array([[m[grams(w)].sum() for m in models] for w in text.split() if grams(w)])
        likes = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -50))
        share, _ = mix(likes, np.full(3, 1 / 3), langid.ROUNDS)
        order, best = np.argsort(-share, kind="stable"), (-np.inf, None)
        for m in range(1, 4):
            start = np.maximum(share[order[:m]], 1e-6)
            found, ll = mix(likes[:, order[:m]], start / start.sum(), 0 if m == 1 else langid.ROUNDS // 2)
            value = ll - (m - 1) * langid.PENALTY * np.log(max(2, len(likes)))
            best = (value, dict(zip(order[:m].tolist(), found))) if value > best[0] else best
        return best[1]

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), df).collect()}
    for i, t in texts:
        want = {langs[k]: s for k, s in chosen(t).items() if s > 0}
        have = {s.lang: s.share for s in got[i].languages}
        assert set(have) == set(want) and all(abs(have[x] - want[x]) < 1e-4 for x in want)
        assert abs(got[i].score - max(want.values())) < 1e-4


def test_toxicity_score_against_a_plain_version():
    """A document's score from its words one by one: features, forward-backward, aggregates, calibration."""
    rng = np.random.default_rng(24)
    texts = [" ".join([*rng.choice(WORDS, 20), *(["vile", "Nastyish!"] if k % 4 == 0 else [])]) for k in range(200)]
    model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(200)], 0.25)
    shown = ["", "vile", " ".join(rng.choice(WORDS, 90)), "some vile words " * 3, "NASTYISH w1"]
    codes, n_words, vocabulary = toxicity.words(pa.array(shown))
    got = model.score(model.tokens(codes, n_words, vocabulary), n_words)
    for text, score in zip(shown, got, strict=True):
        each = []
        for word in text.split():
            plain = "".join(re.findall(r"[^\W\d_]", word)).lower()
            told = [(0, plain)] + [(k, plain[:n] if n > 0 else plain[n:]) for k, n in enumerate((3, 4, 5, 6, 7, 8, -3, -4, -5), 1) if len(plain) >= abs(n)]
            each.append(model.bias + sum(model.weight[xxhash.xxh64_intdigest(x.encode(), 70 + k) % toxicity.BUCKETS] for k, x in told))
        steps = [model.transition * np.array([1.0, np.exp(np.clip(e, -30, 30))]) for e in each]
        p = []
        for k in range(len(steps)):
            left, right = np.array([1.0, 0.0]), np.ones(2)
            for m in steps[: k + 1]:
                left = left @ m / (left @ m).sum()
            for m in steps[:k:-1]:
                right = m @ right / (m @ right).sum()
            p.append((left * right)[1] / (left * right).sum())
        sure = [x for x in p if x >= toxicity.LEAST_MARGINAL]
        z = [1.0, 1 - np.prod([1 - min(x, 1 - 1e-9) for x in sure]), np.log1p(sum(sure)), np.log1p(100 * sum(sure) / max(1, len(p)))]
        assert abs(score - 1 / (1 + np.exp(-np.clip(np.dot(z, model.calibration), -30, 30)))) < 1e-6
    assert got[1] > 0.7 > 0.1 > got[2]


def test_toxicity_learns_from_long_texts(spark):
    rng = np.random.default_rng(25)
    rows = [(k, prose(rng, 4_000) + (" vile" * 12 if k % 2 else ""), k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert min(len(t) for _, t, _ in rows) > 10_000
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()}
    assert all(got[k] == y for k, _, y in rows)
    texts, marks, rate = toxicity.labelled_sample(docs, docs, class_bytes=100_000)
    assert rate > 0.3 and {sum(len(t) for t, y in zip(texts, marks, strict=True) if y == c) <= 100_000 for c in (0, 1)} == {True} and set(marks) == {0, 1}


def test_pii_in_a_text_of_many_matches(spark):
    import time

    docs = spark.createDataFrame([(1, "".join(f"mail u{k}@x.org or 10.0.{k % 256}.7 card\n" for k in range(50_000)))], "doc_id long, text string")
    began = time.time()
    row = pii.find_pii(docs).select(F.size("spans").alias("n"), F.col("spans")[0].alias("first"), F.element_at("spans", -1).alias("last")).first()
    assert row.n == 100_000 and (row.first.start, row.first.end, row.first.score) == (5, 13, 1.0) and row.last.value == "10.0.79.7" and time.time() - began < 60
    red = pii.redacted(docs).first().text
    assert red == "mail [email] or [ip] card\n" * 50_000


def test_names_that_clash(spark):
    """Columns called like an operator's own helpers stay as they are."""
    names = ["_a", "_b", "_bad", "_kept", "_row", "_mix_n", "_mix_id", "_mix_source", "_mix_size", "_n", "_low", "_sum", "_high", "_own_id", "_own_source", "_own_size", "_copy", "_rank", "key", "n", "component_id", "text_", "size", "times", "h"]
    rows = [(k % 6, f"text {k % 5} of some words\nshared line", "s") for k in range(24)] + [(None, "no id here at all", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.concat(F.lit(n), "text").alias(n) for n in names])
    for bytes_ in (lines.BROADCAST_BYTES, 0):
        got = lines.dedup_lines(docs, broadcast_bytes=bytes_)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and got.where("n_dropped = 1 and not endswith(text, 'shared line')").count() == 24 and got.where("startswith(_a, '_atext ') or startswith(_a, '_ano id')").count() == 29
    one = simhash.one_of_each_group(docs)
    assert one.columns == docs.columns and 0 < one.count() < 29
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixed.where("`_mix_n` <> concat('_mix_n', text)").count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    ids = mixed.where("doc_id is null").count()
    assert ids == mixing.mix_sources(docs).where("doc_id is null").agg(F.sum("times")).first()[0]


def test_lines_in_many_segments(spark, docs):
    want = sorted((r.doc_id or -1, r.text, r.n_dropped) for r in lines.dedup_lines(docs, min_docs=3).collect())
    for few in (lines.BROADCAST_HASHES, 0):
        got = lines.dedup_lines(docs, min_docs=3, segment_rows=4, bits_per_hash=1, broadcast_hashes=few)
        assert sorted((r.doc_id or -1, r.text, r.n_dropped) for r in got.collect()) == want


def test_lone_pairs_of_a_large_label(spark):
    """Passes over one label of 12,000 vectors: nearly all of 1,000 pairs at the threshold are found, and a group larger than a window in full."""
    rng = np.random.default_rng(26)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((10_900, 64)))
    across = rng.standard_normal((1_000, 64))
    across = unit(across - (across * x[:1_000]).sum(1, keepdims=True) * x[:1_000])
    dense = unit(unit(rng.standard_normal(64)) + 0.1 * unit(rng.standard_normal((100, 64))))
    x = np.concatenate([x, 0.932 * x[:1_000] + (1 - 0.932**2) ** 0.5 * across, dense]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in vectors.near_vectors(df, full_passes=60).collect()}
    found = sum(got[k].component_id == got[10_900 + k].component_id for k in range(1_000))
    assert found >= 950 and all(got[k].n_links == 99 and got[k].component_id == 11_900 for k in range(11_900, 12_000))
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert all(got[k].n_links <= n for k, n in enumerate((y @ y.T >= vectors.COSINE).sum(1) - 1))


def test_shared_folder_of_a_cluster():
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(Far)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    mine, theirs = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    order = sorted(mine.columns)
    told = lambda frame: sorted(map(str, frame[order].itertuples(index=False, name=None)))
    assert order == sorted(theirs.columns) and told(mine) == told(theirs)


def test_pipeline(spark, tmp_path, rows, labels):
    import corpus_pipeline

    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        none = stage(spark, plain.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() > 0 and out.where(F.size("ids") != F.col("n_ids")).count() == 0


def test_digest_of_empty():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and pa.__version__
