"""The registered queries of this subpackage: thin digests of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import alignment, bytepairs, divergence, langid, lines, mixing, pieces, pii, quality, resample, simhash, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample.resample(_table(spark, sf_dir, "documents"), good)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load_pieces()
    coded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return coded.select(
        "doc_id", "n_ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), *langid.HELD_OUT)
    found = langid.identify(docs, docs.where(~out))
    return found.select("doc_id", langid.held_out(F.col("doc_id"), *langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), digests={"groups_sha256": digest})


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bytepairs.load_ranks()
    coded = bytepairs.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    decoded = F.coalesce("decoded", F.lit(b""))
    return bytepairs.decode(coded, model).select("doc_id", "n_tokens", F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


# What SQL can express of an operator whose other columns it cannot: the same rows, fewer columns.


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's part of op2: counts and digest of the base kinds."""
    return op2_pii(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's part of op4: counts and the base rules."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op8."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling, op2_pii, op3_simhash_groups, op4_quality_rules, op5_line_dedup, op6_near_vectors,
        op7_toxicity, op8_mixing, op9_pieces, op10_language_mixture, op11_alignment, op12_byte_pairs, op13_source_divergence, pipeline, pii_base, quality_base, mixing_targets,
    )
}

_BLANK = r"[\x20\x09-\x0D]"
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_PASSES = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: x::DOUBLE > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (2 * c::INT) // 10 + (2 * c::INT) % 10 END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
_FOUND = " UNION ALL ".join(
    f"SELECT r, {k} AS o, '{kind}' AS kind, start, start + length(m) AS fin FROM (SELECT r, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY n) - length(m) AS start FROM (SELECT r, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS n FROM (SELECT r, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps FROM d))) WHERE {_PASSES[kind]}"
    for k, (kind, p) in enumerate(_PII.items())
)
_COUNTED = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in _PII)

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), l AS (SELECT r, doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS line FROM d),
n AS (SELECT *, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key AS bad FROM n WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(bad) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE bad IS NULL), '')) AS kept_sha256 FROM n LEFT JOIN b ON bad = key GROUP BY r""",
    "pii_base": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS ({_FOUND}),
a AS (SELECT r, {_COUNTED}, string_agg(kind || ':' || start::BIGINT || ':' || fin::BIGINT, ',' ORDER BY o, start) AS told FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _PII)}, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN a ON a.r = d.r""",
    "quality_base": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(line) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
w AS (SELECT r, generate_subscripts(x, 1) AS k, unnest(x) AS word FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM d)),
g AS (SELECT r, k, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram, lead(word, 4) OVER o AS fifth FROM w WINDOW o AS (PARTITION BY r ORDER BY k)),
t AS (SELECT r, k, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE fifth IS NOT NULL), rw AS (SELECT r, count(DISTINCT k + j) AS n_repeat_words FROM t, range(5) x(j) WHERE n >= 2 GROUP BY 1),
c AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY 1),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (r) LEFT JOIN dl USING (r) LEFT JOIN rw USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a""",
    "mixing_targets": """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
k AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
v AS (SELECT a.cap / a.w AS reach, (any_value(a.total) - sum(CASE WHEN b.cap / b.w < a.cap / a.w THEN b.cap ELSE 0 END)) / sum(CASE WHEN b.cap / b.w >= a.cap / a.w THEN b.w ELSE 0 END) AS level FROM k a, k b GROUP BY a.source, a.cap, a.w),
f AS (SELECT coalesce(arg_min(level, reach) FILTER (WHERE level <= reach), 'inf'::DOUBLE) AS level FROM v)
SELECT d.doc_id, d.size, k.source_size, round(least(k.cap, k.w * f.level), 6) AS target FROM d JOIN k ON k.source IS NOT DISTINCT FROM d.source, f""",
    "op13_source_divergence": """WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY 1),
g AS (SELECT lang, source, any_value(v) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
l AS (SELECT lang, sum(total) AS lang_total FROM g GROUP BY 1), m AS (SELECT lang, term, sum(n) AS n_lang FROM c GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v)::HUGEINT AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n_lang + 2)) // (lang_total + 2 * v)::HUGEINT AS q FROM m JOIN l USING (lang) JOIN v USING (lang)),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o) SELECT * FROM t WHERE part = 'pair' OR rank <= 10""",
}
