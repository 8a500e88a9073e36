"""Queries on names, persons and speakers. The driver's tables have no dialogue, so their own text is put into sentences of known form, and the SQL
follows from the form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.operators import attribution, people, validate
from folio.plans.queries import _LINES, doc_lines, query, segments, table

# --- names ----------------------------------------------------------------------------------------

_STOP, _TITLES, _VERBS = "|".join(people.STOP_WORDS), "|".join(people.TITLES), "|".join(people.VERBS)
_PLAIN = lambda c: rf"regexp_replace(regexp_replace({c}, '^(?:(?:{_TITLES})\.? )+(\p{{Lu}})', '\1'), '[''’]s$', '')"
_Q = lambda pattern: pattern.replace("'", "''")
#: harvest in SQL over lines (book_id, para, text), all narration.
HARVEST_SQL = rf"""each AS (SELECT book_id, para, k, trim(sentence) AS sentence FROM (SELECT book_id, para, unnest(x) AS sentence, generate_subscripts(x, 1) AS k FROM (SELECT book_id, para, regexp_extract_all(text, '{people.SENTENCE}') AS x FROM lines))),
rn AS (SELECT * FROM (SELECT book_id, sentence, unnest(x) AS run, generate_subscripts(x, 1) AS j FROM (SELECT *, regexp_extract_all(sentence, '{_Q(people.EACH_RUN)}', 1) AS x FROM each))),
rw AS (SELECT book_id, sentence, j, regexp_replace(regexp_replace(regexp_replace(run, '^(?:(?:{_STOP}) )+(\p{{Lu}})', '\1'), ' (?:{_STOP})$', ''), '[''’]s$', '') AS raw, regexp_replace(regexp_replace(run, '^(?:(?:{_STOP}) )+(\p{{Lu}})', '\1'), ' (?:{_STOP})$', '') AS own FROM rn),
nm AS (SELECT book_id, {_PLAIN("raw")} AS name, raw, j = 1 AND starts_with(sentence, raw) AS initial, regexp_matches(raw, '^(?:{_TITLES})\.? \p{{Lu}}') AS titled FROM rw WHERE NOT regexp_full_match(own, '{_STOP}') AND regexp_matches(own, '\p{{Ll}}')),
tg AS (SELECT DISTINCT book_id, {_PLAIN("raw")} AS name FROM (SELECT book_id, unnest(list_concat(regexp_extract_all(sentence, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_''’])({_Q(people.RUN)}) (?:{_VERBS})\b', 1), regexp_extract_all(sentence, '\b(?:{_VERBS}) ({_Q(people.RUN)})', 1))) AS raw FROM each)),
sm AS (SELECT DISTINCT book_id, unnest(regexp_extract_all(sentence, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_''’])(\p{{Ll}}[\p{{L}}\p{{M}}]{{2,}})', 1)) AS first FROM each),
ta AS (SELECT book_id, name, count(*) AS n, count(*) FILTER (WHERE NOT initial) AS within, bool_or(titled) AS titled FROM nm WHERE NOT regexp_full_match(name, '{_TITLES}') GROUP BY 1, 2),
harvest AS (SELECT ta.*, tg.name IS NOT NULL AS tagged FROM ta LEFT JOIN tg ON tg.book_id = ta.book_id AND tg.name = ta.name LEFT JOIN sm ON sm.book_id = ta.book_id AND sm.first = lower(string_split(ta.name, ' ')[1])
WHERE sm.first IS NULL AND (contains(ta.name, ' ') OR titled OR within > 0 OR tg.name IS NOT NULL OR n > 1))"""


@query(f"WITH {_LINES}, {HARVEST_SQL} SELECT book_id, name, n, within, titled, tagged FROM harvest")
def name_harvest(spark, sf_dir):
    """The names of every document, by the evidence of the document itself."""
    spans = doc_lines(spark, sf_dir).select("book_id", F.lit(1).alias("ch"), "para", F.lit(0).alias("s"), F.lit("narration").alias("kind"), "text")
    return people.harvest(spans)


#: Sentences about a customer N, and what they tell of gender, age and description.
_TOLD = (
    ("His sister N came in. He waited.", "female", "unknown", ""), ("N came early and he smiled.", "male", "unknown", ""), ("N was only twelve and sang.", "unknown", "child", "N was only twelve and sang"),
    ("Mrs N came in while he slept.", "female", "unknown", ""), ("Old N sat down.", "unknown", "elderly", ""), ("N, who kept the mill, sat down.", "unknown", "unknown", "N, who kept the mill"),
    ("N sang. She slept.", "female", "unknown", ""), ("N met Zora. She slept.", "unknown", "unknown", ""), ("N turned sixteen that day, said his aunt.", "male", "teen", ""),
    ("N waited for ten minutes.", "unknown", "unknown", ""), ("N saw the old man, and her hands shook.", "female", "unknown", ""), ("N grew wrinkled. N was a boy once.", "unknown", "elderly", "N was a boy once"),
)


@query(
    "WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS book_id, c_custkey AS k, 'Q' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS name FROM customer) SELECT book_id, name AS person, "
    + ", ".join("[" + ", ".join(f"'{row[j]}'" for row in _TOLD) + f"][k % {len(_TOLD)} + 1] AS {c}" for j, c in ((1, "gender"), (2, "age")))
    + ", replace([" + ", ".join(f"'{row[3]}'" for row in _TOLD) + f"][k % {len(_TOLD)} + 1], 'N', name) AS description, CASE WHEN k % {len(_TOLD)} = 3 THEN 'Mrs ' || name || ',' WHEN k % {len(_TOLD)} = 4 THEN 'Old ' || name || ',' ELSE '' END || name AS names FROM c"
)
def character_traits(spark, sf_dir):
    """What a book tells of each customer: one form of sentence by number, and a tag of speech elsewhere."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Q"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    pick = F.element_at(F.array(*[F.lit(row[0]) for row in _TOLD]), (k % len(_TOLD) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("book_id"), k.alias("k"), F.explode(F.array(F.replace(pick, F.lit("N"), name), F.concat(name, F.lit(" said nothing.")))).alias("text"))
    spans = rows.select("book_id", F.lit(1).alias("ch"), F.col("k").cast("int").alias("para"), F.when(F.col("text").endswith("said nothing."), 1).otherwise(0).alias("s"), F.lit("narration").alias("kind"), "text", F.lit(False).alias("scene_break_before"))
    spans = spans.withColumn("para", F.col("para") * 2 + F.col("s")).withColumn("s", F.lit(0))
    # A customer is two short rows and a table few tasks, so paragraphs are dealt out before their patterns are searched.
    found = people.people(spans.repartition("book_id", "para"))
    return found.select("book_id", "person", "gender", "age", "description", F.array_join("names", ",").alias("names"))


# --- who speaks -----------------------------------------------------------------------------------

#: Forms of a scene: X and Y are two of its people, of different gender, P the pronoun of X, and T what is said. A paragraph is a list of spans, narration if it begins with
#: N; of each quote, who speaks and by which rule.
_FORMS: tuple[tuple[list[list[str]], list[tuple[str, str]]], ...] = (
    ([["T", "N said X."]], [("X", "tag")]),
    ([["N X asked,", "T"]], [("X", "tag")]),
    ([["T", "N it was still for a while.", "T", "N X said slowly."]], [("X", "paragraph"), ("X", "tag")]),
    ([["N X nodded.", "T"]], [("X", "subject")]),
    ([["N Y waited. X came in."], ["T", "N P said."]], [("X", "pronoun")]),
    ([["N X met Y. Y was late."], ["T", "N P whispered."]], [("X", "pronoun")]),
    ([["N Y sat down."], ["T", "N said X."], ["T"], ["T"]], [("X", "tag"), ("Y", "alternation"), ("X", "alternation")]),
    ([["N Y sat down."], ["T", "N said X."], ["N The answer came slowly.", "T"]], [("X", "tag"), ("Y", "reply")]),
    ([["T", "N said X."], ["T"]], [("X", "tag"), ("X", "last")]),
    ([["T"]], [("NARRATOR", "narrator")]),
    ([["what is your name?", "N asked X."], ["Dora. Dora Vale."], ["T"]], [("X", "tag"), ("Dora Vale", "introduction"), ("X", "alternation")]),
    ([["N Alba, Bruno and Cora sat down."], ["Cora,", "N said Alba."], ["T"]], [("Alba", "tag"), ("Cora", "alternation")]),
    ([["N The stranger came in."], ["T", "N the stranger said."]], [("the stranger", "pronoun")]),
    ([["N P waited. X P came."], ["N P sat.", "T"]], [("X", "subject")]),
)


def _forms_sql() -> str:
    quotes = [[(f"{p}s{s}", *told.pop(0)) for p, para in enumerate(paras) for s, text in enumerate(para) if not text.startswith("N ")] for paras, told in ((paras, list(told)) for paras, told in _FORMS)]
    listed = ", ".join("[" + ", ".join(f"{{'span': '{span}', 'speaker': '{speaker}', 'rule': '{rule}'}}" for span, speaker, rule in form) + "]" for form in quotes)
    return f"""t AS (SELECT conv_id, turn, ['Alba', 'Bruno', 'Cora'][turn % 3 + 1] AS x, ['Bruno', 'Cora', 'Bruno'][turn % 3 + 1] AS y, unnest([{listed}][(conv_id + turn) % {len(_FORMS)} + 1]) AS q FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS book_id, turn || 'p' || q.span AS span_id, CASE q.speaker WHEN 'X' THEN x WHEN 'Y' THEN y ELSE q.speaker END AS speaker, q.rule AS rule FROM t"""


def dialogue(spark, sf_dir: str) -> DataFrame:
    """Spans of one scene a turn, in the forms above; what is said is the turn's own text without capitals, so that it names nobody."""
    c = table(spark, sf_dir, "conversations")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("turn") % 3 + 1).cast("int"))
    c = c.select("conv_id", "turn", F.lower("text").alias("said"), at(("Alba", "Bruno", "Cora")).alias("x"), at(("Bruno", "Cora", "Bruno")).alias("y"), at(("she", "he", "she")).alias("pronoun"))

    def span(p: int, s: int, text: str) -> Column:
        kind, text = ("narration", text[2:]) if text.startswith("N ") else ("quote", text)
        words = F.col("said") if text == "T" else F.lit(text)
        if kind == "narration":
            words = F.lit(text)
            for mark, column in (("X", "x"), ("Y", "y"), ("P", "pronoun")):
                words = F.regexp_replace(words, F.lit(rf"\b{mark}\b"), F.col(column))
        return F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"), F.lit(kind).alias("kind"), words.alias("text"))

    forms = [F.array(*[span(p, s, text) for p, para in enumerate(paras) for s, text in enumerate(para)]) for paras, _ in _FORMS]
    form = F.lit(None)
    for k, spans in enumerate(forms):
        form = F.when((F.col("conv_id") + F.col("turn")) % len(forms) == k, spans).otherwise(form)
    rows = c.select("conv_id", "turn", F.explode(form).alias("x")).select("conv_id", "turn", "x.*")
    scene = rows.select(F.col("conv_id").cast("string").alias("book_id"), F.lit(1).alias("ch"), (F.col("turn") * 8 + F.col("p")).cast("int").alias("para"), "s", F.concat_ws("", F.concat_ws("p", "turn", "p"), F.lit("s"), "s").alias("span_id"), "kind", "text", (F.col("p") == 0).alias("scene_break_before"))
    # Before all scenes: who there is.
    known = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(f"{n} said nothing, for {p} was tired.").alias("text")) for k, (n, p) in enumerate((("Alba", "she"), ("Bruno", "he"), ("Cora", "she")))])
    first = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("book_id"), F.explode(known).alias("x"))
    first = first.select("book_id", F.lit(1).alias("ch"), F.lit(-1).alias("para"), "x.s", F.concat(F.lit("k"), F.col("x.s")).alias("span_id"), F.lit("narration").alias("kind"), "x.text", F.lit(True).alias("scene_break_before"))
    return scene.unionByName(first)


@query(f"WITH {_forms_sql()}")
def speaker_attribution(spark, sf_dir):
    """Every rule that finds a speaker, in scenes of one to four paragraphs."""
    return attribution.attribute(dialogue(spark, sf_dir)).select("book_id", "span_id", "speaker", "rule")


@query(f"""WITH a AS ({_forms_sql().replace("t AS (", "WITH t AS (", 1)}) SELECT book_id, speaker AS name, CAST(count(*) AS INT) AS line_count, CASE speaker WHEN 'Bruno' THEN 'male' WHEN 'Alba' THEN 'female' WHEN 'Cora' THEN 'female' ELSE 'unknown' END AS gender,
speaker = 'the stranger' AS provisional, CASE WHEN speaker = 'Dora Vale' THEN 'Dora' ELSE '' END AS names FROM a WHERE speaker <> 'NARRATOR' GROUP BY 1, 2""")
def speaking_characters(spark, sf_dir):
    """Who speaks in each book, with other names, gender and lines."""
    found = attribution.characters(dialogue(spark, sf_dir))
    names = F.array_join(F.filter("aliases", lambda a: ~a.startswith("the ")), ",")
    return found.select("book_id", "name", "line_count", "gender", "provisional", names.alias("names"))


# --- labels that were given -----------------------------------------------------------------------


@query("""WITH l AS (SELECT conv_id, turn, turn // 6 AS chunk, turn % 3 < 2 AS quote FROM conversations), s AS (SELECT *, quote AND NOT (turn % 12 = 4 OR conv_id % 4 = 0 AND turn % 2 = 0) AS labelled FROM l),
c AS (SELECT conv_id, chunk, count(*) FILTER (WHERE quote) AS quotes, count(*) FILTER (WHERE quote AND NOT labelled) AS missing, bool_or(turn % 12 = 10 AND conv_id % 5 = 0) AS outside FROM s GROUP BY 1, 2)
SELECT s.conv_id || 's' || s.turn AS span_id, CASE WHEN NOT labelled THEN CASE WHEN s.conv_id % 3 = 0 THEN 'Filled ' || s.turn ELSE 'NARRATOR' END WHEN s.turn % 4 = 0 THEN 'Thomas' WHEN s.turn % 4 = 2 THEN 'Thomas' WHEN s.turn % 8 = 1 THEN 'Newton' ELSE 'Who Else' END AS speaker
FROM s JOIN c ON c.conv_id = s.conv_id AND c.chunk = s.chunk WHERE quote AND NOT (missing > 0.2 * quotes) AND NOT outside""")
def checked_labels(spark, sf_dir):
    """Labels of six turns a chunk: every third turn is narration (its label goes), some have no label (those of every third book are filled in by a speaker found otherwise), each is labelled twice (the
    second goes), and one is of no span. Speakers go by a name, by a phrase that fits one person, and by a name that the chunk's own updates bring. A chunk with a cue of another is invalid."""
    seg, labels, spans = _labelled(spark, sf_dir)
    fill = seg.where("book_id % 3 = 0").select("book_id", "span_id", F.concat(F.lit("Filled "), F.col("idx").cast("string")).alias("speaker"))
    return _checked(seg, labels, spans, fill).labels.select("span_id", "speaker")


@query("""WITH l AS (SELECT conv_id, turn, turn // 6 AS chunk, turn % 3 < 2 AS quote, turn % 12 = 10 AND conv_id % 5 = 0 AS strays FROM conversations), s AS (SELECT *, quote AND NOT (turn % 12 = 4 OR conv_id % 4 = 0 AND turn % 2 = 0) AS labelled FROM l),
c AS (SELECT conv_id, chunk FROM s GROUP BY 1, 2 HAVING NOT (count(*) FILTER (WHERE quote AND NOT labelled) > 0.2 * count(*) FILTER (WHERE quote)) AND NOT bool_or(strays))
SELECT s.conv_id || 's' || s.turn AS span_id, CAST(greatest(0.5, least(30.0, s.turn * 7.0 - 3)) AS DOUBLE) AS duration_s, CAST(greatest(0.0, least(1.0, s.turn / 4.0 - 0.5)) AS DOUBLE) AS intensity FROM s JOIN c USING (conv_id, chunk) WHERE s.turn % 2 = 0 AND NOT strays""")
def clamped_cues(spark, sf_dir):
    """Cues of every second turn with lengths and intensities that do not fit; some are said to be of a turn of another chunk, which makes their own chunk invalid."""
    seg, labels, spans = _labelled(spark, sf_dir)
    return _checked(seg, labels, spans, None).sfx.select("span_id", "duration_s", "intensity")


def _labelled(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seg = segments(spark, sf_dir).withColumn("chunk", F.floor(F.col("idx") / 6).cast("int"))
    quote = F.col("idx") % 3 < 2
    spans = seg.select("book_id", "ch", "chunk", "para", F.col("idx").alias("s"), "span_id", F.when(quote, "quote").otherwise("narration").alias("kind"))
    silent = (F.col("idx") % 12 == 4) | ((F.col("book_id").cast("long") % 4 == 0) & (F.col("idx") % 2 == 0))
    speaker = F.when(F.col("idx") % 4 == 0, "mr. TOM").when(F.col("idx") % 4 == 2, "The  boy").when(F.col("idx") % 8 == 1, "new").otherwise(" Who Else ")
    said = seg.where(~silent | ~quote).select("book_id", "ch", "chunk", "span_id", speaker.alias("speaker"), F.lit("calm").alias("emotion"), F.lit("quiet").alias("delivery"))
    labels = said.withColumn("ord", F.lit(1)).unionByName(said.withColumns({"ord": F.lit(2), "speaker": F.lit("Nobody")})).unionByName(said.withColumns({"ord": F.lit(0), "span_id": F.concat(F.lit("z"), F.col("span_id"))}))
    return seg, labels, spans


def _checked(seg: DataFrame, labels: DataFrame, spans: DataFrame, fill: DataFrame | None) -> validate.Checked:
    strays = (F.col("idx") % 12 == 10) & (F.col("book_id").cast("long") % 5 == 0)
    span = F.when(strays, F.concat(F.lit("other"), F.col("span_id"))).otherwise(F.col("span_id"))
    sfx = seg.where("idx % 2 = 0").select("book_id", "ch", "chunk", F.col("idx").alias("ord"), span.alias("span_id"), (F.col("idx") * 7.0 - 3).alias("duration_s"), (F.col("idx") / 4.0 - 0.5).alias("intensity"))
    music = seg.where("idx % 6 = 1").select("book_id", "ch", "chunk", F.col("idx").alias("ord"), "span_id", (F.col("idx") - 3.0).alias("energy"))
    person = lambda k, name, alias, age: F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), F.array(F.lit(alias)).alias("aliases"), F.lit("male").alias("gender"), F.lit(age).alias("age"), F.lit(False).alias("provisional"))
    cast = seg.select("book_id").distinct().select("book_id", F.explode(F.array(person(0, "Thomas", "Tom", "child"), person(1, "Karl", "Charles", "adult"))).alias("p")).select("book_id", "p.*")
    news = seg.select("book_id", "ch", "chunk").distinct().select("book_id", "ch", "chunk", F.lit(0).alias("ord"), F.lit("Newton").alias("name"), F.array(F.lit("new")).alias("aliases"))
    return validate.checked_analysis(spans, labels, sfx, music, cast, news, fill)
