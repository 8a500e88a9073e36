"""Registered queries beside their SQL on hand-made tables that the driver's small ones have no rows of."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio.operators import attribution, ledger, people, speech
from folio.sources import books
from folio.plans.queries import ORACLE_SQL, QUERIES
from test_queries import rows


def beside_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL on these tables."""
    duck = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return rows(QUERIES[name](spark, str(folder)).toPandas()), rows(duck.execute(ORACLE_SQL[name]).df())


LONG = "On and " * 150 + "on."


def talk(*texts):
    n = len(texts)
    return {"conv_id": [1] * n, "turn": list(range(n)), "role": ["user", "assistant"] * (n // 2) + ["user"] * (n % 2), "text": list(texts)}


@pytest.mark.parametrize("text", [LONG, f"Hi there. {LONG} Bye. Now.", f"{LONG} {LONG}", f"{'One. ' * 170}{LONG}"])
def test_tts_plan_keeps_long_sentences(spark, tmp_path, text):
    mine, theirs = beside_sql(spark, tmp_path, "tts_plan", conversations=talk("Before.", text, "After."))
    assert mine == theirs


def test_pieces_of_long_sentences(spark):
    split = lambda text, n, whole: spark.range(1).select(speech.split_text(F.lit(text), n, whole)).first()[0]
    assert split("Ee. aaaa bbbb cccc. Ff. Gg.", 8, True) == ["Ee.", "aaaa bbbb cccc.", "Ff. Gg."]
    assert split("Ee. aaaa bbbb cccc. Ff. Gg.", 8, False) == ["Ee.", "aaaa", "bbbb", "cccc.", "Ff. Gg."]


def test_chapter_pieces_of_long_sentences(spark, tmp_path):
    mine, theirs = beside_sql(spark, tmp_path, "chapter_pieces", conversations=talk("Before.", f"Hi there. {LONG} Bye. Now.", "After.", "So. " * 200))
    assert mine == theirs


def test_caps_headings_of_ascii_letters(spark, tmp_path):
    lines = ["ÉÈ ÑÓ", "ÄÖ 12", "AB ÉÈ", "АБ ВГ", "AB CDĸ", "STRAßE AB", "\tAB CD\r", "\u2003AB CD\xa0", "AB\x0bCD", "A 1", "A" * 40 + " " + "B" * 39, "A" * 40 + " " + "B" * 40, "A B C D E F G H I"]
    text = "\n".join(x for line in lines for x in (line, "x"))
    mine, theirs = beside_sql(spark, tmp_path, "caps_headings", documents={"doc_id": [1, 2, 3], "text": [text, None, ""]})
    assert mine == theirs and len(mine) > 3


def test_exact_sums_of_usage(spark):
    rows_ = [("a", x) for x in (80.16, 79.35, 87.1, 1.89)] + [("b", x) for x in (0.1, 1e-13)] + [("c", x) for x in (1e30, 1.0)] + [("d", float("nan")), ("d", 1.0), ("e", None), ("f", None), ("f", 0.5)]
    usage = spark.createDataFrame([(job, "x", "chars", units) for job, units in rows_], "job_id string, capability string, unit_type string, units double").coalesce(1)
    got = {r.job_id: r.units for r in ledger.usage_by_capability(usage).collect()}
    assert str(got.pop("d")) == "nan" and got == {"a": 248.5, "b": 0.1 + 1e-13, "c": 1e30 + 1.0, "e": None, "f": 0.5}


HALVES = [(87.1, 1.89, 79.35, 80.16), (80.16, 79.35, 87.1, 1.89), (0.1, 0.2, 0.2), (1.1, 2.2, 3.2)]


def test_usage_nested_adds_in_order(spark, tmp_path):
    made = [(k, *x) for k, values in enumerate(HALVES) for x in enumerate(values)]
    events = {"event_id": [2 * (10 * k + n) for k, n, _ in made], "ts": [0] * len(made), "user_id": [k for k, _, _ in made], "event_type": ["click"] * len(made), "value": [x for _, _, x in made], "props": ["{}"] * len(made)}
    mine, theirs = beside_sql(spark, tmp_path, "usage_nested", events=events)
    assert mine == theirs


def test_sums_in_order_of_rows_that_come_in_any(spark):
    made = [(100 * k + n, str(k), "x", "chars", values[n % len(values)]) for k, values in enumerate(HALVES) for n in range(80)]
    usage = spark.createDataFrame(made[::-1], "id long, job_id string, capability string, unit_type string, units double").repartition(5, "id")
    want = {}
    for _, job, _, _, x in made:
        want[job] = want.get(job, 0.0) + x
    assert {r.job_id: r.units for r in ledger.usage_by_capability(usage, "id").collect()} == want


def test_progress_rounds_a_half_up(spark):
    # 65.95 in every order of the stages, whose sums of doubles differ in their last bit.
    from itertools import permutations

    stages = [("ingest", 3, 10), ("analyze", 6, 10), ("cast", 8, 10), ("render", 7, 10), ("finalize", 3, 8)]
    made = [(k, stage, "running", done, total) for k, order in enumerate(permutations(stages)) for stage, done, total in order]
    found = ledger.overall_progress(spark.createDataFrame(made, "job_id int, stage string, state string, done long, total long").coalesce(1))
    assert {r.percent for r in found.collect()} == {66.0}


def test_overall_progress_adds_in_order(spark, tmp_path):
    # Sums that stand at a half in some orders of the stages and below it in others, and one that reaches it when taken ten times.
    made = [[92, 391, 560, 762, 1178, 1234, 1275, 2131], [5, 148, 704, 766, 996, 1334, 1487, 1531], [31, 454, 829, 1048, 1455, 2077]]
    ids = [(k * 3 * 5 * 11 * 13 + e, k) for k, events in enumerate(made) for e in events]
    events = {"event_id": [e for e, _ in ids], "ts": [0] * len(ids), "user_id": [k for _, k in ids], "event_type": ["click"] * len(ids), "value": [1.0] * len(ids), "props": ["{}"] * len(ids)}
    mine, _ = beside_sql(spark, tmp_path, "overall_progress", events=events)
    duck = duckdb.connect(config={"threads": 1})  # on 4 threads and more the SQL's own runs differ
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert mine == rows(duck.execute(ORACLE_SQL["overall_progress"]).df())


def test_progress_in_order_of_rows_that_come_in_any(spark):
    from itertools import permutations

    stages = {"ingest": (2, 3, 10), "analyze": (28, 6, 10), "cast": (2, 8, 10), "render": (66, 7, 10), "finalize": (2, 3, 8)}
    made = [(job, stage, "running", *stages[stage][1:], n) for job, order in enumerate(permutations(stages)) for n, stage in enumerate(order)]
    want = {}
    for job, stage, *_ in made:
        weight, done, total = stages[stage]
        want[job] = want.get(job, 0.0) + weight * (done / total)
    rows_ = spark.createDataFrame(made[::-1], "job_id int, stage string, state string, done long, total long, n int").repartition(5, "n")
    got = {r.job_id: r.percent for r in ledger.overall_progress(rows_, "n").collect()}
    assert got == {job: int(x * 10 + 0.5) / 10 for job, x in want.items()} and len(set(got.values())) == 2


def test_pages_are_parsed_some_at_a_time():
    html = [None, ""] + [f"<h1>T{k}</h1><p>a</p>" for k in range(2, 150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array(html, pa.string())], ["page_id", "html"])
    out = list(books.parsed_pages(iter([batch])))
    assert max(len(set(b.column("page_id").to_pylist())) for b in out) <= 64 and len(out) == 3
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [x for k in range(2, 150) for x in ((k, 0, "heading", f"T{k}"), (k, 1, "text", "a"))]


def test_html_headings_without_any(spark, tmp_path):
    mine, theirs = beside_sql(spark, tmp_path, "html_headings", pages={"page_id": list(range(200)), "url": ["u"] * 200, "html": ["<p>x</p><h1>A</h1><h1>B</h1>" if k % 3 else "<p>x</p>" for k in range(200)]})
    assert mine == theirs


def test_html_blocks_of_cut_references(spark, tmp_path):
    cut = ["&quot", "&quo", "&q", "&", "&am", "&amp", "&copy", "&middot", "&quotes", "&quot;", "&amp;quot;", "&ampquot;", "&copy;&middot;", "&lt;b&gt;", "&nbsp;", "&#39;", "a & b", "&&quot"]
    html = [f"<html><head><title>T {c}</title></head><body><!-- {c} --><h1>T {c}</h1><p>x {c}<br>{c}y</p></body></html>" for c in cut] + ["<h1>T &quot", "<p>x &copy", None, ""]
    mine, theirs = beside_sql(spark, tmp_path, "html_blocks", pages={"page_id": list(range(len(html))), "url": ["u"] * len(html), "html": html})
    assert mine == theirs


def _narrated(spark, rows_):
    return spark.createDataFrame([("b", 1, para, s, kind, text) for para, s, kind, text in rows_], "book_id string, ch int, para int, s int, kind string, text string")


def test_harvest_works_out_each_pattern_once(spark):
    spans = _narrated(spark, [(1, 0, "narration", "Tom came. The Tom.")])
    plan = people.runs(people.sentences(spans))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Friday|Saturday") == 3  # stop words before and behind others, and alone


def test_harvest_of_narration_that_goes_on(spark):
    spans = _narrated(spark, [
        (1, 0, "quote", "Well,"), (1, 1, "narration", " Zoe went. Abe sat."), (2, 0, "quote", "Well."), (2, 1, "narration", "Eve went."), (3, 0, "narration", "Ida Old. Kim said. Then asked Lou Mr. Ann's."),
        (4, 0, "quote", "Eve"), (5, 0, "narration", None), (5, 1, "narration", "... Ono! ida.Uwe 'Tis"), (6, 0, "quote", None), (6, 1, "narration", "Pia sat."), (7, 0, "quote", "Go"), (7, 1, "narration", "The Roy ran."),
    ])
    got = {tuple(r) for r in people.harvest(spans).collect()}
    assert got == {("b", "Zoe", 1, 1, False, False), ("b", "Eve", 1, 0, False, False), ("b", "Kim", 1, 0, False, True), ("b", "Lou Mr", 1, 1, False, True), ("b", "Ann", 1, 1, False, False), ("b", "Roy", 1, 1, False, False)}


def test_traits_work_out_each_pattern_once(spark):
    spans = _narrated(spark, [(1, 0, "narration", "Tom was a boy. He ran.")])
    plan = people.traits(spans)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("teenage") == 1 and plan.count("regexp_instr") == 1


def nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from nodes(plan.children().apply(k))


def test_texts_pass_no_window(spark):
    spans = spark.createDataFrame([("b", 1, 0, 0, "x", "quote", "Who are you?", True)], "book_id string, ch int, para int, s int, span_id string, kind string, text string, scene_break_before boolean")
    for found in (people.introductions(people.scenes(people.naming(spans))), attribution.reading(spans)):
        windows = [p for p in nodes(found._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Window"]
        assert windows and not any("text#" in p.output().mkString(" ") for p in windows)


@pytest.mark.parametrize("answer, names", [("Dora. Dora Vale.", ["Dora Vale", "Dora"]), ("Dora. ", ["Dora"]), ("Mr. O'Neil!\n", ["Mr. O'Neil"]), ("Dora, of course.", None), ("2 Doras", None), ("I'm Dora", ["I'm Dora"]), ("yes, I'm Dora", ["Dora"]), ("The name's Dora. Vale", ["Dora", "Vale"])])
def test_answers_that_are_names(spark, answer, names):
    spans = spark.createDataFrame([("b", 1, 0, 0, "quote", "Who are you?", True), ("b", 1, 1, 0, "quote", answer, False)], "book_id string, ch int, para int, s int, kind string, text string, scene_break_before boolean")
    assert [r.names for r in people.introductions(people.scenes(people.naming(spans))).collect()] == ([names] if names else [])
