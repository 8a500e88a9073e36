"""Operators on hand-made inputs with exact expectations."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import keys, signal, text as T
from folio.operators import cache, casting, characters, effects, ledger, mix, script, segment, selection, speech, timeline, validate
from folio.sources import books, sinks
from folio.streaming import ledger as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def spans_of(spark, text, style):
    paras = frame(spark, [("b", 1, 2, text, style)], "book_id string, ch int, para int, text string, style string")
    out = segment.split_spans(paras).orderBy("s").collect()
    assert all(text[r.start_char : r.end_char] == r.text for r in out)
    return [(r.span_id, r.kind, r.text) for r in out]


Q, N = "quote", "narration"


@pytest.mark.parametrize(
    ("style", "text", "want"),
    [
        ("double", '"Stop," he said. "Now', [(Q, "Stop,"), (N, "he said."), (Q, "Now")]),
        ("double", '"" "Hello."   "" ', [(Q, "Hello.")]), ("double", "   ", []), ("double", "", []),
        ("double", '  Leading space.  "Quote."  trailing  ', [(N, "Leading space."), (Q, "Quote."), (N, "trailing")]),
        ("double", "“I can’t reach it!” he cried. “Help!”", [(Q, "I can’t reach it!"), (N, "he cried."), (Q, "Help!")]),
        ("double", "«Not a quote here», he said. 'Nor this.'", [(N, "«Not a quote here», he said. 'Nor this.'")]),
        ("single", "'I'm the boys' friend,' said Tom.", [(Q, "I'm the boys' friend,"), (N, "said Tom.")]),
        ("single", "'Tobias's lantern is out,' Mara said, 'and the boy's boots are wet.'", [(Q, "Tobias's lantern is out,"), (N, "Mara said,"), (Q, "and the boy's boots are wet.")]),
        ("single", "Mara didn't answer; the sea's roar was loud. 'They heard,' she said.", [(N, "Mara didn't answer; the sea's roar was loud."), (Q, "They heard,"), (N, "she said.")]),
        ("single", "'Rock 'n' roll,' he said.", [(Q, "Rock 'n' roll,"), (N, "he said.")]),
        ("single", "'I'm goin' home,' she said.", [(Q, "I'm goin' home,"), (N, "she said.")]),
        ("single", "'It's the Hardcastles' pride and joy, or it was.'", [(Q, "It's the Hardcastles' pride and joy, or it was.")]),
        ("single", "'The boys' room is a mess", [(Q, "The boys"), (N, "room is a mess")]),
        ("single", "‘Where’s the boy?’ she asked. ‘I don’t know", [(Q, "Where’s the boy?"), (N, "she asked."), (Q, "I don’t know")]),
        ("guillemet", "« Oui » dit-il", [(Q, "Oui"), (N, "dit-il")]), ("guillemet", "»Komm her«, sagte sie.", [(Q, "Komm her"), (N, ", sagte sie.")]),
        ("dash", "— You are late, said Marie.", [(Q, "You are late"), (N, ", said Marie.")]), ("dash", "Plain text", [(N, "Plain text")]),
        ("dash", "— Ven aquí — dijo ella — ahora mismo.", [(Q, "Ven aquí"), (N, "dijo ella"), (Q, "ahora mismo.")]),
        ("dash", "The sea — grey and flat — lay silent.", [(N, "The sea — grey and flat — lay silent.")]), ("dash", "-- Nobody is coming.", [(Q, "Nobody is coming.")]),
        ("dash", "— The bells were early, said Tomas. — I set my watch by them.", [(Q, "The bells were early"), (N, ", said Tomas."), (Q, "I set my watch by them.")]),
        ("dash", "— Perhaps. He leaned on the wall. — Are you angry?", [(Q, "Perhaps."), (N, "He leaned on the wall."), (Q, "Are you angry?")]),
        ("dash", "— Bonjour, Éloïse dit doucement.", [(Q, "Bonjour"), (N, ", Éloïse dit doucement.")]), ("dash", "— Hola, María preguntó.", [(Q, "Hola"), (N, ", María preguntó.")]),
        ("dash", "— Hola, Andrés dijo.", [(Q, "Hola"), (N, ", Andrés dijo.")]), ("dash", "— Peut-être. Éloïse regarda la mer. — Viens !", [(Q, "Peut-être."), (N, "Éloïse regarda la mer."), (Q, "Viens !")]),
        ("dash", "— Fine. But you are paying.", [(Q, "Fine. But you are paying.")]), ("dash", "— Decide. The café closes at nine.", [(Q, "Decide. The café closes at nine.")]),
    ],
)
def test_spans(spark, style, text, want):
    assert spans_of(spark, text, style) == [(f"c1p2s{k}", kind, piece) for k, (kind, piece) in enumerate(want)]


def test_spans_of_a_long_paragraph(spark):
    text = "'I'm here,' he said. " * 20_000
    for style, n in (("single", 40_000), ("double", 1)):
        paras = frame(spark, [("b", 1, 2, text, style)], "book_id string, ch int, para int, text string, style string")
        got = segment.split_spans(paras).agg(F.count("*"), F.max("end_char")).first()
        assert tuple(got) == (n, len(text) - 1)


def test_paragraphs_and_scene_breaks(spark):
    text = "﻿Title\r\nwrapped  line\n\nNext\n\n\nAfter gap\n\n***\n\nAfter marker\n# Head\ntail"
    got = segment.paragraphs(frame(spark, [("b", text), ("e", ""), ("n", None)], "book_id string, text string")).orderBy("book_id", "para").collect()
    assert [(r.text, r.scene_break_before) for r in got] == [("Title wrapped line", False), ("Next", False), ("After gap", True), ("After marker", True), ("# Head", False), ("tail", False)]


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("Chapter 1: The Storm Bell", "Chapter 1: The Storm Bell"), ("PART TWO", "PART TWO"), ("Book II - The Return", "Book II - The Return"), ("Part of her wanted to run.", None),
        ("Part civil", None), ("## Two ##", "Two"), ("XIV", "XIV"), ("12.", "12."), ("THE STORM BELL", "THE STORM BELL"), ("I SAID NO.", None), ("Prologue", "Prologue"),
        ("Book me a room at the inn.", None), ('"CHAPTER ONE"', None), ("x" * 81, None), ("Epilogue - Ten Years Later", "Epilogue - Ten Years Later"),
    ],
)
def test_headings(spark, text, title):
    assert frame(spark, [(text,)], "text string").select(T.heading_title(F.col("text"))).first()[0] == title


def test_chapters(spark):
    prose = " ".join(["word"] * 120)
    rows = ["The Book", "Chapter 1", prose, "A SIGN", "short", "Chapter 2", "tiny", "Chapter 3", prose, "THE END"]
    paras = frame(spark, [("b", k + 1, t, False) for k, t in enumerate(rows)] + [("p", k, prose, False) for k in range(1, 4)], "book_id string, para int, text string, scene_break_before boolean")
    got = segment.detect_chapters(paras).orderBy("book_id", "ch", "para").collect()
    assert [(r.ch, r.title, r.para) for r in got if r.book_id == "b"] == [(1, "Chapter 1", 3), (1, "Chapter 1", 4), (1, "Chapter 1", 5), (2, "Chapter 3", 7), (2, "Chapter 3", 9)]
    assert {(r.ch, r.title) for r in got if r.book_id == "p"} == {(1, "Part 1")}


def test_chunks(spark):
    sizes = [100, 5000, 100, 100]
    paras = frame(spark, [("b", 1, k + 1, n) for k, n in enumerate(sizes)], "book_id string, ch int, para int, length long")
    assert [r.chunk for r in segment.chunk_numbers(paras, 300).orderBy("para").collect()] == [0, 1, 2, 2]


SEGMENT = "book_id string, ch int, idx int, span_id string, para int, speaker string, kind string, text string, emotion string, delivery string, scene_break_before boolean, duration_ms int"


def segments(spark, rows):
    return frame(spark, [("b", 1, k, f"s{k}", p, s, "narration" if s == "NARRATOR" else "dialogue", t, e, "normal", brk, ms) for k, (p, s, t, e, brk, ms) in enumerate(rows)], SEGMENT)


def test_pauses(spark):
    rows = [(1, "A", "x", "calm", False, 0), (1, "A", "x", "calm", False, 0), (1, "B", "x", "calm", False, 0), (2, "B", "x", "calm", False, 0), (3, "B", "x", "weary", False, 0), (4, "B", "x", "calm", True, 0), (5, "B", "x", "weary", True, 0), (5, "B", "x", "urgent", False, 0)]
    got = segments(spark, rows).withColumn("p", timeline.pause_ms()).orderBy("idx").collect()
    assert [r.p for r in got] == [None, 250, 400, 650, 845, 1500, 1950, 150]


def test_timeline(spark):
    seg = segments(spark, [(1, "NARRATOR", "Crash went the door.", "calm", False, 1000), (2, "A", "Hello", "calm", False, 500), (3, "NARRATOR", "Rain fell.", "calm", True, 2000)])
    cues = frame(spark, [("b", 1, 0, "s0", "crash", "crash", "impact", 1000, 0.9), ("b", 1, 1, "s2", "rain", "rain", "ambient", 9000, 0.3), ("b", 1, 2, "zz", "x", "x", "impact", 1, 0.1)], "book_id string, ch int, ord int, span_id string, anchor_text string, description string, kind string, duration_ms int, intensity double")
    anchored = script.anchored_cues(cues, seg)
    regions = script.music_regions(
        frame(spark, [], "book_id string, ch int, idx int, ord int, action string, mood string, energy double"), frame(spark, [("b", 1, 3, "none")], "book_id string, ch int, n_spans int, prior_mood string")
    )
    got = {(r.track, r.ref): (r.start_ms, r.end_ms) for r in timeline.timeline(seg, anchored, regions).collect()}
    assert got[("voice", "s0")] == (2100, 3100) and got[("voice", "s1")] == (3750, 4250) and got[("voice", "s2")] == (5750, 7750)
    assert got[("sfx", "c1x001")] == (1500, 2500) and got[("sfx", "bed1")] == (5450, 7750) and got[("music", "music1")] == (1300, 9250)


def test_music_regions(spark):
    events = [(0, 0, "start", "tense"), (0, 1, "change", "calm"), (4, 2, "stop", "x"), (6, 3, "change", "warm")]
    e = frame(spark, [("b", 1, i, o, a, m, 0.5) for i, o, a, m in events], "book_id string, ch int, idx int, ord int, action string, mood string, energy double")
    got = script.music_regions(e, frame(spark, [("b", 1, 10, "sad")], "book_id string, ch int, n_spans int, prior_mood string")).orderBy("n").collect()
    assert [(r.start_idx, r.end_idx, r.mood) for r in got] == [(0, 3, "calm"), (6, 9, "warm")]


def test_assemble(spark):
    spans = frame(spark, [("b", 1, 1, k, f"c1p1s{k}", kind, "x", 0, 1, True) for k, kind in enumerate(["quote", "narration", "quote", "quote"])], "book_id string, ch int, para int, s int, span_id string, kind string, text string, start_char int, end_char int, scene_break_before boolean")
    labels = frame(spark, [("b", "c1p1s0", 0, "mr. tom", "sad", "quiet"), ("b", "c1p1s0", 1, "Ann", "calm", "shout"), ("b", "c1p1s1", 2, "Ann", "sad", "quiet"), ("b", "c1p1s2", 3, "nobody", "sad", "quiet"), ("b", "zz", 4, "Ann", "sad", "quiet")], "book_id string, span_id string, ord int, speaker string, emotion string, delivery string")
    people = frame(spark, [("b", 0, "Thomas", ["Tom"]), ("b", 1, "Ann", None), ("b", 2, "Other", ["tom"])], "book_id string, ord int, name string, aliases array<string>")
    got = script.assemble_segments(spans, labels, people).orderBy("idx").collect()
    assert [(r.speaker, r.kind, r.emotion, r.scene_break_before) for r in got] == [("Thomas", "dialogue", "sad", True), ("NARRATOR", "narration", "neutral", False), ("NARRATOR", "dialogue", "sad", False), ("NARRATOR", "dialogue", "neutral", False)]
    assert script.unknown_labels(labels, spans).count() == 1


def test_casting(spark):
    people = frame(spark, [("b", 0, "Mia", [], "female", "child", "", "", 1, 9, False), ("b", 1, "Old Sam", [], "male", "elderly", "dry", "a gruff man", 1, 5, False), ("b", 2, "Mute", [], "male", "adult", "", "", 1, 0, False), ("b", 3, "Eve", [], "female", "child", "", "", 1, 3, False)], "book_id string, ord int, name string, aliases array<string>, gender string, age string, description string, voice_notes string, first_chapter int, line_count int, provisional boolean")
    voices = frame(spark, [("n", "Neutral", "x", "unknown", "adult", ["narration", "neutral"], ""), ("c", "Kid", "x", "female", "child", ["bright"], ""), ("g", "Grandpa", "x", "male", "elderly", ["raspy", "gruff"], "dry")], "id string, name string, family string, gender string, age string, tags array<string>, description string")
    none = frame(spark, [], "book_id string, speaker string, partner string")
    got = {r.character: (r.voice_id, r.ordinal) for r in casting.cast_voices(casting.base_scores(people, voices), none).collect()}
    assert got == {"NARRATOR": ("n", 0), "Mia": ("c", 0), "Old Sam": ("g", 0), "Eve": ("c", 1)}


def test_ledger(spark):
    rows = [(1, "j", "tts", "chars", False, 10.0, 0.004), (2, "j", "tts", "chars", True, 10.0, 0.0), (3, "j", "llm", "tokens", False, 5.0, 0.006)]
    usage = frame(spark, rows, "id long, job_id string, capability string, unit_type string, cache_hit boolean, units double, cost_usd double")
    got = ledger.usage_totals(usage).first()
    assert (got.calls, got.hits, got.cost_usd) == (2, 1, 0.01)
    assert ledger.usage_nested(usage).first().by_capability == {"tts": {"chars": 20.0}, "llm": {"tokens": 5.0}}
    events = frame(spark, [(k, "j") for k in range(1, 11)], "id long, job_id string")
    assert [r.id for r in ledger.events_after(events, 4, 4).collect()] == [5, 6, 7, 8]
    entries = frame(spark, [("a", 5, "2024-01-01 00:00:00"), ("b", 5, "2024-01-01 01:00:00"), ("c", 5, "2024-01-02 00:00:00")], "key string, bytes long, used_at string").withColumn("used_at", F.to_timestamp("used_at"))
    assert {r.key for r in ledger.lru_prune(entries, 10).collect()} == {"a"} and ledger.lru_prune(entries, 0).count() == 0


def test_keys(spark):
    import hashlib
    import json

    got = frame(spark, [("a\"é", "b")], "x string, y string").select(keys.content_key(F.col("x"), F.col("y")).alias("k")).withColumn("s", keys.stable_seed(F.col("k"))).first()
    want = hashlib.sha256(json.dumps(['a"é', "b"], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got.k == want and got.s == int(want[:8], 16)


def test_signal(spark):
    x = np.concatenate([np.zeros(500), 0.5 * np.sin(np.arange(1000)), np.zeros(500)])
    assert 1000 <= len(signal.trim_silence(x, 1000, keep_ms=40)) <= 1100
    assert abs(20 * np.log10(np.sqrt((signal.normalize_rms(x, 1000)[510:1490] ** 2).mean())) + 20) < 0.3
    assert len(signal.loop_to_length(np.ones(100), 1000, 20)) == 1000 and len(signal.resample(x, 1000, 500)) == 1000
    gain = signal.duck_gain(np.repeat([False, True, False], [25, 50, 25]), 10.0)
    assert gain[:20].min() > 0.99 and gain[60] < 0.4 and 0.4 < gain[-1] < 0.9
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 300):
        speaks, held = rng.random(n) < 0.2, rng.random(n) < 0.05
        busy = [any(speaks[k : k + 4]) or held[k] for k in range(n)]
        level, slow = None, []
        for k in range(n):
            lo = next((j for j in range(k, -1, -1) if busy[j]), -1)
            hi = next((j for j in range(k, n) if busy[j]), n)
            goal = 2.0 if not busy[k] and hi - lo - 1 >= 5 else 0.5
            level = goal if level is None else goal + (level - goal) * math.exp(-20 / (40 if goal < level else 600))
            slow.append(level)
        assert np.allclose(signal.duck_gain(speaks, 20 * math.log10(2), 20 * math.log10(2), 100, held), slow)
    assert signal.pauses(np.array([True, False, False, True, False]), 2).tolist() == [False, True, True, False, False] and not len(signal.pauses(np.zeros(0, bool), 2))
    row = frame(spark, [([0.5, -0.5, 2.0],)], "s array<double>").select(signal.to_int16(F.col("s")).alias("i"), signal.rms_dbfs(F.slice("s", 1, 2)).alias("d")).first()
    assert row.i == [16384, -16384, 32767] and abs(row.d + 6.0206) < 1e-3


def test_mix_in_buckets(spark):
    rng = np.random.default_rng(3)
    clips = [(k % 2, int(rng.integers(0, 4_000)), float(rng.integers(-6, 3)), rng.standard_normal(int(rng.integers(0, 250))).tolist()) for k in range(200)]
    placed = frame(spark, [("b", ch, "t", at, gain, x) for ch, at, gain, x in clips], "book_id string, ch int, track string, start_ms long, gain_db double, samples array<double>").repartition(7)
    got = signal.mix_tracks(placed, 100, 1_000).collect()
    want, have = np.zeros((2, 700)), np.zeros((2, 700))
    for ch, at, gain, x in clips:
        want[ch, at * 100 // 1000 :][: len(x)] += np.array(x) * 10 ** (gain / 20)
    for r in got:
        have[r.ch, r.start : r.start + len(r.samples)] += r.samples
    assert np.allclose(have, want) and len({(r.ch, r.bucket) for r in got}) == len(got) and max(len(r.samples) for r in got) == 100


def test_names_of_any_language(spark, tmp_path):
    from folio.plans.queries import QUERIES

    text = "José sah Müller, Łukasz; été Élise\nAnna Anna xBob _Cleo 7Dan e\u0301Fred NATO O'Neil A."
    frame(spark, [(1, text, "de"), (2, "Anna", None), (3, None, "en"), (4, "Anna Zoë", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: (r.n, r.docs) for r in QUERIES["name_candidates_all"](spark, str(tmp_path)).collect()}
    assert got == {"José": (1, 1), "Müller": (1, 1), "Łukasz": (1, 1), "Élise": (1, 1), "Anna": (4, 3), "Neil": (1, 1), "Zoë": (1, 1)}


def test_books(spark, tmp_path):
    words = " ".join(["word"] * 120)
    (tmp_path / "a.txt").write_bytes(f"{words} caf\xe9 \x93q\x94".encode("latin-1"))
    (tmp_path / "b.md").write_text("too short")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> Doc </dc:title></metadata><manifest><item id="n" href="nav.html" properties="nav"/><item id="c" href="cover.html"/><item id="x" href="a%20b.html"/></manifest><spine><itemref idref="n"/><itemref idref="c"/><itemref idref="x"/></spine></package>')
        z.writestr("o/nav.html", "<h1>Contents</h1>")
        z.writestr("o/cover.html", "<p>Cover</p>")
        z.writestr("o/a b.html", f"<html><head><title>t</title></head><body><h1>One</h1><p>{words}<br>end</p><hr></body></html>")
    (tmp_path / "d.epub").write_bytes(b"no zip")
    got = {r.filename: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text.endswith("café “q”") and got["b.md"].error and got["d.epub"].error
    assert got["c.epub"].text == f"# One\n\n{words} end\n\n***"
    assert got["c.epub"].title == "Doc"


def test_streams(spark, tmp_path):
    usage = frame(spark, [(k, "j", "tts", float(k), 0.1, k % 2 == 0) for k in range(6)], "id long, job_id string, capability string, units double, cost_usd double, cache_hit boolean")
    usage.write.parquet(f"{tmp_path}/in")
    seen = []
    tail = stream.tail_events(spark, f"{tmp_path}/in", usage.schema)
    stream.each_batch(tail, lambda df, _: seen.append(stream.running_usage(df).collect()), f"{tmp_path}/cp").awaitTermination()
    assert [(r.units, r.hits) for r in seen[0]] == [(15.0, 3)]


STORY = """Mara Quill climbed the stairs, her lantern in one hand.

"Tobias!" she shouted. "Ring the bell!"

From above came a muffled reply. "I can't reach it!" Tobias was only ten, and his voice cracked.

"Stand back," said Mara.

***

They found the man on the beach. He was alive.

"Easy," Mara said. "What's your name?"

"Ansel. Ansel Vey." He coughed.

"Are you a pirate?" the boy asked."""


def story(spark):
    paras = segment.paragraphs(frame(spark, [("b", STORY)], "book_id string, text string")).withColumn("ch", F.lit(1))
    spans = segment.alternating_spans(paras)
    return paras, spans.join(paras.select("book_id", "ch", "para", "scene_break_before"), ["book_id", "ch", "para"])


def test_attribution(spark):
    from folio.operators import attribution

    paras, spans = story(spark)
    got = {r.span_id: r.speaker for r in attribution.attribute(spans).collect()}
    assert got == {
        "c1p2s0": "Mara Quill", "c1p2s2": "Mara Quill", "c1p3s1": "Tobias", "c1p4s0": "Mara Quill", "c1p6s0": "Mara Quill", "c1p6s2": "Mara Quill",
        "c1p7s0": "Ansel Vey", "c1p8s0": "Tobias",
    }
    people = {r.name: r for r in attribution.characters(spans).collect()}
    assert people["Ansel Vey"].aliases == ["Ansel", "the man"] and people["Tobias"].age == "child" and people["Mara Quill"].gender == "female" and people["Mara Quill"].line_count == 5
    tone = {r.span_id: (r.emotion, r.delivery) for r in attribution.tones(spans).collect()}
    assert tone["c1p2s0"] == ("urgent", "shout") and tone["c1p3s1"] == ("afraid", "shout") and tone["c1p7s0"] == ("weary", "strained")
    moods = effects.paragraph_moods(paras.withColumn("prior_mood", F.lit("none"))).withColumn("reset", F.col("scene_break_before"))
    assert [(r.para, r.action, r.mood, r.energy) for r in effects.music_cues(moods).collect()] == [(1, "start", "tense", 0.7)]


SPEECH = "book_id string, ch int, para int, s int, span_id string, kind string, text string, scene_break_before boolean"


def dialogue(spark, *paragraphs):
    """Spans of paragraphs with quotes in double marks; a paragraph that begins with * opens a scene."""
    rows = []
    for p, text in enumerate(paragraphs):
        parts = [(k % 2, t.strip()) for k, t in enumerate(text.lstrip("*").split('"')) if t.strip()]
        rows += [("b", 1, p, s, f"p{p}s{s}", "quote" if q else "narration", t, text[0] == "*") for s, (q, t) in enumerate(parts)]
    return frame(spark, rows, SPEECH)


def speakers(spark, *paragraphs):
    from folio.operators import attribution

    return {r.span_id: (r.speaker, r.rule) for r in attribution.attribute(dialogue(spark, *paragraphs)).collect()}


def test_turns_of_two_and_three(spark):
    lines = ["I never said that.", "You did, and you know it.", "Then prove it.", "Fine."]
    got = speakers(spark, "Ilse found her brother Aldo in the barn.", '"You sold the mare," Ilse said.', '"I had no choice," said Aldo.', *[f'"{x}"' for x in lines])
    assert [got[f"p{k}s0"][0] for k in range(1, 7)] == ["Ilse", "Aldo"] * 3 and got["p3s0"][1] == "alternation"
    from folio.operators import attribution

    three = dialogue(spark, "Ann looked at Bob and then at Cal.", '"Shall we go?" Ann asked.', '"Not yet," Bob said.', '"Why not?" said Cal.', '"Because it is raining."', '"So what?"')
    lines = attribution.spoken_lines(three)
    assert {r.problem for r in attribution.guesses(lines).collect()} == {"ambiguous"} and {r.speaker for r in lines.collect()} == {"Ann", "Bob", "Cal"}


@pytest.mark.parametrize("word", ["Riders,", "Nonsense,", "Careful!", "Liar!"])
def test_exclamations_are_nobody(spark, word):
    got = speakers(spark, "Halloran took the first watch while Brannock slept.", '"Wake me," said Brannock.', '"I will," Halloran said.', f'"{word}" Halloran whispered.', 'Brannock was awake at once. "How many?"', '"Two. Maybe three."')
    assert got["p3s0"][0] == "Halloran" and got["p4s1"] == ("Brannock", "subject") and got["p5s0"] == ("Halloran", "alternation")


def test_names_in_other_scripts_and_alone(spark):
    got = speakers(spark, '"Viens," dit la mer. Éloïse said nothing.', '*"Oui," said Éloïse.', '*"Nobody knows."', '*"I am Happy," said Éloïse.')
    assert got["p1s0"] == ("Éloïse", "tag") and got["p2s0"] == ("NARRATOR", "narrator") and got["p3s0"] == ("Éloïse", "tag")
    assert speakers(spark, '"A"', '"B"') == {"p0s0": ("NARRATOR", "narrator"), "p1s0": ("NARRATOR", "narrator")}
    from folio.operators import attribution, people

    none = frame(spark, [], SPEECH)
    assert attribution.attribute(none).count() == 0 and people.people(none).count() == 0 and attribution.characters(none).count() == 0
    nulls = frame(spark, [("b", 1, 0, 0, "x", "narration", None, None), ("b", 1, 0, 1, "y", "quote", None, None)], SPEECH)
    assert [(r.span_id, r.rule) for r in attribution.attribute(nulls).collect()] == [("y", "narrator")]


def test_harvest_wants_evidence(spark):
    from folio.operators import people

    text = "Thunder rolled. The thunder went on. Rain fell. Mrs. Vale met Tom. Old Hetta sang. Zora left. Zora came back. Gulls cried. Perhaps Ilse knew."
    got = {r.name: (r.n, r.within, r.titled, r.tagged) for r in people.harvest(frame(spark, [("b", 1, 0, 0, "x", "narration", text, False)], SPEECH)).collect()}
    assert got == {"Vale": (1, 0, True, False), "Tom": (1, 1, False, False), "Hetta": (1, 0, True, False), "Zora": (2, 0, False, False), "Ilse": (1, 1, False, False), "Gulls": (1, 0, False, True)}


def test_voices_are_heard_in_narration(spark):
    from folio.operators import attribution

    spans = dialogue(spark, '"I see," said Ansel in a hoarse voice with a dry rattle.', '"Yes," Ansel said, and wheezed hoarsely.')
    assert [(r.name, r.voice_notes) for r in attribution.characters(spans).collect()] == [("Ansel", "dry, rasping, hoarse, wheezy")]


def test_line_sources(spark):
    one = lambda c: frame(spark, [(1,)], "x int").select(c.alias("c")).first().c
    page = "\n 12 \nText here\n\n3 of them\nPage 7\n\n"
    assert one(books.without_page_numbers(F.lit(page))) == "Text here\n\n3 of them" and one(books.without_page_numbers(F.lit(" 4 "))) == ""
    wrapped = "A long line of text that is hyphen-\nated and goes on here\nand ends.\nNext line of text that is as long\nChapter 2\nmore text of the next chapter\n\nlast"
    assert one(books.unwrap_lines(F.lit(wrapped))).split("\n\n") == ["A long line of text that is hyphenated and goes on here and ends.", "Next line of text that is as long", "Chapter 2", "more text of the next chapter", "last"]


def test_split_text(spark):
    def split(text, n):
        return frame(spark, [(text,)], "t string").select(speech.split_text(F.col("t"), n)).first()[0]

    assert split(" One. Two!  Three? ", 100) == ["One. Two!  Three?"] and split("  ", 5) == [] and split(None, 5) == []
    assert split("One. Two! Three? Four.", 10) == ["One. Two!", "Three?", "Four."]
    assert split("aaaa bbbb cccc dddd. Ee. Ff.", 10) == ["aaaa bbbb", "cccc dddd.", "Ee. Ff."]
    assert split("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and split("Hi. " + "y" * 12 + " z. Go.", 10) == ["Hi.", "y" * 10, "yy z. Go."]


def test_tts_plan(spark):
    import hashlib
    import json

    seg = segments(spark, [(1, "NARRATOR", "One two. Three four.", "calm", False, 0), (1, "A", "Hello", "urgent", False, 0), (2, "B", "Hm", "calm", False, 0), (2, "NARRATOR", "End.", "calm", False, 0)])
    cast = frame(spark, [("b", "NARRATOR", "n", 1, 0.5, 0.75, 0.0, 1.0, 0.0), ("b", "A", "a", 2, 0.5, 0.75, 0.0, 1.0, 0.0)], "book_id string, character string, voice_id string, seed long, stability double, similarity_boost double, style double, speed double, pitch_shift double")
    got = {(r.idx, r.piece): r for r in speech.plan_tts(seg, cast, 12, "fam", "v1").collect()}
    assert {k: (r.text, r.voice_id, r.previous_text, r.next_text) for k, r in got.items()} == {
        (0, 0): ("One two.", "n", None, "Three four."), (0, 1): ("Three four.", "n", "One two.", "End."), (1, 0): ("Hello", "a", None, None),
        (2, 0): ("Hm", "n", None, None), (3, 0): ("End.", "n", "One two. Three four.", None),
    }
    fields = {"text": "Hello", "voice_id": "a", "settings": {"stability": 0.35, "similarity_boost": 0.75, "style": 0.2, "speed": 1.05, "pitch_shift": 0.0}, "emotion": "urgent", "delivery": "normal", "previous_text": None, "next_text": None, "seed": 2}
    assert got[1, 0].clip_key == hashlib.sha256(json.dumps(["tts", "fam", "v1", 1, fields], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fold(spark, steps):
    """Cast after (name, changes) updates and spoken lines (a plain name), all in chapter 2."""
    ups = [("b", k, 2, s[0], s[1].get("aliases", []), s[1].get("gender", "unknown"), s[1].get("age", "unknown"), s[1].get("description", ""), s[1].get("notes", ""), s[1].get("into")) for k, s in enumerate(steps) if isinstance(s, tuple)]
    said = [("b", k, 2, s) for k, s in enumerate(steps) if isinstance(s, str)]
    updates = frame(spark, ups, "book_id string, ord int, ch int, name string, aliases array<string>, gender string, age string, description string, voice_notes string, merge_into string")
    return characters.fold_updates(updates, frame(spark, said, "book_id string, ord int, ch int, name string"))


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([("Ansel", {"gender": "male"}), ("Ansel Vey", {"age": "adult"})], [("Ansel Vey", ["Ansel"], "male", "adult")]),
        ([("Ansel Vey", {}), ("Ansel", {"notes": "dry"})], [("Ansel Vey", ["Ansel"], "unknown", "unknown")]),
        ([("John Smith", {}), ("John Brown", {}), ("John", {})], [("John Smith", [], "unknown", "unknown"), ("John Brown", [], "unknown", "unknown"), ("John", [], "unknown", "unknown")]),
        ([("Mara Quill", {}), ("Quill Mara Vey", {"aliases": ["Mara Quill"]})], [("Mara Quill", ["Quill Mara Vey"], "unknown", "unknown")]),
        ([("Wren", {"gender": "female"}), ("Corwin Tallow", {"aliases": ["Corwin", "Wren"], "gender": "male"})], [("Wren", [], "female", "unknown"), ("Corwin Tallow", ["Corwin", "Wren"], "male", "unknown")]),
        ([("Ash Carver", {"gender": "male"}), ("Ash", {"gender": "female"})], [("Ash Carver", [], "male", "unknown"), ("Ash", [], "female", "unknown")]),
        ([("Old Hetta", {"age": "elderly"}), ("Hetta", {"gender": "female"})], [("Hetta", ["Old Hetta"], "female", "elderly")]),
        ([("the stranger", {"gender": "male"}), ("Ansel Vey", {"aliases": ["Ansel"], "into": "the stranger"})], [("Ansel Vey", ["Ansel", "the stranger"], "male", "unknown")]),
        ([("the stranger", {"gender": "male"}), ("Ansel Vey", {"description": "the stranger from the sea"})], [("Ansel Vey", ["the stranger"], "male", "unknown")]),
        ([("the stranger", {"gender": "male"}), ("Anna", {"aliases": ["the stranger"], "gender": "female"})], [("the stranger", [], "male", "unknown"), ("Anna", ["the stranger"], "female", "unknown")]),
        ([("Hetta", {"into": "nobody at all"}), (" ", {})], [("Hetta", [], "unknown", "unknown")]),
        ([("Mara", {"gender": "female", "age": "adult"}), ("Mara", {"gender": "male", "age": "child"})], [("Mara", [], "female", "adult")]),
    ],
)
def test_character_updates(spark, steps, want):
    assert [(r.name, r.aliases, r.gender, r.age) for r in fold(spark, steps).orderBy("ord").collect()] == want


def test_character_lines_and_end(spark):
    steps = [("Mara Quill", {"gender": "female", "notes": "warm, dry", "description": "keeper"}), ("Tobias", {"gender": "male", "age": "child"}), "the boy", "the girl", "NARRATOR", "mara quill", "the man", ("Kit", {"notes": "thin"}), ("Old Kit Vane", {"notes": "Thin, hoarse"}), "Kit", "Nobody Known"]
    got = {r.name: r for r in fold(spark, steps).collect()}
    assert {n: (r.line_count, r.provisional) for n, r in got.items()} == {"Mara Quill": (1, False), "Tobias": (1, False), "the girl": (1, True), "the man": (1, True), "Kit Vane": (1, False), "Nobody Known": (1, False)}
    assert got["Kit Vane"].voice_notes == "thin, hoarse" and got["Kit Vane"].aliases == ["Old Kit Vane", "Kit"]
    rows = [
        ("b", 0, "Mara Quill", ["M"], "female", "unknown", "x", "dry", 2, 3, False), ("b", 1, "Mara", ["m", "May"], "unknown", "adult", "longer", "warm, Dry", 1, 2, False), ("b", 2, "the rider", [], "unknown", "unknown", "", "", 1, 0, True),
        ("b", 3, "the stranger's dog", [], "unknown", "unknown", "", "", 1, 2, True), ("b", 4, "Ann", [], "female", "adult", "", "", 1, 0, False), ("b", 5, "Ann One", [], "female", "adult", "", "", 1, 1, False), ("b", 6, "Ann Two", [], "female", "adult", "", "", 1, 1, False),
    ]
    done = {r.ord: r for r in characters.finalize(frame(spark, rows, characters.SCHEMA)).collect()}
    m = done[0]
    assert (m.name, m.aliases, m.gender, m.age, m.description, m.voice_notes, m.first_chapter, m.line_count) == ("Mara Quill", ["M", "Mara", "May"], "female", "adult", "longer", "dry, warm", 1, 5)
    assert sorted(done) == [0, 3, 4, 5, 6] and done[3].name == "The Stranger's Dog"


def test_checked_analysis(spark):
    spans = frame(spark, [("b", 1, c, 1, k, f"c{c}s{k}", "quote" if k % 2 == 0 else "narration") for c in (1, 2, 3) for k in range(12)], "book_id string, ch int, chunk int, para int, s int, span_id string, kind string")
    said = [(1, 0, "tom"), (1, 0, "Ann"), (1, 1, "Ann"), (1, 2, "the boy"), (1, 4, "New"), (1, 6, " Who "), (1, 8, "narrator"), (3, 0, "Ann")] + [(2, k, "Ann") for k in range(0, 12, 2)]
    labels = frame(spark, [("b", 1, c, n, f"c{c}s{k}", who, "sad", "quiet") for n, (c, k, who) in enumerate(said)] + [("b", 1, 1, 99, "zz", "Ann", "sad", "quiet")], "book_id string, ch int, chunk int, ord int, span_id string, speaker string, emotion string, delivery string")
    sfx = frame(spark, [("b", 1, 1, 0, "c1s1", 99.0, 1.5), ("b", 1, 2, 1, "c1s1", 1.0, 0.5)], "book_id string, ch int, chunk int, ord int, span_id string, duration_s double, intensity double")
    music = frame(spark, [("b", 1, 1, 0, "c1s1", -1.0)], "book_id string, ch int, chunk int, ord int, span_id string, energy double")
    people = frame(spark, [("b", 0, "Thomas", ["Tom"], "male", "child", "", "", 1, 1, False), ("b", 1, "Ann", [], "female", "adult", "", "", 1, 1, False)], characters.SCHEMA)
    news = frame(spark, [("b", 1, 1, 0, "Newton", ["new"])], "book_id string, ch int, chunk int, ord int, name string, aliases array<string>")
    got = validate.checked_analysis(spans, labels, sfx, music, people, news)
    assert {r.span_id: r.speaker for r in got.labels.collect()} == {"c1s0": "Thomas", "c1s2": "Thomas", "c1s4": "Newton", "c1s6": "Who", "c1s8": "NARRATOR", "c1s10": "NARRATOR"}
    assert {(r.chunk, r.problem, r.n) for r in got.invalid.collect()} == {(2, "outside", 1), (3, "unlabelled", 5)}
    assert [(r.duration_s, r.intensity) for r in got.sfx.collect()] == [(30.0, 1.0)] and [r.energy for r in got.music.collect()] == [0.0]
    assert sorted((r.span_id, r.problem) for r in got.problems.collect()) == [("c1s0", "further label"), ("c1s1", "clamped"), ("c1s1", "clamped"), ("c1s1", "narration"), ("c1s10", "no label"), ("zz", "unknown span")]


def test_effects(spark):
    text = ["Thunder rolled. The bell in the tower rang twice.", "The wind slammed it again and again over the sea.", "The kettle was whistling on the fire that crackled."]
    spans = frame(spark, [("b", 1, p, s, f"p{p}s{s}", "narration", t) for p, own in enumerate([text[:2], text[2:]]) for s, t in enumerate(own)], "book_id string, ch int, para int, s int, span_id string, kind string, text string")
    spans = spans.join(spans.groupBy("book_id", "ch", "para").agg(F.concat_ws(" ", F.collect_list("text")).alias("paragraph")), ["book_id", "ch", "para"])
    got = [(r.span_id, r.anchor_text, r.anchor_offset, r.duration_ms) for r in effects.effect_cues(spans).orderBy("ord").collect()]
    assert got == [("p0s0", "Thunder", 0, 3000), ("p0s0", "bell", 20, 6000), ("p0s1", "slammed", 9, 4000), ("p1s0", "whistling", 15, 3000), ("p1s0", "crackled", 42, 15000)]


def test_music_cues_confirm(spark):
    moods = ["tense", None, "calm", "warm", "warm", None, None, None, "calm", "tense", "calm"]
    rows = [("b", 1, k, m, "none", k == 8) for k, m in enumerate(moods)] + [("b", 2, k, m, "warm", False) for k, m in enumerate([None, "calm", "calm"])]
    got = effects.music_cues(frame(spark, rows, "book_id string, ch int, para int, mood string, prior_mood string, reset boolean")).orderBy("ch", "para").collect()
    assert [(r.ch, r.para, r.action, r.mood) for r in got] == [(1, 0, "start", "tense"), (1, 3, "change", "warm"), (1, 8, "change", "calm"), (2, 1, "change", "calm")]
    events = frame(spark, [("b", 1, 3, 0, "start", "tense"), ("b", 1, 5, 1, "change", "warm"), ("b", 3, 1, 2, "stop", "x")], "book_id string, ch int, idx int, ord int, action string, mood string")
    chapters = frame(spark, [("b", k) for k in range(1, 6)], "book_id string, ch int")
    assert [r.prior_mood for r in effects.moods_in_force(events, chapters).orderBy("ch").collect()] == ["none", "warm", "warm", "none", "none"]


def test_selection(spark):
    assert selection.chapter_ranges("1-3, 5,") == [(1, 3), (5, 5)] and selection.chapter_ranges(None) == []
    for bad in ("2-", "0", "3-1", "x", "1-99999"):
        with pytest.raises(ValueError):
            selection.chapter_ranges(bad)
    rows = frame(spark, [("b", k) for k in range(1, 8)], "book_id string, ch int")
    assert [r.ch for r in selection.only_chapters(rows, [(1, 3), (5, 5)]).orderBy("ch").collect()] == [1, 2, 3, 5]
    long_ = frame(spark, [("b", 1, 61_000)], "book_id string, ch int, end_ms long")
    assert [(r.ch, r.problem, r.n) for r in selection.rejected_books(rows, long_, 6, 1).orderBy("ch").collect()] == [(None, "spans", 7), (1, "minutes", 61_000)]


def test_sinks(spark, tmp_path):
    clips = frame(spark, [("tts", "a", 1), ("tts", "a", 1), ("sfx", "b", 2)], "kind string, clip_key string, v int")
    sinks.append_cache(clips, f"{tmp_path}/cache")
    sinks.append_cache(clips.unionByName(frame(spark, [("tts", "c", 3)], clips.schema)), f"{tmp_path}/cache")
    assert sorted(r.clip_key for r in spark.read.parquet(f"{tmp_path}/cache").collect()) == ["a", "b", "c"]
    tracks = frame(spark, [("x", 8000, [0, 1, -1, 32767, -32768, 258])], "name string, rate int, samples array<smallint>")
    sinks.write_wavs(tracks, f"{tmp_path}/wav")
    got = books.read_wavs(spark, f"{tmp_path}/wav").first()
    assert got.rate == 8000 and [round(v * 32768) for v in got.samples] == [0, 1, -1, 32767, -32768, 258]


def test_ledger_changes(spark):
    new = frame(spark, [(k % 7, k) for k in range(300)], "t int, v int").repartition(5)
    got = sorted((r.id, r.t, r.v) for r in ledger.numbered_events(new, 10, ["t", "v"]).collect())
    assert [g[0] for g in got] == list(range(11, 311)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    stages = frame(spark, [("j", "cast", "pending", 1, None, None), ("j", "render", "running", 1, 5, 6)], "job_id string, stage string, state string, attempts int, started_at int, finished_at int")
    changes = frame(spark, [("j", "cast", "running", 9), ("j", "render", "done", 8)], "job_id string, stage string, state string, ts int")
    assert {r.stage: (r.state, r.attempts, r.started_at, r.finished_at) for r in ledger.set_stages(stages, changes).collect()} == {"cast": ("running", 2, 9, None), "render": ("done", 1, 5, 8)}
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(0, 50)), int(rng.integers(0, 200_000) if k % 3 else 70_000)) for k in range(400)]
    entries = frame(spark, rows, "key int, bytes int, s int").withColumn("used_at", F.timestamp_seconds("s"))
    for cap in (1, 500, 5_000, 10**9):
        total, want = 0, set()
        for key, n, _ in sorted(rows, key=lambda r: (-r[2], -r[0])):
            total += n
            want |= {key} if total > cap else set()
        assert {r.key for r in ledger.lru_prune(entries, cap).collect()} == want


def test_span_totals_are_those_of_spans(spark):
    texts = ['"Hi," she said. " " "Go', "plain", "", None, "\u3000 \u2003", "«a» b", "'Yes,' he said.", "— One — two — three"]
    paras = frame(spark, [("b", 1, k * 10 + j, t, style) for k, t in enumerate(texts) for j, style in enumerate(("double", "guillemet", "single", "dash", None))], "book_id string, ch int, para int, text string, style string")
    spans = segment.split_spans(paras).collect()
    got = segment.span_totals(paras).first()
    assert (got.spans, got.quotes, got.speech_chars) == (len(spans), sum(r.kind == "quote" for r in spans), sum(len(r.text) for r in spans))


def test_wav_source(spark, tmp_path):
    from folio.sources import wav

    wav.register(spark)
    path = f"{tmp_path}/wavs"
    rows = [(f"t{k}", 8000 + k, [k, -k, 32767, -32768]) for k in range(20)]
    tracks = frame(spark, rows, "name string, rate int, samples array<smallint>").repartition(4)
    tracks.write.format("wav").mode("append").save(path)
    read = spark.read.format("wav")
    assert sorted((r.name, r.rate, r.samples) for r in read.load(path).collect()) == sorted(rows)
    only = read.load(path).where("name = 't7'")
    assert [r.rate for r in only.collect()] == [8007] and sorted(r.rate for r in read.load(path).where("name in ('t1', 't2', 'none')").collect()) == [8001, 8002]
    assert {r.samples is None for r in read.option("samples", "false").load(path).collect()} == {True}
    bad = tracks.withColumn("name", F.concat(F.lit("new"), "name")).withColumn("rate", F.when(F.col("name") == "newt3", -1).otherwise(F.col("rate")))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("wav").mode("append").save(path)
    import os

    assert sorted(os.listdir(path)) == sorted(f"t{k}.wav" for k in range(20))


def test_clustered_and_bucketed_ledgers(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 500).alias("job_id"), F.col("id").alias("v")).repartition(7)
    ledger.write_clustered(rows, f"{tmp_path}/usage", "job_id", 8)
    found = spark.read.parquet(f"{tmp_path}/usage").where("job_id = 123")
    assert found.count() == 40 and found.select(F.input_file_name()).distinct().count() == 1
    import glob

    import pyarrow.parquet as pq

    held = [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics for f in glob.glob(f"{tmp_path}/usage/*.parquet")]
    assert sum(x.min <= 123 <= x.max for x in held) == 1
    for name in ("ledger_a", "ledger_b"):
        ledger.write_bucketed(rows.limit(2_000), name, "job_id", 4)
    joined = spark.table("ledger_a").hint("merge").join(spark.table("ledger_b"), "job_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for name in ("ledger_a", "ledger_b"):
        spark.sql(f"DROP TABLE {name}")


def test_stage_machine_comes_back_from_its_checkpoint(spark, tmp_path):
    from folio.streaming import ledger as stream

    stream.rocksdb(spark)
    schema = "job_id string, stage string, state string, ts long, seq long"
    changes = [("j", "cast", "running", 10, 0), ("j", "cast", "failed", 20, 1), ("k", "cast", "running", 5, 0), ("j", "cast", "running", 30, 2), ("j", "cast", "done", 40, 3), ("j", "render", "running", 50, 4), ("j", "cast", "failed", 1, 1)]
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r.job_id, r.stage] = (r.state, r.attempts, r.started_at, r.finished_at)

    for part in (changes[:3], changes[3:]):
        frame(spark, part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.stage_states(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == {("j", "cast"): ("done", 2, 30, 40), ("k", "cast"): ("running", 1, 5, None), ("j", "render"): ("running", 1, 50, None)}


def test_chapters_are_published_once(spark, tmp_path):
    from folio.streaming import ledger as stream

    schema = "book_id string, ch int, v int"
    frame(spark, [("b", 1, 1), ("b", 2, 1)], schema).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream.publish_chapters(source(), f"{tmp_path}/out", f"{tmp_path}/cp1").awaitTermination()
    frame(spark, [("b", 2, 7)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream.publish_chapters(source(), f"{tmp_path}/out", f"{tmp_path}/cp1").awaitTermination()
    want = [("b", 1, 1), ("b", 2, 7)]
    assert sorted((r.book_id, r.ch, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    only = spark.read.schema(schema).parquet(f"{tmp_path}/in").where("v <> 1 or ch = 1")
    only.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "ch").parquet(f"{tmp_path}/out")
    assert sorted((r.book_id, r.ch, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_cache_keys(spark):
    plan, cached, made = (frame(spark, [(k,) for k in ks], "clip_key string") for ks in ("aabc", "ab", "b"))
    assert [r.clip_key for r in cache.hit_rows(plan, cached, made).collect()] == ["a", "a"]
    rows = frame(spark, [("x", "2024-01-01 00:00:00"), ("y", "2024-01-01 00:09:00")], "k string, w string").select("k", F.to_timestamp("w").alias("written_at"))
    assert [r.k for r in cache.fresh(rows, F.to_timestamp(F.lit("2024-01-01 00:10:00")), 100).collect()] == ["y"]
    chunks = frame(spark, [("{}", "f"), ("{}", "g")], "chunk_json string, cast_fingerprint string")
    assert len({r.analysis_key for r in cache.analysis_keys(chunks, {"family": "a", "version": "1", "model": "m"}).collect()}) == 2


def test_mix_chapters(spark):
    rate, rng = 1_000, np.random.default_rng(2)
    tone = lambda n, a: (a * np.sin(np.arange(n))).tolist()
    schema = "book_id string, ch int, track string, start_ms long, gain_db double, samples array<double>"
    rows = []
    for ch, loud in ((1, 0.2), (2, 1.2)):
        rows += [("b", ch, "voice", 500, 0.0, tone(2_000, 0.3)), ("b", ch, "voice", 9_000, 0.0, tone(3_000, 0.3)), ("b", ch, "music", 0, -6.0, tone(14_000, 0.2)), ("b", ch, "sfx", 4_000, 0.0, tone(500, loud)), ("b", ch, "ambient", 0, 0.0, tone(6_000, 0.05))]
    got = mix.mix_chapters(frame(spark, rows, schema), rate, 5_000).orderBy("ch", "bucket").collect()
    assert [r.start for r in got if r.ch == 1] == [0, 5_000, 10_000] and all(len(r.voice) == len(r.music) == len(r.sfx) == len(r.mix) for r in got)
    assert not any(r.limited for r in got if r.ch == 1) and all(r.limited for r in got if r.ch == 2)
    one = {k: np.concatenate([np.array(r[k], int) for r in got if r.ch == 1]) for k in ("voice", "music", "sfx", "mix")}
    assert (one["voice"] + one["music"] + one["sfx"] == one["mix"]).all() and len(one["mix"]) == 14_000
    speaks = np.zeros(700, bool)
    for a, b in ((500, 2_500), (9_000, 12_000)):
        speaks[a // 20 : b // 20] = True
    held = np.zeros(700, bool)
    held[200:225] = True
    gain = np.interp(np.arange(14_000), np.arange(700) * 20 + 10, signal.duck_gain(speaks, 0.0, 5.0, 1200, held))
    want = np.round(np.clip(np.array(tone(14_000, 0.2)) * 10 ** (-6 / 20) * gain, -1, 1) * 32767)
    assert np.abs(one["music"] - want).max() <= 1 and gain[7_500] > 1.6 and gain[1_500] < 1.1
    placements = frame(spark, [("b", 1, "k", 0, 250, 10, 10, True), ("b", 1, "k", 0, 50, 0, 0, False), ("b", 1, "z", 0, 50, 0, 0, False)], "book_id string, ch int, clip_key string, start_ms long, end_ms long, fade_in_ms int, fade_out_ms int, loop boolean")
    fitted = mix.fitted_clips(placements, frame(spark, [("k", [0.5] * 100)], "clip_key string, samples array<double>"), rate).collect()
    assert sorted(len(r.samples) for r in fitted) == [50, 250]
    done = mix.finished_clips(frame(spark, [(2_000, tone(4_000, 0.01) + [0.0] * 4_000)], "rate int, samples array<double>"), rate, True).first()
    assert done.rate == rate and 1_900 < len(done.samples) < 2_200


def test_a_chapter_from_script_to_sound(spark):
    from folio.operators import providers, render
    from folio.sources.stored import stored

    rate = 1_000
    seg = segments(spark, [(1, "NARRATOR", "Crash went the door. It was late and dark.", "calm", False, 0), (2, "A", "Hello there.", "calm", False, 0), (3, "NARRATOR", " ", "calm", False, 0), (4, "NARRATOR", "Rain fell.", "calm", True, 0)])
    cast = frame(spark, [("b", "NARRATOR", "v0", 1, 0.5, 0.75, 0.0, 1.0, 0.0)], "book_id string, character string, voice_id string, seed long, stability double, similarity_boost double, style double, speed double, pitch_shift double")
    jobs = stored(speech.plan_tts(seg, cast, 25), "jobs")
    plan = jobs.select(F.col("book_id").alias("job_id"), F.concat_ws("/", "idx", "piece").alias("ord"), "clip_key", "text")

    def tone(requests):
        import pyarrow as pa

        n = [10 * len(t) for t in requests.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array([[0.25] * k for k in n], pa.list_(pa.float64())), pa.array([k / 10 for k in n]), pa.nulls(len(n), pa.string())], ["duration_ms", "samples", "units", "problem"])

    made = providers.serve(plan, frame(spark, [], "clip_key string"), providers.Provider("tts", "tone", "characters", tone, "duration_ms int, samples array<double>", 2))
    assert made.clips.count() == 4 and made.failed.count() == 0 and sum(r.units for r in made.usage.collect()) == 20 + 21 + 12 + 10
    again = providers.serve(plan, made.clips.select("clip_key"), providers.Provider("tts", "tone", "characters", lambda _: 1 / 0, "duration_ms int"))
    assert again.clips.count() == 0 and [r.cache_hit for r in again.usage.collect()] == [True] * 4
    cues = frame(spark, [("b", 1, 0, "s0", "crash", "crash", "impact", 1000, 0.9), ("b", 1, 1, "s3", "rain", "rain", "ambient", 9000, 0.3)], "book_id string, ch int, ord int, span_id string, anchor_text string, description string, kind string, duration_ms int, intensity double")
    anchored = script.anchored_cues(cues, seg)
    regions = script.music_regions(frame(spark, [], "book_id string, ch int, idx int, ord int, action string, mood string, energy double"), frame(spark, [("b", 1, 4, "none")], "book_id string, ch int, n_spans int, prior_mood string"))
    placed = render.chapter_placements(seg, jobs, made.clips.select("clip_key", "duration_ms"), anchored, regions, F.col("book_id"))
    placed = stored(placed, "placements")
    rows = placed.collect()
    voice = sorted((r.start_ms, r.end_ms, r.ref) for r in rows if r.track == "voice")
    assert voice[:2] == [(2100, 2300, "s0"), (2420, 2630, "s0")] and voice[2][0] == 2630 + 650 and len(voice) == 4
    assert {(r.track, r.fade_in_ms, r.fade_out_ms, r.loop) for r in rows} == {("voice", 10, 10, False), ("sfx", 20, 200, False), ("ambient", 800, 1500, True), ("music", 1500, 3000, True)}
    told = {(r.ref, r.description, r.mood) for r in render.chapter_cues(placed, anchored, regions).collect()}
    assert told == {("c1x001", "crash", None), ("c1x002", "rain", None), ("music1", None, "calm")}
    others = placed.where("track <> 'voice'").select("clip_key").distinct().withColumn("samples", F.array_repeat(F.lit(0.1), 500))
    mixed = render.rendered_chapters(placed, made.clips.select("clip_key", "samples").unionByName(others), rate).orderBy("bucket").collect()
    sound = np.concatenate([np.array(r.voice) for r in mixed])
    assert sound[2_200] == round(0.25 * 32767) and sound[2_350] == 0 and sound[2_500] == round(0.25 * 32767)


def test_chain_takes_up_kept_results(spark):
    import json

    from folio.operators import chain

    calls = frame(spark, [("b", k, t) for k, t in enumerate(["Ann", "Bob", "Ann", None, "Cy", "Bob"])] + [("c", 0, "Ann")], "book_id string, ord int, text string")
    seen = chain.Analysis(lambda chunk, cast: {"new": chunk["text"] not in cast}, lambda cast, told: cast, [])
    assert all(json.loads(r.result)["new"] for r in chain.analysis_chain(calls, seen).collect())
    names = chain.Analysis(lambda chunk, cast: sorted({*cast, chunk["text"] or ""} - {""}), lambda cast, told: told, [])
    first = chain.analysis_chain(calls, names).cache()
    assert not any(r.reused for r in first.collect()) and {r.book_id for r in chain.last_states(first).collect()} == {"b", "c"}
    assert all(r.reused for r in chain.analysis_chain(calls, names, first).collect())
    swapped = frame(spark, [("b", k, t) for k, t in enumerate(["Bob", "Ann", "Ann", None, "Cy", "Dora", "Bob"])], "book_id string, ord int, text string")
    again = chain.analysis_chain(swapped, names, first).orderBy("ord").collect()
    assert [r.reused for r in again] == [False, False, True, True, True, False, False] and json.loads(again[-1].result) == ["Ann", "Bob", "Cy", "Dora"]
    other = chain.Analysis(names.analyze, names.advance, [], "2")
    assert not any(r.reused for r in chain.analysis_chain(calls, other, first).collect())
    assert chain.analysis_chain(calls.limit(0), names, first).count() == 0


def test_overrides(spark):
    people = frame(spark, [("b", 0, "Thomas", ["Tom"]), ("b", 1, "Ann", None)], "book_id string, ord int, name string, aliases array<string>")
    assigned = frame(spark, [("b", "NARRATOR", "n"), ("b", "Thomas", "v1"), ("b", "Ann", "v2")], "book_id string, character string, voice_id string")
    asked = frame(spark, [("b", 0, "mr. tom", "v8"), ("b", 1, "Tom", "v9"), ("b", 2, "narrator", "v7"), ("b", 3, "Who", "v9"), ("b", 4, "Ann", "none")], "book_id string, ord int, name string, voice_id string")
    known, unknown = casting.checked_overrides(asked, frame(spark, [("v7",), ("v8",), ("v9",)], "id string"))
    assert [r.name for r in unknown.collect()] == ["Ann"]
    assert {r.character: (r.voice_id, r.source) for r in casting.overridden(assigned, known, people).collect()} == {"NARRATOR": ("v7", "override"), "Thomas": ("v9", "override"), "Ann": ("v2", "auto")}
