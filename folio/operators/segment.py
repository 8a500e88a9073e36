"""From texts to paragraphs, chapters, spans and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions import text as T
from folio.functions.arrays import running
from folio.schema import QUOTE_STYLES

MIN_CHAPTER_WORDS, PART_WORDS, CONTEXT_PARAGRAPHS, SEPARATOR_CHARS = 100, 6000, 2, 2
MARKS = {"double": '["“”„‟]', "single": "['‘’‚‛]", "guillemet": "[«»‹›]", "dash": "(?:—|–|--)"}


def paragraphs(books: DataFrame) -> DataFrame:
    """(book_id, para, text, scene_break_before) from (book_id, text).

    Lines are blank, markdown headings (a block of their own) or text; a block is a run of text
    lines. Two blank lines in a row, or a marker line of its own block, break the scene before the next
    paragraph. Everything is a window over one book's lines."""
    lines = books.select("book_id", F.posexplode(F.split(T.normalize_text(F.coalesce("text", F.lit(""))), "\n")).alias("n", "line"))
    order = Window.partitionBy("book_id").orderBy("n")
    blank, head = T.strip(F.col("line")) == "", T.strip(F.col("line")).rlike(T.MARKDOWN)
    marked = lines.withColumns({"blank": blank, "head": head})
    cut = F.col("blank") | F.col("head") | F.coalesce(F.lag("head").over(order), F.lit(False))
    gap = F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(False))
    marked = marked.withColumn("block", F.sum(cut.cast("int")).over(order)).withColumn("wide", F.sum(gap.cast("int")).over(order))
    blocks = marked.where(~F.col("blank")).groupBy("book_id", "block").agg(
        T.collapse_whitespace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ")).alias("text"),
        F.min("wide").alias("wide"),
    )
    flow = Window.partitionBy("book_id").orderBy("block")
    wide = F.col("wide") > F.coalesce(F.lag("wide").over(flow), F.lit(0))
    flagged = blocks.withColumn("own", wide)
    return scene_flags(flagged.select("book_id", F.col("block").alias("para"), "text", F.col("own").alias("scene_break_before")))


def scene_flags(blocks: DataFrame) -> DataFrame:
    """Marker paragraphs go; the paragraph after them is flagged. Paragraphs are numbered from 1."""
    order = Window.partitionBy("book_id").orderBy("para")
    mark = T.is_scene_marker(F.col("text"))
    flagged = blocks.withColumn("_mark", mark).withColumn("_flag", F.col("scene_break_before") | F.coalesce(F.lag("_mark").over(order), F.lit(False)))
    kept = flagged.where(~F.col("_mark"))
    return kept.select("book_id", F.row_number().over(order).alias("para"), "text", F.col("_flag").alias("scene_break_before"))


def headings(paras: DataFrame) -> DataFrame:
    """paras with title (null for text). With two strong headings in a book, a line in capitals is a heading only if it
    follows a kept one directly or ends the book: a run of heading lines is kept from its first strong one on."""
    return _kept_headings(paras.withColumns({"_title": T.heading_title(F.col("text")), "_strong": T.strong_heading(F.col("text"))}))


def _kept_headings(found: DataFrame) -> DataFrame:
    """The rows with title, from _title (what a line would be called as a heading) and _strong; neither text nor these columns are needed any more."""
    order, book = Window.partitionBy("book_id").orderBy("para"), Window.partitionBy("book_id")
    is_head = F.col("_title").isNotNull()
    run = found.withColumn("_run", F.sum((~is_head).cast("int")).over(order)).withColumns({"_n_strong": F.sum(F.col("_strong").cast("int")).over(book), "_last": F.max("para").over(book)})
    before = F.max(F.when(F.col("_title").isNotNull(), F.col("_strong").cast("int"))).over(Window.partitionBy("book_id", "_run").orderBy("para"))
    kept = (F.col("_n_strong") < 2) | (before == 1) | (F.col("para") == F.col("_last"))
    out = run.withColumn("title", F.when(is_head & kept, F.col("_title")))
    return out.select(*[c for c in found.columns if c not in ("_title", "_strong")], "title")


def sections(headed: DataFrame) -> DataFrame:
    """headed with section: 0 before the first heading, then counted up at each."""
    return headed.withColumn("section", F.sum(F.col("title").isNotNull().cast("int")).over(Window.partitionBy("book_id").orderBy("para")))


def merge_short(chapters: DataFrame, least: int = MIN_CHAPTER_WORDS) -> DataFrame:
    """(book_id, ch, title, words) with group: short chapters join the next long one, those at the end the last long one, and a
    book of short chapters is one group."""
    order, book = Window.partitionBy("book_id").orderBy("ch"), Window.partitionBy("book_id")
    long_ = (F.col("words") >= least).cast("int")
    before = F.coalesce(F.sum(long_).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chapters.withColumn("group", F.greatest(F.lit(0), F.least(before, F.sum(long_).over(book) - 1)).cast("int"))


def synthetic_parts(paras: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(book_id, para, words) with part (from 0): parts of about part_words words."""
    order, book = Window.partitionBy("book_id").orderBy("para"), Window.partitionBy("book_id")
    total = F.sum("words").over(book)
    n = F.greatest(F.lit(1), F.ceil(total / part_words))
    seen = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = paras.withColumns({"_n": n, "_total": total, "_seen": seen})
    part = F.least(F.floor(F.col("_seen") * F.col("_n") / F.greatest(F.col("_total"), F.lit(1))), F.col("_n") - 1)
    return sized.select(*paras.columns, part.cast("int").alias("part"))


def detect_chapters(paras: DataFrame) -> DataFrame:
    """(book_id, ch, title, para, text, scene_break_before): headings open chapters, short ones are merged, text before the first
    heading is a Prologue if it has prose (its first short paragraph is the book's name), and a book with fewer than two headings is cut into parts."""
    # All windows are over what is known of a paragraph; its text is joined at the end, once.
    text = F.col("text")
    light = paras.select("book_id", "para", "scene_break_before", F.length("text").alias("chars"), T.word_count(text).alias("words"), T.heading_title(text).alias("_title"), T.strong_heading(text).alias("_strong"))
    headed = sections(_kept_headings(light))
    book = Window.partitionBy("book_id")
    names = (F.col("section") == 0) & (F.col("chars") <= T.MAX_HEADING_CHARS) & (F.col("words") <= T.MAX_TITLE_WORDS)
    headed = headed.withColumn("_name", F.min(F.when(names, F.col("para"))).over(book))
    counted = headed.withColumn("_heads", F.sum(F.col("title").isNotNull().cast("int")).over(book))
    none = counted.where("_heads < 2")
    parts = synthetic_parts(none.select("book_id", "para", "scene_break_before", "words"))
    cut = parts.select("book_id", (F.col("part") + 1).alias("ch"), F.concat(F.lit("Part "), (F.col("part") + 1).cast("string")).alias("title"), "para", "scene_break_before")
    some = counted.where("_heads >= 2").where(~F.col("para").eqNullSafe(F.col("_name")))
    size = some.groupBy("book_id", "section").agg(F.max("title").alias("title"), F.sum(F.when(F.col("title").isNull(), F.col("words")).otherwise(0)).alias("words"), F.max(F.when(F.col("title").isNull(), F.col("words"))).alias("longest"))
    size = size.where((F.col("section") > 0) | (F.col("longest") > T.MAX_TITLE_WORDS) | (F.col("words") > MIN_CHAPTER_WORDS)).withColumn("title", F.coalesce("title", F.lit("Prologue")))
    grouped = merge_short(size.withColumnRenamed("section", "ch"))
    name = F.coalesce(F.max_by("title", F.when(F.col("words") >= MIN_CHAPTER_WORDS, F.col("ch"))), F.min_by("title", "ch"))
    titles = grouped.groupBy("book_id", "group").agg(name.alias("chapter_title"))
    body = some.where("title is null").drop("title", "_name").join(grouped.select("book_id", F.col("ch").alias("section"), "group"), ["book_id", "section"]).join(titles, ["book_id", "group"])
    placed = cut.unionByName(body.select("book_id", (F.col("group") + 1).alias("ch"), F.col("chapter_title").alias("title"), "para", "scene_break_before"))
    return placed.join(paras.select("book_id", "para", "text"), ["book_id", "para"]).select("book_id", "ch", "title", "para", "text", "scene_break_before")


def quote_style(paras: DataFrame) -> DataFrame:
    """(book_id, style): the mark that most paragraphs open with, at least three; ties in the order of QUOTE_STYLES."""
    opens = F.lit(None)
    for style in reversed(QUOTE_STYLES):
        opens = F.when(F.col("text").rlike(rf"^\s*{MARKS[style]}"), style).otherwise(opens)
    counts = paras.groupBy("book_id").agg(*[F.count_if(opens == s).alias(s) for s in QUOTE_STYLES])
    most = F.greatest(*QUOTE_STYLES)
    best = F.lit("double")
    for style in reversed(QUOTE_STYLES):
        best = F.when(F.col(style) == most, style).otherwise(best)
    return counts.select("book_id", F.when(most >= 3, best).otherwise("double").alias("style"))


# What may stand before a single quote that opens speech and after one that closes it, and dashed speech: the dash that
# opens it, a dash that breaks it, a tag of speech, and the end of a sentence that narration goes on after.
OPENS_AFTER, CLOSES_BEFORE = " \\t\\n(\\[{—–\\-\"“", " \\t\\n.,;:!?)\\]}\"”—–\\-"
DASH_OPENER = r"^\s*(?:—|–|--)"
DASH_BREAK = r"(?<=\s)(?:—|–|--)(?=\s)"
DASH_VERBS = (
    r"(?:said|says|asked|asks|replied|answered|shouted|whispered|muttered|murmured|cried|called|added|sighed|laughed|"
    r"snapped|growled|hissed|repeated|insisted|demanded|dijo|preguntó|respondió|gritó|murmuró|contestó|dit|demanda|"
    r"répondit|murmura|cria|ajouta|sagte|fragte|antwortete|rief|flüsterte|murmelte)"
)
DASH_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
DASH_TAG = rf",\s+(?:{DASH_VERBS}\s+(?:{DASH_NAME}|he|she|they|I|il|elle|er|sie|él|ella)\b|(?:{DASH_NAME}|he|she|they|I|il|elle|er|sie|él|ella)\s+{DASH_VERBS}\b)"
DASH_SENTENCE_END = (
    r"[.!?][\"'”’)]*\s+(?=(?:he|she|they|He|She|They)\b|"
    rf"(?!(?:I|You|We|Yes|No|Not|Then|But|And|Or|So|If|What|Why|How|When|Where|Who|Oh|Ah)\b){DASH_NAME}\s+[a-z])"
)


def _single_speech() -> str:
    """A pattern for a whole piece of speech in single quotes; group 1 is what is said. Speech that is not closed runs to the end.

    A quote opens speech where a word could begin, and closes it where one could end. One that a sentence goes on after
    (a letter before it, a blank and a small letter after it) is an apostrophe if a later quote closes the speech before
    another could open one; quotes within words are apostrophes anyway."""
    mark = MARKS["single"]
    opener, closer = f"(?<=^|[{OPENS_AFTER}]){mark}", f"{mark}(?=\\z|[{CLOSES_BEFORE}])"
    within = f"(?<!^|[{OPENS_AFTER}]){mark}(?!\\z|[{CLOSES_BEFORE}])"
    neither = f"[^{mark[1:]}*+(?:{within}[^{mark[1:]}*+)*+"
    goes_on = f"(?<=\\p{{L}}{mark})(?= \\p{{Ll}})(?={neither}(?<!^|[{OPENS_AFTER}]){closer})"
    return f"(?s){opener}(.*?)(?:{closer}(?!{goes_on})|\\z)"


SINGLE_SPEECH = _single_speech()


def _piece(kind: Column | str, text: Column, start: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("raw"), T.strip(text).alias("text"), start.cast("int").alias("start"))


def _marked_pieces() -> Column:
    """Narration and speech in turn, from the parts between marks and where each ends (ends, the mark after it included)."""
    each = F.arrays_zip(F.col("parts").alias("part"), F.concat(F.array(F.lit(0)), F.col("ends")).alias("at"))
    return F.transform(F.slice(each, 1, F.size("parts")), lambda z, k: _piece(F.when(k % 2 == 0, "narration").otherwise("quote"), z["part"], z["at"]))


def _dashed_pieces() -> Column:
    """Speech and narration in turn from the parts between breaking dashes, and speech once more after speech that narration
    ended. `cut` tells where in a part speech would end."""
    parts = F.arrays_zip(F.col("parts").alias("part"), F.concat(F.array(F.lit(0)), F.col("ends")).alias("at"), F.col("cut").alias("cut"))
    start = F.struct(F.lit(True).alias("speech"), F.array().cast("array<boolean>").alias("out"))
    turn = lambda a, cut: F.struct((~a["speech"] | cut.isNotNull()).alias("speech"), F.array_append(a["out"], a["speech"]).alias("out"))
    turns = F.aggregate("cut", start, turn)["out"]

    def pieces(z: Column, speech: Column) -> Column:
        part, at, cut = z["part"], F.col("lead") + z["at"], z["cut"]
        both = F.array(_piece("quote", F.left(part, cut), at), _piece("narration", F.right(part, F.length(part) - cut), at + cut))
        return F.when(speech & cut.isNotNull(), both).otherwise(F.array(_piece(F.when(speech, "quote").otherwise("narration"), part, at)))

    return F.flatten(F.zip_with(parts, turns, pieces))


def split_spans(paras: DataFrame) -> DataFrame:
    """Spans of paragraphs (book_id, ch, para, text, style) in any quote style. Marks stay outside the spans; spans are
    trimmed and numbered in their paragraph; speech that is not closed runs to its end.

    All of it is one projection of each paragraph: nothing is shuffled, and offsets are running sums of the lengths before."""
    key = ["book_id", "ch", "para", "style"]
    text, style = F.coalesce("text", F.lit("")), F.col("style")
    dashed = style == "dash"
    paras = paras.withColumn("style", F.coalesce("style", F.lit(QUOTE_STYLES[0])))
    rows = paras.select(*key, text.alias("text"), F.when(dashed, F.regexp_extract(text, f"(?U){DASH_OPENER}", 0)).otherwise("").alias("opener"))
    rows = rows.select(*key, F.length("opener").alias("lead"), F.expr("substring(text, length(opener) + 1)").alias("text"))
    plain = dashed & (F.col("lead") == 0)

    # Parts in turn: between marks, around pieces of speech in single quotes, or between breaking dashes.
    around, said = F.split("text", SINGLE_SPEECH, -1), F.regexp_extract_all("text", F.lit(SINGLE_SPEECH), F.lit(1))
    parts = F.when(style == "single", F.flatten(F.zip_with(around, said, lambda a, b: F.array_compact(F.array(a, b))))).when(plain, F.array("text")).when(dashed, F.split("text", f"(?U){DASH_BREAK}", -1))
    for name in ("double", "guillemet"):
        parts = parts.when(style == name, F.split("text", MARKS[name], -1))
    breaks = F.when(dashed & ~plain, F.transform(F.regexp_extract_all("text", F.lit(f"(?U){DASH_BREAK}"), F.lit(0)), lambda x: F.length(x))).otherwise(F.array().cast("array<int>"))
    found = rows.select(*key, "lead", parts.alias("parts"), breaks.alias("breaks"))
    last = F.size("parts") - 1

    def cut(part: Column, k: Column) -> Column:
        """Where a tag of speech begins, or a sentence ends before a further dash, whichever comes first; null where nothing is said before.
        Letters, blanks and words' ends are those of any script."""
        before = lambda p: F.length(F.regexp_extract(part, f"(?Us)^{p}", 1))
        tagged, ended = part.rlike(f"(?U){DASH_TAG}"), part.rlike(f"(?U){DASH_SENTENCE_END}")
        at = F.least(F.when(tagged, before(f"(.*?){DASH_TAG}")), F.when((k < last) & ended, before(f"(.*?{DASH_SENTENCE_END})")))
        return F.when(T.strip(F.substring(part, F.lit(1), at)) != "", at)

    steps = F.transform("parts", lambda x, k: F.length(x) + F.when(dashed, F.coalesce(F.get("breaks", k), F.lit(0))).otherwise(1))
    cuts = F.when(dashed & ~plain, F.transform("parts", cut)).otherwise(F.array().cast("array<int>"))
    stepped = found.select(*key, "lead", "parts", cuts.alias("cut"), steps.alias("steps")).withColumn("ends", F.slice(running(F.col("steps")), 1, F.size("parts") - 1))
    pieces = F.when(dashed & ~plain, _dashed_pieces()).otherwise(_marked_pieces())
    spans = stepped.select("book_id", "ch", "para", F.filter(pieces, lambda x: F.coalesce(x["text"], F.lit("")) != "").alias("spans"))
    # The outer form, as for the inner one Spark would work out all of this once more to drop paragraphs without spans before.
    out = spans.select("book_id", "ch", "para", F.posexplode_outer("spans").alias("s", "x")).where(F.col("x").isNotNull())
    begins = F.col("x.start") + F.expr("instr(x.raw, x.text)") - 1  # a piece without white space at its ends begins where it is first found
    placed = out.select("book_id", "ch", "para", "s", F.format_string("c%dp%ds%d", "ch", "para", "s").alias("span_id"), "x.kind", "x.text", begins.cast("int").alias("start_char"))
    return placed.withColumn("end_char", F.col("start_char") + F.length("text"))


def span_totals(paras: DataFrame) -> DataFrame:
    """(book_id, spans, quotes, speech_chars): how many spans `split_spans` makes of each book's paragraphs (book_id, ch, para, text, style), how many are quotes, and
    how long all are together. Between marks that alternate, parts are counted where they lie; only the other styles are cut into spans."""
    style = F.coalesce("style", F.lit(QUOTE_STYLES[0]))
    marks = [name for name in QUOTE_STYLES if name in ("double", "guillemet")]
    parts = F.lit(None).cast("array<string>")
    for name in marks:
        parts = F.when(style == name, F.split(F.coalesce("text", F.lit("")), MARKS[name], -1)).otherwise(parts)
    sizes = F.transform(parts, lambda x: F.length(T.strip(x)))
    sized = paras.where(style.isin(marks)).select("book_id", sizes.alias("sizes"))
    some = lambda only: F.size(F.filter("sizes", only)).cast("long")
    counted = sized.select("book_id", some(lambda n: n > 0).alias("spans"), some(lambda n, k: (n > 0) & (k % 2 == 1)).alias("quotes"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("speech_chars"))
    rest = split_spans(paras.where(~style.isin(marks))).select("book_id", F.lit(1).cast("long").alias("spans"), (F.col("kind") == "quote").cast("long").alias("quotes"), F.length("text").cast("long").alias("speech_chars"))
    return counted.unionByName(rest).groupBy("book_id").agg(*[F.sum(c).alias(c) for c in ("spans", "quotes", "speech_chars")])


def alternating_spans(paras: DataFrame, style: str = "double") -> DataFrame:
    """Spans of paragraphs (book_id, ch, para, text) that are all in one style."""
    return split_spans(paras.withColumn("style", F.lit(style)))


def chunk_numbers(paras: DataFrame, max_chars: int) -> DataFrame:
    """(book_id, ch, para, length) with chunk: paragraphs packed in order, a chunk closed when the next would
    pass max_chars (paragraphs are joined by a blank line).

    Each paragraph's number depends on all before it in the chapter, so a chapter is read in order, once: sorted within its partition,
    in batches, with the open chunk's number and size carried along. Nothing of a chapter is gathered."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chapter, chunk, size = None, -1, 0
        for batch in batches:
            book, ch = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("book_id", "ch"))
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(length + SEPARATOR_CHARS)
            out = np.empty(len(length), np.int32)
            begins = np.flatnonzero(np.append(True, (book[1:] != book[:-1]) | (ch[1:] != ch[:-1]))[: len(length)]).tolist()
            for at, end in zip(begins, [*begins[1:], len(length)], strict=True):
                if (book[at], ch[at]) != chapter:
                    chapter, chunk, size = (book[at], ch[at]), 0, int(length[at])
                    out[at] = 0
                    at += 1
                while at < end:
                    # As many paragraphs as the open chunk has room for, at once.
                    before = int(upto[at - 1]) if at else 0
                    stop = min(end, int(np.searchsorted(upto, before + max_chars - size, side="right")))
                    if stop > at:
                        size += int(upto[stop - 1]) - before
                    else:
                        chunk, size, stop = chunk + 1, int(length[at]), at + 1
                    out[at:stop] = chunk
                    at = stop
            yield batch.append_column("chunk", pa.array(out))

    own = paras.select(F.col("book_id").cast("string"), F.col("ch").cast("int"), F.col("para").cast("int"), F.col("length").cast("long"))
    ordered = own.repartition("book_id", "ch").sortWithinPartitions("book_id", "ch", "para")
    return ordered.mapInArrow(pack, "book_id string, ch int, para int, length long, chunk int")


def context_before(paras: DataFrame) -> DataFrame:
    """paras with context: the two paragraphs before, joined by a blank line."""
    order = Window.partitionBy("book_id", "ch").orderBy("para")
    return paras.withColumn("context", F.concat_ws("\n\n", F.lag("text", 2).over(order), F.lag("text", 1).over(order)))


def carried_speakers(labelled: DataFrame) -> DataFrame:
    """(book_id, ch, idx, speaker) with last and other: the latest two distinct speakers before each row."""
    order = Window.partitionBy("book_id", "ch").orderBy("idx")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = labelled.withColumn("_before", F.lag("speaker").over(order))
    other = F.last(F.when(F.col("_before").isNotNull() & (F.col("_before") != F.col("speaker")), F.col("_before")), ignorenulls=True)
    return turned.withColumn("_other", other.over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"last": F.last("speaker", ignorenulls=True).over(prior), "other": F.lag("_other").over(order)}).drop("_before", "_other")
