"""Reading books, pages and sounds from files, many at a time."""

from __future__ import annotations

import io
import posixpath
import wave
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio.functions import text as T

SUFFIXES = ("txt", "md", "markdown", "epub")
#: Words of a book at least, and of a document before the first section; how much shorter a paragraph's last line is.
MIN_WORDS, FRONT_WORDS, SHORT_LINE = 50, 100, 0.6
#: Pages that are parsed at a time.
PAGES_AT_ONCE = 64
_BLOCKS = {"p", "div", "li", "ul", "ol", "blockquote", "section", "article", "table", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "body"}
_SKIPPED = {"script", "style", "head", "title"}


def decode_text(content: bytes) -> str:
    """UTF-8 (with or without a mark), else Windows-1252, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.skip, self.kind = 0, "text"

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((self.kind, text))
        self.parts, self.kind = [], "text"

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _BLOCKS:
            self.flush()
            self.kind = "heading" if tag in ("h1", "h2") else "text"
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "hr":
            self.flush()
            self.out.append(("text", "***"))

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    """Headings and texts of a page, in order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def parsed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages. PAGES_AT_ONCE pages of a batch are parsed and given on at a time, so that a task holds their blocks and not those of all the batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, PAGES_AT_ONCE):
            some = batch.slice(start, PAGES_AT_ONCE)
            rows = [(p, n, kind, text) for p, h in zip(some.column("page_id").to_pylist(), some.column("html"), strict=True) for n, (kind, text) in enumerate(html_blocks(h.as_py()))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["page_id", "n", "kind", "text"])


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, n, kind, text) of pages (page_id, html)."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(parsed_pages, "page_id long, n int, kind string, text string")


def epub_sections(content: bytes) -> tuple[str | None, list[tuple[str, list[str]]]]:
    """Title and sections (heading, paragraphs) of an EPUB, in the order of its spine.

    Level-one and level-two headings open sections. Documents of under FRONT_WORDS words before the first section (covers, lists of
    contents) are left out, and so is the navigation; what else comes before the first heading is a Prologue. Without any
    heading there is one section without a name."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        package = ElementTree.fromstring(book.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        root = ElementTree.fromstring(book.read(package))
        items = {i.get("id"): i for i in root.findall(".//{*}item") if "nav" not in (i.get("properties") or "").split()}
        title = next((" ".join(t.text.split()) for t in root.findall(".//{*}title") if t.text and t.text.strip()), None)
        spine = [items[r.get("idref")] for r in root.findall(".//{*}itemref") if r.get("idref") in items]
        names = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(i.get("href")))) for i in spine]
        documents = [html_blocks(book.read(n).decode("utf-8", "replace")) for n in names]
    sections: list[tuple[str, list[str]]] = [("Prologue" if any(kind == "heading" for d in documents for kind, _ in d) else "", [])]
    for blocks in documents:
        if len(sections) == 1 and not (sections[0][0] == "" and sections[0][1]) and sum(len(text.split()) for _, text in blocks) < FRONT_WORDS:
            continue
        for kind, text in blocks:
            if kind == "heading" and sections[0][0]:
                sections.append((text, []))
            else:
                sections[-1][1].append(text)
    return title, [x for k, x in enumerate(sections) if k or x[1] or not x[0]]


def epub_text(content: bytes) -> tuple[str | None, str]:
    """Title of an EPUB, and its text with section headings as markdown."""
    title, sections = epub_sections(content)
    return title, "\n\n".join(p for name, paragraphs in sections for p in ([f"# {name}"] if name else []) + paragraphs)


def without_page_numbers(page: Column) -> Column:
    """A page without blank lines and lines of a page number at its top and bottom."""
    number = r"[^\S\n]*(?:(?:page\s+)?\d{1,4})?[^\S\n]*"
    lines = F.regexp_replace(page, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, rf"(?i)\A(?:{number}\n)+(?:{number}\z)?", ""), rf"(?i)(?:\n{number})+\z|\A{number}\z", "")


def unwrap_lines(text: Column) -> Column:
    """Paragraphs of hard-wrapped text: a hyphen at a line's end is joined up; a paragraph ends at a blank line, before and
    after a heading, and where a line ends like a sentence and is much shorter than the middle one of all lines."""
    lines = F.split(F.regexp_replace(text, r"(?U)(\w)-\n(?=[a-z])", "$1"), "\n")
    sizes = F.sort_array(F.transform(F.filter(lines, lambda x: T.strip(x) != ""), lambda x: F.length(x)))
    middle = F.coalesce(F.try_element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1), F.lit(0))

    def placed(line: Column, middle: Column) -> Column:
        own = T.strip(line)
        head = T.heading_title(own).isNotNull()
        ends = own.rlike("[.!?\"'”’»:]$") & (F.length(own) < SHORT_LINE * middle)
        return F.when(own == "", "\n\n").otherwise(F.concat(F.when(head, "\n\n").otherwise(""), own, F.when(head | ends, "\n\n").otherwise(" ")))

    sized = F.struct(lines.alias("lines"), middle.alias("middle"))
    joined = F.transform(F.array(sized), lambda x: F.array_join(F.transform(x["lines"], lambda line: placed(line, x["middle"])), ""))[0]
    return T.strip(F.regexp_replace(joined, r" *\n\n[\n ]*", "\n\n"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book_id (SHA-256 of the file), filename, title (of an EPUB), text and error of every file under a path. A file of another kind than .txt, .md,
    .markdown and .epub, one that cannot be read, and one of under 50 words has an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.sha2("content", 256).alias("book_id"), "content")

    def read(name: str, content: bytes) -> tuple[str | None, str | None, str | None]:
        try:
            suffix = name.rpartition(".")[2].lower()
            if suffix not in SUFFIXES:
                return None, None, f"no file type that is read: {suffix}"
            title, text = epub_text(content) if suffix == "epub" else (None, decode_text(content))
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, TypeError) as x:
            return None, None, f"cannot be read: {x!r}"
        return (title, text, None) if len(text.split()) >= MIN_WORDS else (None, None, f"fewer than {MIN_WORDS} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [p.rpartition("/")[2] for p in batch.column("path").to_pylist()]
            found = [read(n, c.as_py()) for n, c in zip(names, batch.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array(names), *[pa.array([f[k] for f in found], pa.string()) for k in range(3)]], ["book_id", "filename", "title", "text", "error"])

    return files.mapInArrow(run, "book_id string, filename string, title string, text string, error string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents of a known schema; one that does not fit it is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def titled(books: DataFrame, paras: DataFrame) -> DataFrame:
    """books (book_id, filename, title) with title: its own, else the first paragraph if that is short and no heading of a chapter,
    else the file's name without its ending."""
    first = paras.where("para = 1").select("book_id", T.strip(F.col("text")).alias("_first"))
    short = (F.length("_first") <= T.MAX_HEADING_CHARS) & (T.word_count(F.col("_first")) <= T.MAX_TITLE_WORDS)
    chapter = F.coalesce(T.heading_kind(F.col("_first")), F.lit("")).isin("keyword", "number")
    name = F.regexp_replace("_first", r"^#{1,6}\s+|\s+#+\s*$", "")
    found = books.join(first, "book_id", "left").withColumn("title", F.coalesce("title", F.when(short & ~chapter, name), F.regexp_replace("filename", r"\.[^.]*$", "")))
    return found.drop("_first")


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of PCM with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, np.dtype(f"<i{width}")) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(1)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_wav(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([r for r, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["path", "rate", "samples"])

    return files.mapInArrow(run, "path string, rate int, samples array<double>")
