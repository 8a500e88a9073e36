"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, and words near a
span move its score. All of it is one narrow projection: no shuffle, no Python. Patterns are
written so that no scan of a long run starts again at each of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.arrays import running
from folio.llm.arrays import cut, text_blocks

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base ones.
ADDED = ("iban", "card_short", "ssn")

# Fixed values. A run that a pattern starts in is entered at its first character, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
_DIGIT = "(?:\\G|(?<![0-9]))"
_RUN = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"{_DIGIT}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"{_RUN}{{15,18}}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "card_short": rf"{_RUN}{{12,14}}+(?![ -]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score of a kind without and with a word of its own nearby, and code points on each side that count as near.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.9, 1.0), "card_short": (0.4, 0.8), "ssn": (0.3, 0.8)}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account",
    "card_short": "card|amex|diners|credit|debit|payment",
    "ssn": "ssn|social|security",
}
NEAR = 40
LEAST_SCORE = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (1 + i % 2)) % 10 + F.when((i % 2 == 1) & (c.cast("int") >= 5), 1).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, x: (a + x).cast("int")) % 10 == 0


def mod97(value: Column) -> Column:
    """Remainder of an account number by ISO 7064: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    number = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: ((a * F.when(c.between("0", "9"), 10).otherwise(100) + number(c)) % 97).cast("int"))


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(999)) <= 255))
    if kind in ("card", "card_short"):
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (mod97(value) == 1)
    return F.lit(True)


def _spans(kind: str) -> Column:
    """Confirmed matches of a kind as spans. The row holds its matches (column kind), the end of each (kind_ends) and the text's blocks."""
    each = F.arrays_zip(F.col(kind).alias("value"), F.col(f"{kind}_ends").alias("end"))
    kept = F.filter(each, lambda s: _confirmed(kind, s["value"]))
    low, high = SCORES[kind]
    blocks = F.col("blocks")

    def scored(s: Column) -> Column:
        start = (s["end"] - F.length(s["value"])).cast("int")
        near = F.lower(F.concat(cut(blocks, F.greatest(start - NEAR, F.lit(0)), start), F.lit(" "), cut(blocks, s["end"], F.least(s["end"] + NEAR, F.col("n_chars")))))
        score = F.when(near.rlike(rf"\b(?:{WORDS[kind]})"), high).otherwise(low)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    spans = F.transform(kept, scored)
    if kind in ADDED:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(F.size(kind) > 0, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>"))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, spans, blocks and n_chars of each row. The texts between matches tell where each match lies; every step takes
    time in proportion to the text, and to n^1.5 for n matches."""
    kinds = [*BASE, *ADDED]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hint = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+"))}
    none = F.array().cast("array<string>")
    found = rows.select("doc_id", "text", *[F.when(hint.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(k) for k in kinds])

    def steps(k: str) -> Column:
        gaps = F.transform(F.split("text", PATTERNS[k], -1), lambda g: F.length(g))
        taken = F.zip_with(F.slice(gaps, 1, F.size(k)), F.col(k), lambda g, v: g + F.length(v))
        return F.when(F.size(k) > 0, taken).otherwise(F.array().cast("array<int>")).alias(f"{k}_steps")

    stepped = found.select("doc_id", *kinds, F.length("text").alias("n_chars"), text_blocks(F.col("text")).alias("blocks"), *[steps(k) for k in kinds])
    ended = stepped.select("doc_id", *kinds, "n_chars", "blocks", *[running(F.col(f"{k}_steps")).alias(f"{k}_ends") for k in kinds])
    return ended.select("doc_id", F.concat(*[_spans(k) for k in kinds]).alias("spans"), "blocks", "n_chars")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, value, score) by kind (base kinds first) and start.

    Offsets count code points, end exclusive. Base kinds (email, ip, card, phone) keep every confirmed
    match, leftmost first and without overlap within a kind; added kinds (iban, card_short, ssn) also
    need a score of LEAST_SCORE. Spans of different kinds may overlap. Null or empty text has no
    spans; texts of any length are read whole. Repeated rows give repeated results, a null doc_id
    stays null, other columns are ignored, and an empty table gives an empty result.
    """
    return _found(docs).select("doc_id", "spans")


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets: a row for each row of docs.

    Overlapping spans are merged first: of those that overlap, the earliest start names the kind (then the earliest
    end, then the kind in code-point order), and the text up to the last end goes. Null or empty text gives "", a text
    without spans comes back as it is, of any length. Repeated rows give repeated results, a null doc_id stays null, other
    columns are ignored, whatever their names, and an empty table gives an empty result.
    """
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    sorted_ = _found(docs).select("doc_id", ordered.alias("spans"), "blocks", "n_chars")
    ends = sorted_.withColumn("ends", F.transform("spans", lambda s: s["end"]))
    reached = ends.withColumn("reach", running(F.col("ends"), lambda a, x: F.greatest(a, x)))
    blocks = F.col("blocks")
    each = F.arrays_zip(F.col("spans").alias("span"), F.concat(F.array(F.lit(0)), F.col("reach")).alias("before"))
    part = lambda z: F.when(z["span"].isNull(), cut(blocks, z["before"], F.col("n_chars"))).when(z["span"]["start"] < z["before"], "").otherwise(F.concat(cut(blocks, z["before"], z["span"]["start"]), F.lit("["), z["span"]["kind"], F.lit("]")))
    return reached.select("doc_id", F.array_join(F.transform(each, part), "").alias("text"))
