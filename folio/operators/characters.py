"""The cast of a book as its analysis goes on: updates of characters and spoken lines, in order, and what is left at the end.

An update may rename or merge the person it speaks of, so that what the next one means depends on it: the updates of one
book are folded in order, many books side by side. All else (names that are part of one other name, silent descriptors,
unique descriptors) is joins and aggregates over all books.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folio.functions import text as T
from folio.schema import NARRATOR

# Titles that are no part of a name, and descriptors that can name the one person of such a kind.
TITLES = ("old", "young", "mr", "mrs", "ms", "miss", "dr", "captain", "sir", "lady", "lord", "aunt", "uncle")
ARTICLES = ("the", "a", "an")
DESCRIPTOR_TRAITS = {
    "the boy": ("male", "child"),
    "the girl": ("female", "child"),
    "the old man": ("male", "elderly"),
    "the old woman": ("female", "elderly"),
}
# Honorifics that names are compared without.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "sir", "lady", "lord", "captain", "capt", "professor", "prof", "madame", "master", "aunt", "uncle")
UNKNOWN = "unknown"
SCHEMA = "book_id string, ord int, name string, aliases array<string>, gender string, age string, description string, voice_notes string, first_chapter int, line_count int, provisional boolean"


def _key(name: str) -> str:
    """A name as it is compared (as text.normalize_name does)."""
    head, _, rest = name.strip().partition(" ")
    return " ".join((rest if rest.strip() and head.lower().removesuffix(".") in HONORIFICS else name).lower().split())


def _untitled(name: str) -> str:
    words = name.split()
    return " ".join(words[1:] if len(words) > 1 and words[0].lower().removesuffix(".") in TITLES else words)


def _described(name: str) -> bool:
    words = name.split()
    return len(words) > 1 and words[0].lower() in ARTICLES


def _part_of(one: str, other: str) -> bool:
    """Whether a name of one word is among the words of a longer one."""
    words = [_key(w) for w in other.split()]
    return " " not in _key(one) and len([w for w in words if w]) > 1 and _key(one) in words


@dataclass
class Person:
    name: str
    first_chapter: int
    provisional: bool
    aliases: dict[str, str] = field(default_factory=dict)  # by lower-cased words
    notes: dict[str, str] = field(default_factory=dict)
    traits: dict[str, str] = field(default_factory=dict)  # gender and age, once known
    description: str = ""
    lines: int = 0

    def agrees(self, traits: dict[str, str]) -> bool:
        return all(self.traits.get(k, v) == v for k, v in traits.items())

    def call(self, *names: str) -> None:
        for name in names:
            words = " ".join(name.split())
            if words and words.lower() != self.name.lower():
                self.aliases.setdefault(words.lower(), words)
        self.aliases.pop(self.name.lower(), None)

    def learn(self, traits: dict[str, str], description: str, notes: str) -> None:
        self.traits = traits | self.traits
        self.description = max(self.description, description, key=len)
        for note in filter(None, (n.strip() for n in notes.split(","))):
            self.notes.setdefault(note.lower(), note)


class Cast:
    """Persons in the order they came, and which of them each name means: the first that it was given to."""

    def __init__(self) -> None:
        self.people: list[Person] = []
        self.meant: dict[str, int] = {}

    def find(self, name: str | None) -> Person | None:
        at = self.meant.get(_key(name or ""))
        return None if at is None else self.people[at]

    def index(self, person: Person) -> None:
        at = next(k for k, p in enumerate(self.people) if p is person)
        for key in filter(None, map(_key, (person.name, *person.aliases.values()))):
            self.meant[key] = min(at, self.meant.get(key, at))

    def add(self, name: str, chapter: int) -> Person:
        plain = _untitled(name)
        person = Person(plain, chapter, _described(plain))
        self.people.append(person)
        person.call(name)
        return person

    def target(self, row: dict, traits: dict[str, str]) -> Person | None:
        """Whom an update speaks of: the person it is to be merged into, one of that name, one of its aliases without other traits,
        the only one whose name is part of its name or the other way round, or a descriptor that it mentions."""
        sure = self.find(row["merge_into"]) or self.find(row["name"])
        if sure:
            return sure
        fit = [p for p in self.people if p.agrees(traits)]
        called = next((p for a in row["aliases"] or () if (p := self.find(a)) is not None and p in fit), None)
        if called:
            return called
        related = [p for p in fit if not p.provisional and (_part_of(p.name, row["name"]) or _part_of(row["name"], p.name))]
        if len(related) == 1:
            return related[0]
        told = {_key(a) for a in row["aliases"] or ()}
        return next((p for p in fit if p.provisional and (_key(p.name) in told or _key(p.name) in (row["description"] or "").lower())), None)

    def update(self, row: dict) -> None:
        traits = {k: row[k] for k in ("gender", "age") if (row[k] or UNKNOWN) != UNKNOWN}
        person = self.target(row, traits)
        plain = _untitled(row["name"])
        if person is None:
            person = self.add(row["name"], row["ch"])
        elif _key(plain) != _key(person.name) and ((person.provisional and not _described(plain)) or _part_of(person.name, plain)):
            former, person.name, person.provisional = person.name, plain, False
            person.call(*(row["aliases"] or ()), row["name"], former)
        person.call(*(row["aliases"] or ()), row["name"], plain)
        person.learn(traits, row["description"] or "", row["voice_notes"] or "")
        self.index(person)

    def line(self, name: str, chapter: int) -> None:
        if _key(name) in ("", NARRATOR.lower()):
            return
        person = self.find(name)
        if person is None and (kind := DESCRIPTOR_TRAITS.get(" ".join(name.lower().split()))):
            fit = [p for p in self.people if not p.provisional and p.traits.get("age") == kind[1] and p.traits.get("gender", kind[0]) == kind[0]]
            person = fit[0] if len(fit) == 1 else None
        if person is None:
            person = self.add(name, chapter)
            self.index(person)
        person.lines += 1
        person.first_chapter = person.first_chapter or chapter


def fold_updates(updates: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The cast of each book (see SCHEMA), in the order in which its people were met, from updates (book_id, ord, ch, name, aliases, gender,
    age, description, voice_notes, merge_into) and spoken lines (book_id, ord, ch, name). `ord` orders both within a
    book. Updates without a name are passed over. A book's own updates and lines are one group; no text is among them."""
    own = ["aliases", "gender", "age", "description", "voice_notes", "merge_into"]
    rows = updates.select("book_id", "ord", "ch", "name", *own, F.lit(False).alias("spoken"))
    if lines is not None:
        rows = rows.unionByName(lines.select("book_id", "ord", "ch", "name", F.lit(True).alias("spoken")), allowMissingColumns=True)

    def fold(table: pa.Table) -> pa.Table:
        cast = Cast()
        for row in table.sort_by("ord").to_pylist():
            if row["spoken"]:
                cast.line(row["name"] or "", row["ch"])
            elif (row["name"] or "").strip():
                cast.update(row)
        book = table.column("book_id")[0].as_py()
        told = [(book, k, p.name, list(p.aliases.values()), p.traits.get("gender", UNKNOWN), p.traits.get("age", UNKNOWN), p.description, ", ".join(p.notes.values()), p.first_chapter, p.lines, p.provisional) for k, p in enumerate(cast.people)]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int32(), pa.int32(), pa.bool_()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.table({n: pa.array([t[k] for t in told], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return rows.groupBy("book_id").applyInArrow(fold, SCHEMA)


def _first_of_each(values: Column, key) -> Column:
    """The values whose key no earlier one has, in order. Lists of names or notes of one person."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, k: F.array_position(keys, key(v)) == k + 1)


def finalize(characters: DataFrame) -> DataFrame:
    """characters (see SCHEMA) at the end of a book: one whose name is one word goes over into the only one with that word in a longer
    name; descriptors that never spoke go; those that did are written like names. Numbers (ord) stay."""
    words = F.size(F.split(F.trim("name"), r"\s+"))
    named = characters.where("not provisional")
    single = named.where(words == 1).select("book_id", F.col("ord").alias("ord"), T.normalize_name(F.col("name")).alias("word"))
    hosts = named.where(words > 1).select("book_id", F.col("ord").alias("host"), F.explode(F.array_distinct(F.transform(F.split("name", r"\s+"), T.normalize_name))).alias("word"))
    moved = single.join(hosts, ["book_id", "word"]).groupBy("book_id", "ord").agg(F.count("*").alias("n"), F.min("host").alias("host")).where("n = 1").drop("n")
    dealt = characters.join(moved, ["book_id", "ord"], "left").withColumn("into", F.coalesce("host", "ord"))
    rest = [c for c in characters.columns if c not in ("book_id", "ord")]
    own = dealt.groupBy("book_id", "into").agg(F.array_sort(F.collect_list(F.struct(F.col("host").isNotNull().alias("absorbed"), "ord", *rest))).alias("all"))  # one person's names
    host = F.col("all")[0]
    each = lambda field: F.transform("all", lambda p: p[field])
    known = lambda field: F.coalesce(F.try_element_at(F.filter(each(field), lambda v: v != UNKNOWN), F.lit(1)), F.lit(UNKNOWN))
    called = F.flatten(F.transform("all", lambda p: F.when(p["absorbed"], F.concat(F.array(p["name"]), p["aliases"])).otherwise(p["aliases"])))
    notes = F.filter(F.flatten(F.transform(each("voice_notes"), lambda v: F.split(v, r"\s*,\s*"))), lambda v: v != "")
    longest = F.aggregate(each("description"), F.lit(""), lambda a, v: F.when(F.length(v) > F.length(a), v).otherwise(a))
    chapters = F.filter(each("first_chapter"), lambda v: v > 0)
    done = own.select(
        "book_id", F.col("into").alias("ord"), F.when(host["provisional"], T.title_case(host["name"])).otherwise(host["name"]).alias("name"),
        F.filter(_first_of_each(called, T.alias_key), lambda v: (T.alias_key(v) != T.alias_key(host["name"])) & (v != "")).alias("aliases"), known("gender").alias("gender"), known("age").alias("age"),
        longest.alias("description"), F.array_join(_first_of_each(notes, F.lower), ", ").alias("voice_notes"), F.coalesce(F.array_min(chapters), F.lit(0)).alias("first_chapter"),
        F.aggregate(each("line_count"), F.lit(0), lambda a, v: a + v).alias("line_count"), host["provisional"].alias("provisional"),
    )
    return done.where("not provisional or line_count > 0").select(*characters.columns)


def described(characters: DataFrame) -> DataFrame:
    """(book_id, key, name): descriptors that fit exactly one named person of a book by age and, where known, gender."""
    kinds = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(g).alias("g"), F.lit(a).alias("a")) for k, (g, a) in DESCRIPTOR_TRAITS.items()])
    fits = characters.where("not provisional").select("book_id", "name", "gender", "age", F.explode(kinds).alias("d")).where((F.col("age") == F.col("d.a")) & F.col("gender").isin("unknown", F.col("d.g")))
    return fits.groupBy("book_id", F.col("d.key").alias("key")).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").drop("n")
