"""The people of a book: which capitalised words are names, which names are one person, and what the text tells of each.

Everything here is joins and combinable aggregates over the sentences of all books at once; only the few names of one person are ever a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.sources.stored import stored

# Verbs that tag speech, titles before a name, phrases for people without a name with what they tell (gender, age), how a
# paragraph of another time or place begins, and the question for a name.
VERBS = (
    "said asked shouted whispered warned replied called cried laughed muttered sniffed added answered snapped breathed coughed hissed growled sighed "
    "murmured yelled exclaimed demanded insisted repeated agreed gasped grumbled spoke says asks shouts whispers replies"
).split()
TITLES = "Old Young Mr Mrs Ms Miss Dr Captain Sir Lady Lord Aunt Uncle".split()
ROLES = {
    "the man": ("male", "adult"), "the woman": ("female", "adult"), "the stranger": ("unknown", "adult"), "the rider": ("unknown", "adult"),
    "the boy": ("male", "child"), "the girl": ("female", "child"), "the old man": ("male", "elderly"), "the old woman": ("female", "elderly"),
}
TIME_PASSES = r"(?:Later|Afterwards|Meanwhile|That (?:night|evening|morning)|The next|A (?:week|day|month|year)|On the \w+ day|Morning|By (?:morning|evening))\b"
ASKS_NAME = r"(?i)\b(?:your name|who are you)\b"

# Words before a name that tell a gender, ages by what is said behind a name (first match counts), and voices by what is said around speech.
FEMALE_KIN = "sister mother aunt wife daughter niece grandmother widow mrs ms miss lady madam".split()
MALE_KIN = "brother father uncle husband son nephew grandfather widower mr sir lord".split()
AGE_WORDS = (
    (r"\b(?:twelve|eleven|ten|nine|eight|seven|six)\b(?!\s+(?:minutes|hours|days|weeks|months|years|miles|feet|yards|paces|men|women|of))|\b(?:boy|girl|lad|lass|child)\b", "child"),
    (r"\b(?:thirteen|fourteen|fifteen|sixteen|seventeen|teenage[rd]?|youth)\b", "teen"),
    (r"\b(?:sixty|seventy|eighty|ninety) winters\b|\belderly\b|\baged\b|\b(?:grey|gray|white)-haired\b|\bwrinkled\b|\b(?:was|is|looked|grown) (?:very )?old\b|\bold (?:man|woman|lady|fellow)\b", "elderly"),
)
VOICE_NOTES = (
    (r"\bdry rattle\b", "dry, rasping"), (r"\brattl", "rasping"), (r"\bhoarse", "hoarse"), (r"\bgruff", "gruff"), (r"\bdeep voice\b", "deep"),
    (r"\bsoft voice\b", "soft"), (r"\bshrill", "shrill"), (r"\bbooming", "booming"), (r"\bcroak", "croaky"), (r"\bwheez", "wheezy"),
)
#: Code points behind a name in which a pronoun, or an age, is taken for its bearer's; longest description.
PRONOUN_CHARS, AGE_CHARS, DESCRIPTION_CHARS = 120, 80, 140
#: Words that are capitalised where a sentence begins and are no names, whatever else a book says; a caller may give others.
STOP_WORDS = (
    "I He She It We They You His Her Its Our Their My Your Him Them Us Me This That These Those There Here The A An And But Or Nor So Yet If Then Than As At By For From In Into Of Off On Onto Out Over To Up With "
    "What Who Whom Whose Which When Where Why How Not No Yes Oh Ah Well Now Never Always Only Just Even Still Again Once Perhaps Maybe Please Monday Tuesday Wednesday Thursday Friday Saturday Sunday"
).split()

#: A capitalised word, one or two of them with a title perhaps, and a phrase for somebody without a name; all in any script.
WORD = r"\p{Lu}\p{M}*(?:['’]?\p{L}\p{M}*)+"
RUN = rf"(?:(?:{'|'.join(TITLES)})\.? )?{WORD}(?: {WORD})?"
EACH_RUN = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_'’])({RUN})"
#: EACH_RUN as it is searched for: what begins with no capital is passed over at once.
FOUND_RUN = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}_'’])({RUN})"
ROLE = r"[Tt]he (?:old (?:man|woman)|man|woman|stranger|boy|girl|rider)"
VERB = rf"(?:{'|'.join(VERBS)})"
#: Whether a sentence can have a verb of speech beside a run: cheaper than to look for both.
MAY_TAG = rf"(?:^|[^a-z]){VERB}(?![a-z])"
#: A sentence with its marks; the point of a short title ends none.
SENTENCE = r"(?:[^.!?…]*\b(?:Mr|Mrs|Ms|Dr)\. )*[^.!?…]+[.!?…]*"


def plain_name(raw: Column) -> Column:
    """A run without its titles and a possessive s."""
    return F.regexp_replace(F.regexp_replace(raw, rf"^(?:(?:{'|'.join(TITLES)})\.? )+(?=\p{{Lu}})", ""), "['’]s$", "")


def _unended() -> Column:
    """Whether a span is a quote without a full stop, so that narration behind it goes on. A line may end behind the stop: two code points at most."""
    return F.coalesce(F.col("kind").eqNullSafe("quote") & ~F.right(F.trim("text"), F.lit(3)).rlike(r"[.!?…]$"), F.lit(False))


def sentences(spans: DataFrame, behind: int = 0) -> DataFrame:
    """spans with each sentence of their text (k, sentence), and `opens`: whether it stands where a sentence begins. Narration that goes on behind
    speech without a full stop does not. behind: so many code points of what follows the sentence are given, too."""
    order = Window.partitionBy("book_id", "ch", "para").orderBy("s")
    goes_on = F.coalesce(F.lag("_unended").over(order), F.lit(False))
    parts = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    listed = spans.withColumn("_unended", _unended()).withColumn("_goes_on", goes_on).drop("_unended").where("kind = 'narration'").withColumn("_parts", parts)
    # All sentences but the last have two code points at least.
    follows = lambda k: F.substring(F.array_join(F.slice("_parts", k + 2, behind // 2 + 1), ""), 1, behind) if behind else F.lit("")
    each = listed.select("*", F.posexplode(F.transform("_parts", lambda t, k: F.struct(t.alias("own"), follows(k).alias("follows")))).alias("k", "_part"))
    each = each.withColumns({"sentence": F.col("_part.own"), "follows": F.col("_part.follows")}).drop("_part", "_parts")
    each = each if behind else each.drop("follows")
    return each.withColumns({"sentence": F.ltrim("sentence") if behind else F.trim("sentence"), "opens": (F.col("k") > 0) | ~F.col("_goes_on")}).drop("_goes_on")


def raw_runs(sentence: Column, stop_words: tuple[str, ...] | list[str]) -> Column:
    """The capitalised runs of a sentence in order, without stop words beside others and a possessive s. One array: whoever explodes it works out each pattern once a run."""
    stop = f"(?:{'|'.join(stop_words)})" if stop_words else r"(?!)"
    bare = lambda run: F.regexp_replace(F.regexp_replace(run, rf"^(?:{stop} )+(?=\p{{Lu}})", ""), rf" {stop}$", "")
    return F.transform(F.regexp_extract_all(sentence, F.lit(FOUND_RUN), F.lit(1)), lambda run: F.regexp_replace(F.when(F.contains(run, F.lit(" ")), bare(run)).otherwise(run), "['’]s$", ""))


def may_name(raw: Column, stop_words: tuple[str, ...] | list[str]) -> Column:
    stop = f"(?:{'|'.join(stop_words)})" if stop_words else r"(?!)"
    return ~raw.rlike(f"^{stop}$") & raw.rlike(r"\p{Ll}")


def _title(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, rf"^({'|'.join(TITLES)})\.? (?=\p{{Lu}})", 1))


def runs(each: DataFrame, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Capitalised runs of sentences (see `sentences`): raw, name (without titles and stop words), title (lower case or ''), j (place among the runs of its
    sentence), and initial (it is the first word of a sentence, so that its capital tells nothing)."""
    named = each.select("*", F.posexplode(raw_runs(F.col("sentence"), stop_words)).alias("j", "raw")).where(may_name(F.col("raw"), stop_words))
    initial = F.col("opens") & (F.col("j") == 0) & F.expr("startswith(sentence, raw)")
    return named.withColumns({"name": plain_name(F.col("raw")), "title": _title(F.col("raw")), "initial": initial}).where(~F.col("name").isin(*TITLES))


def called(text: Column) -> Column:
    """The name that a quote addresses: the quote is that word alone, or a sentence of it begins or ends with it behind or before a comma."""
    alone = F.regexp_extract(text, rf"^({WORD})[!,]$", 1)
    within = F.regexp_extract(text, rf"(?:^|[.!?…] )({WORD}), |, ({WORD})[.!?…]*(?:$| \p{{Lu}})", 1)
    at_end = F.regexp_extract(text, rf", ({WORD})[.!?…]*(?:$| \p{{Lu}})", 1)
    found = F.when(F.contains(text, F.lit(", ")), F.array(alone, at_end, within)).otherwise(F.array(alone))
    return F.get(F.filter(found, lambda call: call != ""), F.lit(0))


def harvest(spans: DataFrame, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> DataFrame:
    """(book_id, name, n, within, titled, tagged): the names of each book's narration, with how often each stands, how often within a sentence, and whether it
    has had a title or a verb of speech beside it.

    spans: book_id, ch, para, s, kind, text. A word that only ever begins sentences counts if it does so twice, if a quote has it too, or beside a verb of
    speech; two words together and words with a title always count. Words that the same book also writes small, and stop words,
    are no names. Null and empty texts have none; repeated rows count again."""
    narration = spans.where("kind = 'narration'")
    # No word of letters reaches over the end of a sentence.
    small = narration.select("book_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^\p{L}\p{M}\p{N}_'’])(\p{Ll}[\p{L}\p{M}]{2,})"), F.lit(1))).alias("first"))
    evidence = lambda raw, n, within, tag: F.struct(raw.alias("raw"), n.cast("long").alias("n"), within.cast("long").alias("within"), tag.alias("tag"))
    sentence, none, once = F.col("sentence"), F.lit(0), F.lit(1)
    take = lambda pattern: F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1))
    met = F.transform(raw_runs(sentence, stop_words), lambda raw, j: evidence(raw, once, ~((j == 0) & F.startswith(sentence, raw)), F.lit(False)))
    tags = F.when(sentence.rlike(MAY_TAG), F.concat(take(rf"{FOUND_RUN} {VERB}\b"), take(rf"\b{VERB} ({RUN})"))).otherwise(F.array().cast("array<string>"))
    each = narration.select("book_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda t: F.trim(t))).alias("sentence"))
    found = each.select("book_id", F.explode(F.concat(met, F.transform(tags, lambda raw: evidence(raw, none, none, F.lit(True))))).alias("x")).select("book_id", "x.*")
    # What begins narration that goes on behind speech stands within a sentence. Only that run passes the window, not the text.
    opening = F.trim(F.regexp_extract("text", SENTENCE, 0))
    lead = F.transform(F.array(opening), lambda t: F.transform(F.array(F.get(raw_runs(t, stop_words), none)), lambda raw: F.when(F.startswith(t, raw), raw))[0])[0]
    order = Window.partitionBy("book_id", "ch", "para").orderBy("s")
    begun = spans.select("book_id", "ch", "para", "s", _unended().alias("unended"), F.when(F.col("kind") == "narration", lead).alias("raw"))
    begun = begun.withColumn("goes_on", F.lag("unended").over(order)).where("goes_on and raw is not null").select("book_id", evidence(F.col("raw"), none, once, F.lit(False)).alias("x")).select("book_id", "x.*")
    named = found.unionByName(begun).where(F.col("tag") | may_name(F.col("raw"), stop_words)).select("book_id", plain_name(F.col("raw")).alias("name"), "n", "within", "tag", (~F.col("tag") & F.col("raw").rlike(rf"^(?:{'|'.join(TITLES)})\.? (?=\p{{Lu}})")).alias("titled"))
    tally = named.groupBy("book_id", "name").agg(F.sum("n").alias("n"), F.sum("within").alias("within"), F.bool_or("titled").alias("titled"), F.bool_or("tag").alias("tagged"))
    told = tally.where((F.col("n") > 0) & ~F.col("name").isin(*TITLES))
    said = spans.where("kind = 'quote'").select("book_id", F.explode(F.regexp_extract_all("text", F.lit(FOUND_RUN), F.lit(1))).alias("raw")).select("book_id", plain_name(F.col("raw")).alias("name")).distinct()
    told = told.join(said.withColumn("said", F.lit(True)), ["book_id", "name"], "left")
    told = stored(told.withColumn("first", F.lower(F.split("name", " ")[0])), "told")
    # Small words are many and names few: words are dealt out once and only looked up, and those that are a name's come back.
    written_small = small.join(told.select("book_id", "first").distinct().hint("shuffle_hash"), ["book_id", "first"], "left_semi").distinct()
    known = told.join(written_small, ["book_id", "first"], "left_anti")
    return known.where((F.size(F.split("name", " ")) > 1) | F.col("titled") | (F.col("within") > 0) | F.col("tagged") | (F.col("n") > 1) | F.col("said").isNotNull()).select("book_id", "name", "n", "within", "titled", "tagged")


def scenes(spans: DataFrame) -> DataFrame:
    """spans with scene: a number within the chapter that goes up at a scene break and where the text moves to another time. The text passes the windows only
    if it is asked for afterwards."""
    order = Window.partitionBy("book_id", "ch").orderBy("para", "s")
    first = ~F.lag("para").over(order).eqNullSafe(F.col("para"))
    moves = (F.col("kind") == "narration") & F.col("text").rlike(f"^{TIME_PASSES}")
    begun = spans.withColumn("_moves", moves).withColumn("_begins", (first & (F.col("scene_break_before") | F.col("_moves"))).cast("int"))
    return begun.withColumn("scene", F.sum("_begins").over(order)).drop("_begins", "_moves")


#: Before a name that its bearer tells, and parts of which it has one.
OWN_NAME = r"\b(?:[Mm]y name is|[Mm]y name's|[Tt]he name's|I am|I'm|[Cc]all me) "
OWN_NAME_PARTS = ("y name is ", "e name's ", "y name's ", "I am ", "I'm ", "all me ")
#: A word that begins small or with a mark, which no text of nothing but names has.
NO_NAME = r"(?:^|[\s.,;:!?])[^\p{Lu}\s.,;:!?\u0085\u2028\u2029]"


def naming(spans: DataFrame) -> DataFrame:
    """spans with what each text by itself tells of names: lead (the name that narration begins with, or ''), call (whom a quote addresses), asks (for a name), own
    (names that a quote says are its speaker's), and capitals (a quote's text if it may be nothing but names). They are short, so that texts are read once and pass no window."""
    quote, text = F.col("kind") == "quote", F.col("text")
    own = rf"{OWN_NAME}({RUN})(?:\. ?({RUN}))?"
    may_tell = F.contains(text, F.lit(OWN_NAME_PARTS[0]))
    for part in OWN_NAME_PARTS[1:]:
        may_tell = may_tell | F.contains(text, F.lit(part))
    return spans.withColumns({
        "lead": F.when(F.col("kind") == "narration", plain_name(F.regexp_extract(text, rf"^({RUN})", 1))), "call": F.when(quote, called(text)), "asks": text.rlike(ASKS_NAME),
        "own": F.when(quote & may_tell, F.filter(F.array(F.regexp_extract(text, own, 1), F.regexp_extract(text, own, 2)), lambda n: n != "")), "capitals": F.when(quote & ~text.rlike(NO_NAME), text),
    })


def introductions(placed: DataFrame) -> DataFrame:
    """(book_id, ch, scene, para, s, names): quotes that tell their speaker's name, longest name first. A quote that answers the question for a
    name with nothing but names, or says "my name is", "I am" or "call me" before one. placed: spans with scene and what `naming` finds."""
    order = Window.partitionBy("book_id", "ch", "scene").orderBy("para", "s")
    quotes = placed.where("kind = 'quote'").withColumn("_asked", F.coalesce(F.lag("asks").over(order), F.lit(False))).where("(_asked and capitals is not null) or size(own) > 0")
    only = F.col("capitals").rlike(rf"^(?:{RUN}[.,;:!?]+\s*)*{RUN}[.,;:!?]*$")
    answer = F.when(F.col("_asked") & only, F.regexp_extract_all("capitals", F.lit(rf"({RUN})"), F.lit(1)))
    names = F.coalesce(answer, F.when(F.size("own") > 0, F.col("own")))
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.split(n, " "))).alias("words"), F.array_position(names, n).alias("at"), n.alias("name")))), lambda x: x["name"])
    return quotes.withColumn("names", longest).where(F.size("names") > 0).select("book_id", "ch", "scene", "para", "s", "names", F.col("_asked").alias("asked"))


def traits(spans: DataFrame, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> DataFrame:
    """(book_id, name, titled, gender, age, description): what narration tells of each run's bearer, each as (rank, when, what), null where nothing is told: the least is the
    one that counts, so that evidence of several names combines.

    Gender: a word of kinship or a title before the name (rank 0) goes before a pronoun behind it (rank 1). Only the text up to the next name is
    searched, PRONOUN_CHARS at most; ages are taken from its first sentence. titled: forms of the name with a title."""
    met = runs(sentences(spans, PRONOUN_CHARS), stop_words)
    at = F.regexp_instr("sentence", F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])"), F.col("raw"), F.lit(r"(?![\p{L}\p{M}\p{N}_])")))
    # Each step stands behind an explode of one row, so that what later steps ask for several times is worked out once.
    once = lambda df, **found: df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))).alias("_x")).select("*", "_x.*").drop("_x")
    placed = once(met.select("book_id", "ch", "para", "s", "k", "sentence", "follows", "raw", "name", "title"), at=at).where("at > 0").withColumns({"before": F.expr("substring(sentence, 1, at - 1)"), "from_name": F.concat(F.expr("substring(sentence, at)"), "follows")})
    placed = placed.withColumn("after", F.expr(f"substring(from_name, length(raw) + 1, {PRONOUN_CHARS})"))
    other = r"(?s)(?:(?<=[\p{L}\p{M}\p{N},;:])\s|(?<=[.!?…])\s+(?!(?:He|She|His|Her|Him|Himself|Herself|They|Their|It|Its)\b))\p{Lu}\p{L}.*$"
    near = F.regexp_replace("after", other, "")
    kin = F.lower(F.regexp_extract("before", r"(\p{L}+)\.?\s+$", 1))
    pronoun = F.lower(F.regexp_extract(near, r"(?i)\b(he|his|she|her)\b", 1))
    about = F.regexp_extract("from_name", rf"^{RUN}(?:, who [^,.;]+|,? (?:was|is|were) [^,.;]+)", 0)
    first = F.regexp_replace(F.regexp_extract(F.substring("after", 1, AGE_CHARS), r"(?s)^.*?(?:[.!?](?=\s)|$)", 0), rf"(?i)\b{ROLE}\b", "")
    placed = once(placed, kin=kin, pronoun=pronoun, about=about, first=first)
    kin, pronoun, about, first = F.when(F.col("title").isin(*FEMALE_KIN, *MALE_KIN), F.col("title")).otherwise(F.col("kin")), F.col("pronoun"), F.col("about"), F.col("first")
    gender = F.when(kin.isin(*FEMALE_KIN), "female").when(kin.isin(*MALE_KIN), "male")
    guess = F.when(pronoun.isin("he", "his"), "male").when(pronoun.isin("she", "her"), "female")
    age = F.when(F.col("title") == "old", "elderly")
    for pattern, what in AGE_WORDS:
        age = age.when(first.rlike(f"(?i){pattern}"), what)
    placed, age = once(placed, age=age), F.col("age")
    when = F.struct("ch", "para", "s", "k", "at")
    told = lambda rank, what: F.when(what.isNotNull(), F.struct(rank.alias("rank"), when.alias("when"), what.alias("what")))
    evidence = placed.select(
        "book_id", "name", F.when(F.col("raw") != F.col("name"), F.col("raw")).alias("titled"), told(F.when(gender.isNotNull(), 0).otherwise(1), F.coalesce(gender, guess)).alias("gender"),
        told(F.lit(0), age).alias("age"), told(F.lit(0), F.when(about != "", F.trim(F.substring(about, 1, DESCRIPTION_CHARS)))).alias("description"),
    )
    return evidence.groupBy("book_id", "name").agg(F.collect_set("titled").alias("titled"), *[F.min(c).alias(c) for c in ("gender", "age", "description")])


def people(spans: DataFrame, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS), placed: DataFrame | None = None) -> DataFrame:
    """(book_id, person, names, gender, age, description): the persons of each book, with every name they go by.

    A name is a person's if a verb of speech stands beside it, if it leads up to a quote, if a quote addresses it, or if its bearer tells it. A name of one word stands for
    the only longer one that has it; if several do, for itself. spans: book_id, ch, para, s, kind, text, scene_break_before. placed: the same with scene and what
    `naming` finds, if somebody has it."""
    placed = scenes(naming(spans)) if placed is None else placed
    order = Window.partitionBy("book_id", "ch", "para").orderBy("s")
    leads = placed.withColumn("_next", F.lead("kind").over(order)).where("lead <> '' and _next = 'quote'").select("book_id", F.col("lead").alias("name"))
    calls = placed.select("book_id", F.explode(F.array("call")).alias("name")).where("name is not null")
    names = stored(harvest(spans, stop_words), "names")
    wanted = leads.unionByName(calls).distinct().withColumn("wanted", F.lit(True))
    rated = names.join(wanted, ["book_id", "name"], "left").withColumn("wanted", F.col("tagged") | F.coalesce("wanted", F.lit(False)))
    told = introductions(placed).select("book_id", F.explode("names").alias("name"), F.col("names")[0].alias("person"), F.col("asked"))
    # Only answers make a new person; who says "I am Happy" is named so if the book knows the name.
    answers = told.where("asked").groupBy("book_id", "name").agg(F.min("person").alias("person"))
    words = F.split("name", " ")
    every = rated.select("book_id", "name", "wanted").unionByName(answers.select("book_id", F.explode(F.array_distinct(F.array("name", "person"))).alias("name"), F.lit(True).alias("wanted")))
    known = every.groupBy("book_id", "name").agg(F.bool_or("wanted").alias("wanted"))
    hosts = known.where(F.size(words) == 2).select("book_id", F.explode(F.array_distinct(words)).alias("name"), F.col("name").alias("host"))
    host = hosts.groupBy("book_id", "name").agg(F.count("*").alias("n"), F.min("host").alias("host"))
    single = known.join(host, ["book_id", "name"], "left").join(answers, ["book_id", "name"], "left")
    person = F.coalesce("person", F.when(F.col("n") == 1, F.col("host")), F.col("name"))
    dealt = single.select("book_id", "name", person.alias("person"), "wanted")
    # A longer name is wanted if one of its words is.
    sought = dealt.where("wanted").select("book_id", "person").distinct()
    kept = dealt.join(sought, ["book_id", "person"])
    none = F.array().cast("array<string>")
    joined = stored(kept, "names").join(traits(spans, stop_words), ["book_id", "name"], "left")
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("titled", none))))))  # one person's names
    least = lambda c, default: F.coalesce(F.min(c)["what"], F.lit(default)).alias(c)
    return joined.groupBy("book_id", "person").agg(listed.alias("names"), least("gender", "unknown"), least("age", "unknown"), least("description", ""))
