"""Operator 6: surrogates for personal data, by built-in functions only.

Mail addresses, telephone numbers, network addresses, card numbers, hexadecimal secrets and names after a title are
found by one pattern. Each gets a replacement of the same kind that a key and the entity's canonical form decide:
digits for digits and letters for letters of the same case in the same layout, valid numbers in network addresses,
names of the same gender and script after the same title. Spellings of one entity have one canonical form, so they get
matching replacements everywhere.

All distinct entities are then checked by canonical form: where the replacements of two would be spellings of one
entity, or a replacement is a spelling of an entity of the corpus, all but one are drawn again, each in all its
spellings, until none is left. From the seventh redraw on replacements grow by a character each time, so this ends also
where a layout has hardly more replacements than entities. Only the entities of that check are shuffled; a text meets its
redrawn entities by a join with a table that is written first, so that the planner knows its size.

Results for odd input: a missing text stays missing, an empty one empty; texts are read whole; repeated rows are
rewritten alike; rows without an id are rewritten too; an empty table gives an empty table. All columns pass; `text` is
replaced, and so is `n_chars`, if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import stored

# Redraws of one length; each one after them adds a character, so that even a small space of replacements suffices.
SAME_LENGTH = 6

# Titles by gender. What follows a title is a name.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
# Titles of either gender; their names are given as male ones are.
EITHER = ("Dr", "Prof")
TITLES = (*FEMALE, *MALE, *EITHER)

# Letters of a name go on over apostrophes and hyphens, but not into a possessive ending.
_LETTER = r"(?!['’]s(?!\p{L}))['’-]?\p{L}"
_WORD = rf"\p{{Lu}}(?:{_LETTER}){{1,40}}(?!{_LETTER})"

PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "network": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "card": r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.? {_WORD}(?: {_WORD})?",
}
_ANY = "|".join(PATTERNS.values())
# What each entity has, so that most texts are passed over by a plain search.
_HINT = rf"[0-9@]|(?:{'|'.join(TITLES)})\.? "

# Syllables of made names, per script, and the endings of female, male and family names.
SYLLABLES = {
    "latin": ("ba re mo li sa ti no ve da lu ka mi ro se na jo".split(), ("na", "n", "r")),
    "cyrillic": ("ба ре мо ли са ти но ве да лу ка ми ро се на го".split(), ("на", "н", "р")),
}


def kind_of(entity: Column) -> Column:
    """The kind of a found entity, by its form."""
    return (
        F.when(entity.contains("@"), "mail")
        .when(entity.startswith("+"), "phone")
        .when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "network")
        .when(entity.rlike(r"^[0-9a-f]{32,}$"), "secret")
        .when(entity.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def canonical(entity: Column) -> Column:
    """Kind and essence of an entity, the same for all its spellings."""
    essence = (
        F.when(entity.rlike(r"^\p{Lu}") & ~entity.contains("@"), F.lower(F.regexp_replace(entity, r"^\p{L}+\.? ", "")))
        .when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), entity)
        # Dots and signs tell mail addresses apart.
        .when(entity.contains("@"), F.lower(entity))
        .otherwise(F.regexp_replace(F.lower(entity), "[^0-9a-z]", ""))
    )
    return F.concat(kind_of(entity), F.lit(":"), essence, F.when(kind_of(entity) == "name", _gender(entity)).otherwise(""))


def _gender(entity: Column) -> Column:
    """0 for female and 1 for male, as a digit."""
    return F.when(entity.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), "0").otherwise("1")


def surrogate(entity: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity, decided by the key, its canonical form and the number of the attempt."""
    seed = F.concat(F.lit(f"{key}|"), attempt.cast("string"), F.lit("|"), canonical(entity), F.lit("|"))
    stream = F.array_join(
        F.transform(F.sequence(F.lit(0), F.floor(F.length(entity) / 32).cast("int")), lambda at: F.sha2(F.concat(seed, at.cast("string")), 256)),
        "",
    )
    return (
        F.when(kind_of(entity) == "name", _name(entity, stream, attempt))
        .when(kind_of(entity) == "network", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda at: (1 + _byte(stream, at) % 254).cast("string")), "."))
        .otherwise(_longer(entity, _alike(entity, stream), F.sha2(F.concat(seed, F.lit("more")), 256), attempt))
    )


def _longer(entity: Column, given: Column, drawn: Column, attempt: Column) -> Column:
    """From the seventh redraw on one more character each time: letters before a mail address, else digits at the end."""
    more = F.least(attempt.cast("int") - SAME_LENGTH, F.lit(64))
    letters = F.left(F.translate(drawn, "0123456789", "ghijklmnop"), more)
    digits = F.left(F.translate(drawn, "abcdef", "012345"), more)
    return F.when(more <= 0, given).when(entity.contains("@"), F.concat(letters, given)).otherwise(F.concat(given, digits))


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substring(stream, 2 * at + 1, F.lit(2)), 16, 10).cast("int")


def _alike(entity: Column, stream: Column) -> Column:
    """Digits and letters replaced by their rank among themselves.

    The last label of a mail address and the first digit of a telephone number's country stay.
    """
    stays = F.when(entity.contains("@"), F.regexp_extract(entity, r"\.[A-Za-z0-9-]+$", 0)).otherwise("")
    moved = F.substring(entity, F.lit(1), F.length(entity) - F.length(stays))
    hexadecimal = kind_of(entity) == "secret"

    def one(letter: Column, at: Column) -> Column:
        rank = F.length(F.regexp_replace(F.substring(moved, F.lit(1), at), "[^0-9A-Za-z]", ""))
        drawn = _byte(stream, rank)
        small = F.when(hexadecimal, F.substring(F.lit("abcdef"), 1 + drawn % 6, F.lit(1))).otherwise(F.char(97 + drawn % 26))
        digit = (drawn % 10).cast("string")
        either = F.when(hexadecimal & (drawn % 16 < 10), digit).when(hexadecimal, small)
        return (
            F.when((at == 1) & entity.startswith("+"), letter)
            .when(hexadecimal, either)
            .when(letter.rlike("[0-9]"), digit)
            .when(letter.rlike("[a-z]"), small)
            .when(letter.rlike("[A-Z]"), F.upper(small))
            .otherwise(letter)
        )

    letters = F.transform(F.sequence(F.lit(0), F.length(moved) - 1), lambda at: one(F.substring(moved, at + 1, F.lit(1)), at))
    return F.concat(F.array_join(letters, ""), stays)


def _name(entity: Column, stream: Column, attempt: Column) -> Column:
    """The title, then made names: three syllables, one more for each attempt, and an ending."""
    title = F.regexp_extract(entity, r"^(\p{L}+\.? )", 1)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")

    def made(script: str) -> Column:
        syllables, endings = SYLLABLES[script]
        known, last = F.array(*map(F.lit, syllables)), F.array(*map(F.lit, endings))

        def one(word: Column, at: Column) -> Column:
            # The first of two names is a given name and shows the gender.
            ending = F.when((at == 0) & (F.size(words) > 1), _gender(entity).cast("int") + 1).otherwise(3)
            parts = F.transform(
                F.sequence(F.lit(0), F.least(attempt.cast("int") + 2, F.lit(12))),
                lambda part: F.element_at(known, 1 + _byte(stream, part + 14 * at) % 16),
            )
            return F.initcap(F.concat(F.array_join(parts, ""), F.element_at(last, ending)))

        return F.array_join(F.transform(words, one), " ")

    # By the name alone: an entity has one script, whatever its title's.
    cyrillic = F.array_join(words, " ").rlike(r"\p{IsCyrillic}")
    return F.concat(title, F.when(cyrillic, made("cyrillic")).otherwise(made("latin")))


def entities(text: Column) -> Column:
    """All entities of a text in order; an empty list without any."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _redrawn(known: DataFrame, key: str) -> DataFrame | None:
    """Entities whose first replacement is taken, with the number of the attempt that is free; None if there are none.

    `known` has the distinct entities. Entities are told apart, and replacements compared, by canonical form; all
    spellings of an entity have the same attempt.
    """
    named = known.select("entity", canonical(F.col("entity")).alias("whose"))
    originals = named.select(F.col("whose").alias("form")).distinct()
    drawn = named.select("entity", "whose", F.lit(0).alias("attempt"), surrogate(F.col("entity"), F.lit(0), key).alias("given"))
    drawn = stored(drawn, "given")
    while True:
        shown = drawn.select("whose", "attempt", canonical(F.col("given")).alias("form")).distinct()
        shared = shown.groupBy("form").agg(F.min(F.struct("attempt", "whose")).alias("first"), F.count("*").alias("n"))
        shared = shared.where("n > 1").select("form", "first")
        later = shown.join(shared, "form").where("whose <> first.whose").select("whose")
        clashes = stored(later.union(shown.join(originals, "form", "left_semi").select("whose")).distinct(), "clashes")
        if clashes.isEmpty():
            return drawn.where("attempt > 0").select("entity", "attempt") if "again" in drawn.columns else None
        marked = drawn.select("entity", "whose", "attempt").join(clashes.withColumn("hit", F.lit(1)), "whose", "left")
        attempt = F.col("attempt") + F.coalesce("hit", F.lit(0))
        again = marked.select("entity", "whose", attempt.alias("attempt"), F.lit(True).alias("again"))
        drawn = stored(again.withColumn("given", surrogate(F.col("entity"), F.col("attempt"), key)), "given")


def replace_entities(documents: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The documents with surrogates for entities; `count` names a column to add, with the number of entities."""
    known = stored(documents.select(F.explode(entities(F.col(text))).alias("entity")).distinct(), "entities")
    redrawn = _redrawn(known, key)
    rows = documents
    attempt_of = None
    if redrawn is not None:
        found = documents.select(F.md5(text).alias("of_text"), F.explode(F.array_distinct(entities(F.col(text)))).alias("entity")).distinct()
        pairs = found.join(redrawn, "entity").groupBy("of_text")
        marks = stored(pairs.agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("attempts")), "marks")
        mark = "__attempts"
        marks = marks.select(F.col("of_text").alias("__of_text"), F.col("attempts").alias(mark))
        rows = documents.join(marks, F.md5(documents[text]) == F.col("__of_text"), "left")
        attempt_of = F.col(mark)

    def attempt(entity: Column) -> Column:
        return F.lit(0) if attempt_of is None else F.coalesce(F.element_at(attempt_of, entity), F.lit(0))

    found = entities(F.col(text))
    given = F.transform(found, lambda entity: surrogate(entity, attempt(entity), key))
    pieces = F.zip_with(F.split(F.col(text), _ANY, -1), given, lambda part, entity: F.concat(part, F.coalesce(entity, F.lit(""))))
    written = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    changed = {text: written}
    columns = [changed.get(name, F.col(name)).alias(name) for name in documents.columns]
    if count:
        columns.append(F.size(found).cast("long").alias(count))
    out = rows.select(*columns)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length(text).cast(documents.schema["n_chars"].dataType))
    return out
