"""PII surrogates in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, written

_MEN, _WOMEN = r"Mr|Herr|Monsieur|Señor|Sr|господин", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"


_PEOPLE = "Dr|Prof|Professor|Doctor|Docteur|Doktor|my name is|My name is"
#: What comes before a secret; a quote may stand around the keyword and opens the value. Bounded, as it is looked for backwards.
_KEYWORD = r"(?i:password|passwd|api[_\-]?key|token|secret)(?:\\?[\"'])?[ \t]{0,8}[=:]{1,2}>?"
_HEX = "".join(rf"|(?<![0-9A-Za-z])[0-9a-fA-F]{{{n}}}(?![0-9A-Za-z])" for n in (40, 64, 32))


_PLAIN_SECRET = r"\bAKIA[0-9A-Z]{16}\b" + _HEX


def _after(titles: str) -> str:
    more = r"(?:(?:Dr|Prof)\.?[ ]|)" * 2
    word = r"(?!(?:Dr|Prof)(?!\p{L}))\p{Lu}\p{Ll}+"
    return rf"(?<=(?<!\p{{L}})(?:{titles})\.?[ ]{more}){word}|(?<=(?<!\p{{L}})(?:{titles})\.?[ ]{more}\p{{Lu}}\p{{Ll}}{{1,24}}[ ]){word}"


#: Kinds in the order in which they are tried at a place of the text.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": _PLAIN_SECRET + "".join(rf"|(?<={_KEYWORD}[ \t]{{0,8}}{q})[^{q}\r\n]+(?={q})" for q in "\"'") + rf"|(?<={_KEYWORD}[ \t]{{0,8}}(?:\\?[\"'])?)(?![=:>])[^\s,;\"']+",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<!\d)(?:\d{4}[ \-]?){3}\d{4}(?!\d)|(?<!\d)3[47]\d{13}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.])0\d{2,4}[ /\-]\d{6,8}(?![\w])",
    "man": _after(_MEN),
    "woman": _after(_WOMEN),
    "person": _after(_PEOPLE),
}
#: One pattern for texts that hold a title, one without the names for those with a keyword, and one that never looks back far for all others.
ANY = "|".join(f"({p})" for p in KINDS.values())
PLAIN = "|".join(f"(?:{_PLAIN_SECRET if k == 'secret' else p})" for k, p in KINDS.items() if k not in ("man", "woman", "person"))
CORE = "|".join(f"(?:{p})" for k, p in KINDS.items() if k not in ("man", "woman", "person"))
#: Alphabets within which a character is drawn anew; for names vowels and consonants apart, so that a surrogate can be read aloud.
_LATIN, _ACCENTS = "abcdefghijklmnopqrstuvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü"
_CYRILLIC, _GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_ALPHABETS = ["0123456789", *(f(a) for a in (_LATIN, _CYRILLIC, _GREEK, _ACCENTS + "ñç") for f in (str.lower, str.upper))]
_VOWELS = "aeiou" + "аеиоуыэюя" + "αεηιουω"
_NAMED = [f("".join(c for c in a if (c in _VOWELS) == v)) for a in (_LATIN, _CYRILLIC, _GREEK) for v in (True, False) for f in (str.lower, str.upper)] + [f(a) for a in (_ACCENTS, "ñç") for f in (str.lower, str.upper)]
#: Kinds of names by how they are found; as entities they are one kind, ``name``.
NAMES = ("man", "woman", "person")


def _drawn(seed: Column, n: int | Column) -> Column:
    """A number below n that depends on ``seed`` alone."""
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def _letters(value: Column, seed: Column, alphabets: list[str] = _ALPHABETS) -> Column:
    """``value`` with each letter and digit drawn anew from its own alphabet; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        own = F.coalesce(*(F.when(F.instr(F.lit(a), c) > 0, F.lit(a)) for a in alphabets))
        return F.coalesce(F.substring(own, (_drawn(F.concat(seed, F.lit(":"), i.cast("string")), F.length(own)) + 1).cast("int"), F.lit(1)), c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _checked(digits: Column) -> Column:
    """``digits`` with its last digit set so that the card checksum holds; separators stay."""
    bare = F.reverse(F.regexp_replace(digits, r"\D", ""))
    doubled = F.transform(F.split(bare, ""), lambda d, i: F.when(i == 0, 0).when(i % 2 == 1, F.pmod(d.cast("int") * 2, F.lit(10)) + (d.cast("int") * 2 / 10).cast("int")).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.concat(F.regexp_replace(digits, r"\d$", ""), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def seed_of(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What the surrogate of an entity is drawn from."""
    return F.concat_ws("\x00", F.lit(key), identity(kind), F.when(kind == "email", F.lower(value)).otherwise(value), attempt.cast("string"))


def surrogate(kind: Column, value: Column, attempt: Column, seed: Column) -> Column:
    """Replacement of ``value``: same kind, length of parts, punctuation, case and script, drawn from ``seed``.

    Cards keep their first digit and a valid checksum, phones their country code, addresses stay
    valid, mail domains end in ``example`` and the old top level. Names keep script, case and the
    places of vowels and consonants; those of men or of women alone end as such names do. From the
    eighth attempt on, one character is added.
    """
    local, top = F.regexp_extract(value, "^([^@]*)@", 1), F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    domain = F.regexp_extract(value, r"@([^.@]+)", 1)
    octets = F.array_join(F.array(*((_drawn(F.concat(seed, F.lit(f":{i}")), n) + lo).cast("string") for i, (lo, n) in enumerate(((11, 116), (0, 256), (0, 256), (1, 254))))), ".")
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .\-(])|\+\d)?", 1)
    vowel, end = lambda s: F.substring(F.lit("aeiou"), (_drawn(s, 5) + 1).cast("int"), F.lit(1)), lambda s: F.substring(F.lit("nrslm"), (_drawn(s, 5) + 1).cast("int"), F.lit(1))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    name = _letters(value, seed, _NAMED)
    stem = F.substring(name, F.lit(1), F.greatest(F.lit(2), F.length(name) - 2))
    latin_name = F.concat(stem, F.when(kind == "woman", F.concat(end(F.concat(seed, F.lit("e"))), F.lit("a"))).otherwise(F.concat(vowel(F.concat(seed, F.lit("v"))), end(F.concat(seed, F.lit("e"))))))
    cyrillic_name = F.concat(stem, F.when(kind == "woman", F.lit("на")).otherwise(F.lit("ов")))
    out = (
        F.when(kind == "email", F.concat(_letters(local, seed), F.lit("@"), _letters(domain, F.concat(seed, F.lit("d"))), F.lit(".example"), top))
        .when(kind == "ip", octets)
        .when(kind == "card", _checked(F.concat(F.substring(value, 1, 1), F.substring(_letters(value, seed), F.lit(2), F.length(value)))))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substring(_letters(value, seed), F.lit(3), F.length(value))))
        .when(kind == "phone", F.concat(code, F.expr("''"), F.substring(_letters(value, seed), F.length(code) + 1, F.length(value))))
        .when((kind == "secret") & value.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(_letters(value, seed), F.lit(5), F.length(value))))
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), F.substring(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256)), F.lit(1), F.length(value)))
        .when((kind == "secret") & value.rlike("^[0-9A-F]{32,128}$"), F.upper(F.substring(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256)), F.lit(1), F.length(value))))
        .when(kind.isin("man", "woman"), F.when(cyrillic, cyrillic_name).otherwise(latin_name))
        .when(kind == "person", name)
        .otherwise(_letters(value, seed))
    )
    extra = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (_drawn(F.concat(seed, F.lit("x")), 26) + 1).cast("int"), F.lit(1))
    return F.when(attempt < 8, out).otherwise(F.when(kind == "email", F.concat(extra, out)).when(kind.isin("ip", "card", "phone", "ssn"), F.concat(out, _drawn(F.concat(seed, F.lit("x")), 10).cast("string"))).otherwise(F.concat(out, extra)))


def identity(kind: Column) -> Column:
    """What an entity is, however it was found: names are one kind."""
    return F.when(kind.isin(*NAMES), "name").otherwise(kind)


def surrogate_map(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """``kind, value, surrogate`` for the distinct ``kind, value``: no two values share a surrogate, and none is a value that occurs.

    Mail addresses that differ in case only are one entity and share a surrogate. A name has one
    surrogate, whatever title it stands behind, as a man's or a woman's where only such titles
    occur; its kind is ``name``. Each round draws again for the values whose surrogate is taken, in
    one window over the surrogates; the first round settles nearly all.
    """
    who = F.when(F.col("kind") == "email", F.lower("value")).otherwise(F.col("value"))
    sexes = [F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("man", "woman")]
    entities = entities.select("kind", who.alias("value")).groupBy(identity(F.col("kind")).alias("ident"), "value").agg(*sexes)
    drawn_as = F.when(F.col("ident") != "name", F.col("ident")).when(F.col("man") > F.col("woman"), "man").when(F.col("woman") > F.col("man"), "woman").otherwise("person")
    entities = written(entities.select(drawn_as.alias("kind"), "value", F.lit(0).alias("attempt")), "entities")
    values = entities.select(F.col("value").alias("taken")).distinct()
    now = entities
    for _ in range(rounds):
        #: The seed is a column of its own, as the expression of a surrogate names it very often.
        drawn = now.withColumn("seed", seed_of(F.col("kind"), F.col("value"), F.col("attempt"), key))
        drawn = drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), F.col("seed"))).drop("seed")
        order = F.row_number().over(Window.partitionBy("surrogate").orderBy("attempt", "kind", "value"))
        told = written(drawn.withColumn("again", order > 1).join(values, F.col("surrogate") == F.col("taken"), "left").withColumn("again", F.col("again") | F.col("taken").isNotNull()).drop("taken"), "surrogates")
        if told.where("again").isEmpty():
            return told.select(identity(F.col("kind")).alias("kind"), "value", "surrogate")
        now = told.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still collide")


def _kind(value: Column, names: dict[str, Column]) -> Column:
    """Kind of a match, told from the match itself, and for names from the group that matched; empty for a card number whose checksum is wrong."""
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        reduce(lambda a, k: a.when(names[k] != "", k), names, F.when(F.lit(False), ""))
        .when(value.rlike(r"^[^@\s]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"), "email")
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{10,}$"), "iban")
        .when(value.rlike(r"^\d[\d \-]+$") & digits.isin(15, 16), F.when(_checked(value) == value, "card").otherwise(""))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[+(]?\d[\d ().\-]+$") & (digits < 20), "phone")
        .otherwise("secret")
    )


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity in ``text_col`` replaced; all columns stay, ``pii_count`` and ``pii_kinds`` are added (and replace columns of these names).

    key: what surrogates are drawn with; whoever has it can draw them again. The same value gets
    the same surrogate in all documents and different values get different ones. Numbers of a
    card's form whose checksum is wrong are left alone. Texts without an entity, empty and null
    texts are unchanged (count 0, no kinds). Names are found after a title or "my name is" only;
    further mentions of such a name in the same text get its surrogate and count. Repeated rows
    stay repeated. Only texts that hold an entity go through the joins, which run over (row,
    entity) pairs; the pairs of a value that very many rows hold are dealt out (``spread_join``).
    """
    names_out = [c for c in docs.columns if c not in ("pii_count", "pii_kinds")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names_out))
    text = F.col(f"`{text_col}`")
    #: Cheap signs without which no pattern matches, so that most texts are never searched.
    titled = reduce(lambda a, b: a | b, (text.contains(t) for t in f"{_MEN}|{_WOMEN}|{_PEOPLE}".split("|")))
    keyed = text.rlike("(?i)passw|api[_\\-]?key|token|secret")
    has = F.coalesce(F.when(titled, text.rlike(ANY)).when(keyed, text.rlike(CORE)).when(text.rlike("[0-9@]|[A-Fa-f]{32}"), text.rlike(PLAIN)), F.lit(False))
    none = docs.where(~has).withColumns({"pii_count": F.lit(0), "pii_kinds": F.array().cast("array<string>")})
    row = F.col("row")[text_col]
    found = docs.where(has).select(F.struct("*").alias("row"), titled.alias("titled"), keyed.alias("keyed"))
    by_form = lambda f: F.when(F.col("titled"), f(ANY)).when(F.col("keyed"), f(CORE)).otherwise(f(PLAIN))
    hits = by_form(lambda p: F.regexp_extract_all(row, F.lit(p), F.lit(0)))
    groups = {k: F.when(F.col("titled"), F.regexp_extract_all(row, F.lit(ANY), F.lit([*KINDS].index(k) + 1))) for k in ("man", "woman", "person")}
    found = found.select("row", "titled", "keyed", hits.alias("hits"), *(g.alias(k) for k, g in groups.items()))
    ents = F.transform("hits", lambda x, i: F.struct(_kind(x, {k: F.coalesce(F.get(k, i), F.lit("")) for k in groups}).alias("kind"), x.alias("value")))
    found = found.select(F.monotonically_increasing_id().alias("key"), "row", "titled", "keyed", ents.alias("ents"))
    found = written(found, "private")
    listed = found.select("key", F.explode(F.array_distinct("ents")).alias("e")).select("key", "e.kind", "e.value").where("kind <> ''")
    who = F.when(F.col("kind") == "email", F.lower("value")).otherwise(F.col("value"))
    listed = listed.withColumns({"ident": identity(F.col("kind")), "who": who})
    often = listed.groupBy("ident", "who").agg(F.count("*").alias("n"))
    table = surrogate_map(listed.select("kind", "value"), key).select(F.col("kind").alias("ident"), F.col("value").alias("who"), "surrogate")
    mapped = spread_join(listed, written(table.join(often, ["ident", "who"]), "surrogates"), ["ident", "who"])
    by_row = mapped.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x00", "ident", "value"), "surrogate"))).alias("to"))
    new = F.transform("ents", lambda e: F.coalesce(F.element_at("to", F.concat_ws("\x00", identity(e["kind"]), e["value"])), e["value"]))
    parts = by_form(lambda p: F.split(row, p, -1))
    text2 = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get("new", i), F.lit("")))), "")
    done = found.join(by_row, "key", "left").select("row", F.filter("ents", lambda e: e["kind"] != "").alias("true"), "ents", parts.alias("parts"), new.alias("new"))
    #: Names found after a title; each is a word of letters and no surrogate is a name that occurs, so they are replaced one after the other.
    names = F.filter(F.arrays_zip(F.col("ents.kind").alias("kind"), F.col("ents.value").alias("value"), "new"), lambda e: e["kind"].isin(*groups))
    done = done.withColumn("names", names)
    alone = lambda name: F.concat(F.lit(r"(?<!\p{L})(?:"), name, F.lit(r")(?!\p{L})"))
    again = F.when(F.size("names") > 0, F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(F.regexp_extract_all(p, alone(F.array_join(F.col("names.value"), "|")), F.lit(0))))).otherwise(0)
    same = F.when(F.size("names") > 0, F.transform("parts", lambda p: F.aggregate("names", p, lambda t, e: F.regexp_replace(t, alone(e["value"]), e["new"])))).otherwise(F.col("parts"))
    done = done.select("row", "true", "new", again.alias("again"), same.alias("parts"))
    done = done.select(*(text2.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names_out), (F.size("true") + F.col("again")).alias("pii_count"), F.array_sort(F.array_distinct(F.col("true.kind"))).alias("pii_kinds"))
    return none.unionByName(done)
