"""Personal data replaced by keyed surrogates.

E-mail addresses, phone, card, account and social security numbers, IPv4 addresses and names after a title are
detected. Every entity is brought to a canonical form (so that spellings of one number or address corefer) and gets
one surrogate for the whole corpus, drawn from a digest of the key, the kind and the canonical form: the same kind
of thing in the same script and, for names, of the same gender. Surrogates that two entities would share, or that
occur as real entities, are drawn again, until all are distinct. They are then written in the format of each mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES = {
    "name_m": r"Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Г-н|Κύριος",
    "name_f": r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Г-жа|Κυρία",
}
_NAME = r"\p{Lu}[\p{L}'’-]+(?:\x20\p{Lu}[\p{L}'’-]+){0,2}"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_CARD = r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])"
#: Between the digits of a number that begins with +; a space before another kind of number ends it.
_GAP = rf"(?:(?!\x20(?:{_IP}|{_SSN}|{_CARD}(?![\x20-][0-9])))(?:[\x20\u00A0\u202F][-–/][\x20\u00A0\u202F]|[\x20\u00A0\u202F./‐‑–-]))?"
#: 7 to 15 digits in groups of any width.
_GROUPS = rf"\+[0-9](?:{_GAP}\(?[0-9]\)?){{6,14}}"
#: Kinds in the order in which they are tried at a place. A domain name has at most 127 labels; without that bound the
#: matcher's stack would grow with the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}\p{M}._%+-])[\p{L}\p{N}][\p{L}\p{N}\p{M}._%+-]*@(?:[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}-]*[\p{L}\p{N}\p{M}])?\.){1,126}\p{L}[\p{L}\p{M}]+",
    "ip": _IP,
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": _SSN,
    "phone": rf"(?<![0-9+])(?:{_GROUPS}(?![0-9])|" + r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}|\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": _CARD,
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(_TITLES.values())})\.?\x20{_NAME}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Letters that stand in for each other, by script and case.
_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåçèéêëìíîïñòóôõöùúûüý", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: What letters and digits outside those lists are drawn from, by class; the first class that holds one counts.
_DRAWN = {
    r"\p{N}": "0123456789", r"\p{IsCyrillic}": _ALPHABETS[5], r"\p{IsGreek}": _ALPHABETS[7],
    **{
        rf"\p{{Is{script}}}": "".join(x for x in map(chr, range(first, last + 1)) if x.isalpha())
        for script, first, last in (
            ("Han", 0x4E00, 0x5DFF), ("Hangul", 0xAC00, 0xB3FF), ("Hiragana", 0x3041, 0x3096), ("Katakana", 0x30A1, 0x30FA), ("Bopomofo", 0x3105, 0x312F),
            ("Arabic", 0x0621, 0x064A), ("Hebrew", 0x05D0, 0x05EA), ("Syriac", 0x0710, 0x072F), ("Thaana", 0x0780, 0x07A5), ("Armenian", 0x0561, 0x0586),
            ("Georgian", 0x10D0, 0x10F0), ("Ethiopic", 0x1200, 0x1248), ("Devanagari", 0x0905, 0x0939), ("Bengali", 0x0985, 0x09B9), ("Gurmukhi", 0x0A05, 0x0A39),
            ("Gujarati", 0x0A85, 0x0AB9), ("Oriya", 0x0B05, 0x0B39), ("Tamil", 0x0B85, 0x0BB9), ("Telugu", 0x0C05, 0x0C39), ("Kannada", 0x0C85, 0x0CB9),
            ("Malayalam", 0x0D05, 0x0D39), ("Sinhala", 0x0D85, 0x0DC6), ("Thai", 0x0E01, 0x0E2E), ("Lao", 0x0E81, 0x0EAE), ("Tibetan", 0x0F40, 0x0F6C),
            ("Myanmar", 0x1000, 0x102A), ("Khmer", 0x1780, 0x17A2), ("Mongolian", 0x1820, 0x1842),
        )
    },
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
#: Consonants, vowels and the endings of men's and women's names, by script.
_SYLLABLES = {
    "latin": ("bdfgklmnprstv", "aeiou", ("n", "r", "s", "k"), ("na", "la", "ra", "sa")),
    "cyrillic": ("бвгдклмнпрстф", "аеиоу", ("н", "р", "в", "к"), ("на", "ла", "ра", "са")),
    "greek": ("βγδκλμνπρστφχ", "αεηιο", ("ς", "ης", "ων", "ος"), ("να", "λα", "ρα", "σα")),
}
ATTEMPTS = 64


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str | tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in letters]), n % len(letters) + 1)


def _shifted(value: Column, digest: Column) -> Column:
    """Every letter and digit moved inside its own script and case, or drawn anew from its script (Latin, if that isn't
    known) where it has no place in the lists; all else stays."""

    def one(ch: Column, i: Column) -> Column:
        out, at = ch, _byte(digest, i) * 256 + _byte(digest, i + 11) + F.floor(i / 32).cast("int")
        for k, a in reversed(_DRAWN.items()):
            out = F.when(ch.rlike(k), F.substr(F.lit(a), at % len(a) + 1, F.lit(1))).otherwise(out)
        for a in _ALPHABETS:
            at = F.instr(F.lit(a), ch)
            out = F.when(at > 0, F.substr(F.lit(a), (at - 1 + _byte(digest, i) + F.floor(i / 32).cast("int")) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _octets(value: Column, digest: Column) -> Column:
    """Octets replaced by ones with as many digits."""

    def one(x: Column, i: Column) -> Column:
        b = _byte(digest, i * 2) * 256 + _byte(digest, i * 2 + 1)
        return F.when(F.length(x) == 1, b % 10).when(F.length(x) == 2, 10 + b % 90).otherwise(100 + b % 156).cast("string")

    return F.array_join(F.transform(F.split(value, "\\."), one), ".")


def _word(value: Column, digest: Column, attempt: Column, gender: str | None) -> Column:
    """A made-up name in the script of ``value``; later attempts are longer, so there is always another one."""

    def of(script: str) -> Column:
        consonants, vowels, men, women = _SYLLABLES[script]
        parts = F.transform(
            F.sequence(F.lit(0), F.lit(1 if gender else 2) + F.floor(attempt / 4).cast("int")),
            lambda i: F.concat(_pick(tuple(consonants), _byte(digest, i * 2)), _pick(tuple(vowels), _byte(digest, i * 2 + 1))),
        )
        end = F.lit("") if gender is None else _pick(men if gender == "m" else women, _byte(digest, F.lit(31)))
        return F.concat(F.array_join(parts, ""), end)

    return F.when(value.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"^\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _surrogate(key: str) -> Column:
    """Surrogate (canonical form) of columns kind, canon and attempt."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, canon, attempt.cast("string")), 256)
    top = F.length(F.substring_index(canon, ".", -1)) + 1
    # Later attempts are longer, so there is always another one.
    more = F.when(attempt >= 4, F.lower(_word(canon, digest, attempt, None))).otherwise("")
    mail = F.concat(more, _shifted(F.substr(canon, F.lit(1), F.length(canon) - top), digest), F.substr(canon, F.length(canon) - top + 1, top))
    account = F.concat(F.substr(canon, F.lit(1), F.lit(2)), _shifted(F.substr(canon, F.lit(3), F.length(canon)), digest))
    return (
        F.when(kind == "email", mail).when(kind == "ip", _octets(canon, digest)).when(kind == "iban", account)
        .when(kind == "name_m", _word(canon, digest, attempt, "m")).when(kind == "name_f", _word(canon, digest, attempt, "f"))
        .when(kind == "surname", _word(canon, digest, attempt, None)).otherwise(_shifted(canon, digest))
    )


def mentions(texts: DataFrame) -> DataFrame:
    """row, pos, sub, kind, value, canon, lead of every entity in ``texts`` (row, text).

    Names give one row per word (``sub``): all but the last of several words are given names, of the gender of
    the title, the last (or only) one is a surname, so that "Mrs. A B" and "Mrs. B" agree on B. ``lead`` is the title.
    """
    found = texts.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))).alias("pos", "value"))
    kind = F.lit("name")
    for k, p in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(F.col("value").rlike(f"^(?:{p})$"), F.lit(k)).otherwise(kind)
    found = found.withColumn("kind", kind)
    title = F.regexp_extract("value", rf"^(?:{'|'.join(_TITLES.values())})\.?\x20", 0)
    man = F.col("value").rlike(rf"^(?:{_TITLES['name_m']})\.?\x20")
    found = found.withColumn("lead", F.when(F.col("kind") == "name", title).otherwise(F.lit("")))
    body = F.substr("value", F.length("lead") + 1, F.length("value"))
    found = found.withColumn("_man", man).withColumn("_words", F.when(F.col("kind") == "name", F.split(body, " ")).otherwise(F.array("value")))
    found = found.select("row", "pos", "kind", "lead", "_man", F.size("_words").alias("_n"), F.posexplode("_words").alias("sub", "value"))
    part = F.when(F.col("sub") == F.col("_n") - 1, F.lit("surname")).when(F.col("_man"), F.lit("name_m")).otherwise(F.lit("name_f"))
    found = found.withColumn("kind", F.when(F.col("kind") == "name", part).otherwise(F.col("kind")))
    digits = F.regexp_replace("value", "[^0-9]", "")
    canon = F.when(F.col("kind").isin("phone", "card", "ssn"), digits).when(F.col("kind") == "iban", F.replace("value", F.lit(" "), F.lit("")))
    canon = canon.when(F.col("kind") == "ip", F.col("value")).otherwise(F.lower("value"))
    return found.select("row", "pos", "sub", "kind", "value", canon.alias("canon"), "lead")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct (kind, canon): no two alike inside a kind, none a real entity of it."""
    rows = c.save(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key)), "surrogates")
    for _ in range(ATTEMPTS):
        real = rows.select("kind", F.col("canon").alias("surrogate")).withColumn("_real", F.lit(True))
        owner = rows.groupBy("kind", "surrogate").agg(F.min("canon").alias("_owner"), F.count(F.lit(1)).alias("_n"))
        clash = c.save(owner.join(real, ["kind", "surrogate"], "left").where("_n > 1 or _real"), "clashes")
        if clash.isEmpty():
            return rows.select("kind", "canon", "surrogate")
        again = F.col("_n").isNotNull() & (F.col("_real").isNotNull() | (F.col("canon") != F.col("_owner")))
        rows = rows.join(clash, ["kind", "surrogate"], "left").withColumn("attempt", F.col("attempt") + F.when(again, 1).otherwise(0))
        rows = c.save(rows.select("kind", "canon", "attempt").withColumn("surrogate", _surrogate(key)), "surrogates")
    raise RuntimeError("surrogates still clash; raise ATTEMPTS")


def _written() -> Column:
    """The surrogate in the format of ``value``: digits poured into its places, capitals as they were."""
    value, new = F.col("value"), F.col("surrogate")
    number = F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("at")),
        lambda a, ch: F.when(ch.rlike("[0-9A-Z]"), F.struct(F.concat(a["s"], F.substr(new, a["at"], F.lit(1))).alias("s"), (a["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(a["s"], ch).alias("s"), a["at"].alias("at"))),
    )["s"]
    cased = F.array_join(F.transform(F.split(new, ""), lambda ch, i: F.when(F.substr(value, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(ch)).otherwise(ch)), "")
    return F.when(F.col("kind").isin("phone", "card", "ssn", "iban"), number).when(F.col("kind") == "ip", new).otherwise(cased)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text with surrogates, n_entities and kinds (map of kind to number).

    All else in a text stays as it is; a text without entities is returned unchanged, a null one as null.
    Null and repeated ids are passed on; every row is treated for itself, with the same surrogates. An empty
    table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # Most texts have neither a digit, an @ nor a title, and need no closer look.
    maybe = F.col("text").rlike("[0-9@]")
    for title in "|".join(_TITLES.values()).split("|"):
        maybe = maybe | F.contains("text", F.lit(title))
    has = F.coalesce(maybe & F.col("text").rlike(_ANY), F.lit(False))
    hit = c.save(rows.where(has).withColumn("row", F.monotonically_increasing_id()), "texts")
    found = c.save(mentions(hit.select("row", "text")), "mentions")
    total = found.count()
    counts = found.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("_n"))
    named = counts.join(surrogates(found, key), ["kind", "canon"])
    new = c.routed(found, named, ["kind", "canon"], total).withColumn("_new", _written())
    new = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "lead", "kind", "_new"))).alias("_e"))
    # Rows come in order; the first word of a mention brings the title, later words a space.
    filled = F.expr("""
        aggregate(_e, cast(array() AS array<string>), (a, e) ->
            IF(e.sub = 0, concat(a, array(concat(e.lead, e._new))), concat(slice(a, 1, size(a) - 1), array(concat(a[size(a) - 1], ' ', e._new)))))""")
    done = hit.join(new, "row").withColumn("_f", filled).withColumn("_s", F.split("text", _ANY, -1))
    done = done.select(
        "id", F.expr("array_join(transform(_s, (x, i) -> concat(x, coalesce(get(_f, i), ''))), '')").alias("text"), F.size("_f").alias("n_entities"),
        F.expr("map_from_entries(transform(array_distinct(_e.kind), k -> struct(k, size(filter(_e, e -> e.kind = k)))))").alias("kinds"),
    )
    none = rows.where(~has).withColumn("n_entities", F.lit(0)).withColumn("kinds", F.expr("cast(map() AS map<string, int>)"))
    return done.unionByName(none)
