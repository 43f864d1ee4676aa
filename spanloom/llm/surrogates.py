"""Surrogates for personal data, in DataFrame operations only.

Found by pattern: e-mail addresses, IPv4 addresses, payment cards (with a
right check digit), telephone numbers, social security numbers, IBANs, secrets
in hexadecimal and names behind a title. An entity is known by its kind and
canonical form (digits, or lower-case letters), so all its spellings share one
surrogate, and each spelling keeps its own punctuation, length and case.
Surrogates come from a keyed hash: digits for digits, hexadecimal for
hexadecimal, valid check digits for cards, given names of the same gender and
script for names. All entities of the corpus are checked together: one that
would share its surrogate with another, or take a value that is itself found
in the corpus, is drawn again until all are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

#: Titles by gender, and given names by gender and script.
TITLES = {"f": "Mrs|Ms|Miss|Madam|Frau|Mme|Madame|Señora|Sra|Госпожа", "m": "Mr|Sir|Herr|Monsieur|Señor|Sr|Господин"}
GIVEN = {
    ("f", "latin"): "Ada Bea Clara Dora Edith Flora Greta Hilda Irma Julia Karla Laura Marta Nora Olga Paula Rosa Sara Tilda Vera".split(),
    ("m", "latin"): "Adam Boris Carl David Egon Frank Georg Hugo Ivo Jakob Karl Leon Mark Nils Otto Paul Ralf Simon Theo Victor".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Инна Лидия Мария Нина".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Максим Павел".split(),
}
CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
NAME = r"\p{Lu}\p{Ll}+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,14}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES['f']}|{TITLES['m']})\.? {NAME}(?: {NAME})?(?![\p{{L}}\p{{N}}])",
}
#: Order of trial where patterns could overlap.
KINDS = ("email", "iban", "secret", "ssn", "phone", "card", "ip", "name")
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
HINT = rf"[0-9@]|(?:{TITLES['f']}|{TITLES['m']})\.? \p{{Lu}}"
KEY = "corpus"
#: Draws of a form before an address grows and a family name changes.
ROOM = 3


def check_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` followed by it pass the check of payment cards."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return ((10 - total % 10) % 10).cast("string")


def kind_of(raw: Column) -> Column:
    """Kind of a match; null for digits that only look like a card."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    valid = (F.length(digits) >= 13) & (F.substring(digits, -1, 1) == check_digit(digits.substr(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)))))
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(valid, F.lit("card")) if kind == "card" else F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (
        F.when(kind == "phone", national)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "name", F.lower(F.regexp_replace(raw, r"^\S+ ", "")))
        .when(kind == "iban", F.upper(F.regexp_replace(raw, " ", "")))
        .otherwise(F.lower(raw))
    )


def gender(raw: Column) -> Column:
    return F.when(raw.rlike(f"^(?:{TITLES['f']})\\.? "), F.lit("f")).otherwise(F.lit("m"))


def drawn(key: str, kind: Column, form: Column, attempt: Column, symbols: Column, count: Column, salt: str = "") -> Column:
    """``count`` symbols from a keyed hash of the entity."""
    base = F.concat_ws("|", F.lit(key), F.lit(salt), kind, form, attempt.cast("string"))

    def one(i: Column) -> Column:
        number = F.conv(F.substring(F.sha2(F.concat_ws("|", base, ((i - 1) / 8).cast("int").cast("string")), 256), ((i - 1) % 8 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
        return F.substring(symbols, (number % F.length(symbols) + 1).cast("int"), F.lit(1))

    return F.array_join(F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), one)).otherwise(F.array().cast("array<string>")), "")


def pattern_of(form: Column, key: str, kind: Column, attempt: Column, letters: str, digits: str) -> Column:
    """``form`` with letters for its letters and digits for its digits; anything else stays."""
    size = F.length(form)
    some = drawn(key, kind, form, attempt, F.lit(letters), size, "letters")
    more = drawn(key, kind, form, attempt, F.lit(digits), size, "digits")

    def one(i: Column) -> Column:
        own = F.substring(form, i, F.lit(1))
        return F.when(own.rlike(r"\p{L}"), F.substring(some, i, F.lit(1))).when(own.rlike("[0-9]"), F.substring(more, i, F.lit(1))).otherwise(own)

    return F.array_join(F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), one)).otherwise(F.array().cast("array<string>")), "")


def with_check(country: Column, account: Column) -> Column:
    """An account number behind its country and the two check digits that leave 1 modulo 97."""
    tail = F.concat(account, country, F.lit("00"))

    def step(rest: Column, i: Column) -> Column:
        own = F.substring(tail, i, F.lit(1))
        return F.when(own.rlike("[0-9]"), rest * 10 + F.ascii(own) - 48).otherwise(rest * 100 + F.ascii(own) - 55) % 97

    rest = F.aggregate(F.sequence(F.lit(1), F.length(tail)), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def candidate(key: str, kind: Column, form: Column, sex: Column, attempt: Column) -> Column:
    """Surrogate in canonical form."""
    latin, numbers = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    size = F.length(form)
    digits = drawn(key, kind, form, attempt, F.lit(numbers), size)
    body = F.concat(F.substring(form, 1, 1), F.substring(digits, F.lit(1), F.greatest(size - 2, F.lit(0))))
    card = F.concat(body, check_digit(body))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), form, attempt.cast("string")), 256), (i * 6 - 5).cast("int"), F.lit(6)), 16, 10).cast("long") % 254 + 1).cast("string")), ".")
    domain = F.regexp_extract(form, "@(.*)$", 1)
    tail = F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tail))
    # names of domains kept for examples stay as they are, others become one of them
    reserved = host.rlike(r"(^|\.)example$")
    inner = F.when(reserved, F.regexp_extract(host, r"^(.*?)\.?example$", 1)).otherwise(host)
    label = pattern_of(inner, key, F.lit("host"), attempt, latin, numbers)
    # a local part without room, of symbols alone or one letter, grows from some draw on
    longer = drawn(key, F.concat(kind, F.lit("+")), form, attempt, F.lit(latin), F.greatest(attempt - ROOM, F.lit(0)))
    mail = F.concat(
        pattern_of(F.regexp_extract(form, "^(.*)@", 1), key, F.concat(kind, F.lit(":"), domain), attempt, latin, numbers), longer, F.lit("@"),
        label, F.when(inner == "", F.lit("")).otherwise(F.lit(".")), F.lit("example"), tail,
    )
    script = F.when(form.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    name = F.lit(None).cast("string")
    # a collision changes the given name first, so relatives go on sharing theirs
    again = F.when(form.contains(" "), F.greatest(attempt - ROOM, F.lit(0))).otherwise(attempt)
    for (s, alphabet), given in GIVEN.items():
        first = F.lower(F.element_at(F.array(*[F.lit(g) for g in given]), (F.pmod(F.xxhash64(F.lit(key), F.lit("given"), F.split(form, " ")[0], attempt), F.lit(len(given))) + 1).cast("int")))
        # drawn for the family name alone, which people without a given name share
        family = F.element_at(F.split(form, " "), -1)
        c = drawn(key, kind, family, again, F.lit(CONSONANTS[alphabet]), F.lit(4), "c")
        v = drawn(key, kind, family, again, F.lit(VOWELS[alphabet]), F.lit(4), "v")
        last = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.substring(c, i, F.lit(1)), F.substring(v, i, F.lit(1)))), "")
        name = F.when((sex == s) & (script == alphabet), F.when(form.contains(" "), F.concat_ws(" ", first, last)).otherwise(last)).otherwise(name)
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "secret", drawn(key, kind, form, attempt, F.lit("0123456789abcdef"), size))
        .when(kind == "name", name)
        .when(kind == "iban", with_check(F.upper(F.substring(form, 1, 2)), F.upper(pattern_of(F.substring(form, F.lit(5), F.greatest(size - 4, F.lit(0))), key, kind, attempt, latin, numbers))))
        .otherwise(digits)
    )


def rendered(kind: Column, raw: Column, form: Column) -> Column:
    """A surrogate in the spelling of ``raw``: its punctuation, prefix and case."""
    parts = F.split(raw, "[0-9]", -1)
    lead = F.when(kind == "phone", F.size(parts) - 1 - F.length(form)).otherwise(F.lit(0))
    own = F.regexp_replace(raw, "[^0-9]", "")
    digits = F.concat(F.substring(own, F.lit(1), lead), form)
    numbers = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substring(digits, i + 1, F.lit(1)))), "")
    gaps = F.split(raw, "[A-Za-z0-9]", -1)
    letters = F.array_join(F.transform(gaps, lambda p, i: F.concat(p, F.substring(form, i + 1, F.lit(1)))), "")
    shout = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (
        F.when(kind.isin("phone", "card", "ssn"), numbers)
        .when(kind == "iban", letters)
        .when(kind == "name", F.concat(F.regexp_extract(raw, r"^(\S+ )", 1), F.initcap(form)))
        .when(shout, F.upper(form))
        .otherwise(form)
    )


def entities(text: Column) -> Column:
    """All matches in order, as structs of raw, kind, form and sex; kind is null for what stays."""
    raw = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    return F.transform(raw, lambda r: F.struct(r.alias("raw"), kind_of(r).alias("kind")))


def dictionary(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, form, surrogate) for the distinct entities (kind, form, sex) of a corpus, all distinct.

    Entities whose draws collide draw again; the smallest form of a collision
    keeps its draw. Only entities still without a surrogate are looked at again.
    """
    open_ = cut_lineage(found.groupBy("kind", "form").agg(F.min("sex").alias("sex")))
    forms = open_.select(F.col("kind").alias("k"), F.col("form").alias("f"))
    done = None
    attempt = 0
    while True:
        tried = open_.withColumn("surrogate", candidate(key, F.col("kind"), F.col("form"), F.col("sex"), F.lit(attempt)))
        tried = cut_lineage(tried)
        first = tried.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        if done is not None:
            first = first.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # a value that someone in the corpus has is nobody's surrogate
        first = first.join(forms, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("f")), "left_anti")
        good = first.select("kind", "form", "surrogate")
        done = cut_lineage(good if done is None else done.union(good))
        open_ = tried.drop("surrogate").join(done.select("kind", "form"), ["kind", "form"], "left_anti")
        open_ = cut_lineage(open_)
        if open_.limit(1).count() == 0:
            return done
        attempt += 1


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """All rows and columns of ``docs``, entities in ``text`` replaced, then ``n_entities`` (long).

    A null text stays null, an empty one empty, and a text without entities
    stays as it is, byte by byte. Equal texts get equal results, so repeated
    rows and missing ids need nothing else. Other columns may have any names.
    """
    names = docs.columns
    at = f"c{names.index(text)}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    some = F.col(at).isNotNull() & F.col(at).rlike(HINT)
    seen = rows.where(some).select(F.col(at).alias("text")).withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    seen = seen.select("mark", entities(F.col("text")).alias("found")).where(F.size("found") > 0)
    seen = cut_lineage(seen.groupBy("mark").agg(F.first("found").alias("found")))
    each = seen.select("mark", F.explode("found").alias("e")).where("e.kind is not null")
    each = each.select("mark", F.col("e.raw").alias("raw"), F.col("e.kind").alias("kind"), canonical(F.col("e.kind"), F.col("e.raw")).alias("form"), gender(F.col("e.raw")).alias("sex"))
    known = dictionary(each.select("kind", "form", "sex"), key)
    told = each.select("mark", "raw", "kind", "form").distinct().join(known, ["kind", "form"])
    told = told.select("mark", F.struct(F.col("raw").alias("key"), rendered(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("value")).alias("pair"))
    told = told.groupBy("mark").agg(F.map_from_entries(F.collect_list("pair")).alias("names"))
    plain = rows.where(~F.coalesce(some, F.lit(False))).withColumn("n", F.lit(0).cast("long"))
    rich = rows.where(F.coalesce(some, F.lit(False))).withColumn("mark", F.sha2(F.col(at).cast("binary"), 256)).join(told, "mark", "left")
    raw = F.regexp_extract_all(F.col(at), F.lit(f"({ANY})"), F.lit(1))
    parts = F.split(F.col(at), ANY, -1)
    rich = rich.withColumn("raw", F.when(F.col("names").isNotNull(), raw)).withColumn("parts", F.when(F.col("names").isNotNull(), parts))
    whole = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.when(i < F.size("raw"), F.coalesce(F.element_at("names", F.get("raw", i)), F.get("raw", i))).otherwise(F.lit("")))), "")
    count = F.size(F.filter("raw", lambda r: F.element_at("names", r).isNotNull()))
    rich = rich.select(
        *[c for c in rows.columns if c != at],
        F.when(F.col("names").isNotNull(), whole).otherwise(F.col(at)).alias(at),
        F.when(F.col("names").isNotNull(), count).otherwise(0).cast("long").alias("n"),
    )
    out = plain.unionByName(rich)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("n").alias("n_entities"))


def keep_private(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, nothing else changed."""
    return replace_entities(docs, text, key).toDF(*docs.columns, "__n").select(*docs.columns)
