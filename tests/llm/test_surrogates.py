import re

from pyspark.sql import functions as F

from spanloom.llm import surrogates as S

TEXTS = [
    (1, "Mail bob.1@Acme.org or BOB.1@ACME.ORG, +1 (017) 555-7713 is 017-555-7713."),
    (2, "Cards 4111111111111111, 4111 1111 1111 1111 but 9807915762804490 is no card; ip 10.2.3.4, version 1.2.3."),
    (3, "Mrs. Jane Doe met Mr Doe, Frau Müller and Госпожа Анна Каренина."),
    (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789'),
    (5, None), (6, ""), (7, "Nothing here, in 2024 of 12 items."), (None, "again bob.1@acme.org"), (None, "again bob.1@acme.org"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def replaced(spark, rows=TEXTS):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, mark int, c0 string")
    return S.replace_entities(docs).select("doc_id", "text", "n_entities").collect()


def test_kinds_formats_and_coreference(spark):
    got = replaced(spark)
    by = {r.doc_id: r for r in got if r.doc_id}
    one, again = by[1].text, [r.text for r in got if r.doc_id is None]
    mails = re.findall(r"[\w.]+@[\w.]+\w", one)
    assert len(mails) == 2 and mails[0].upper() == mails[1] and "bob" not in mails[0]
    assert again[0] == again[1] == f"again {mails[0]}"
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", one)
    assert len(phones) == 2 and phones[0] == phones[1] != ("017", "555", "7713") and "+1 (" in one
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", by[2].text)
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) and cards[0][0] == "4" and cards[0] != "4111111111111111"
    assert "9807915762804490" in by[2].text and "1.2.3." in by[2].text and "10.2.3.4" not in by[2].text
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+), Frau (\w+) and Госпожа (\w+) (\w+)\.", by[3].text)
    assert names and names[1] in S.GIVEN["f", "latin"] and names[2] == names[3] and names[5] in S.GIVEN["f", "cyrillic"]
    assert re.fullmatch(r"[а-яА-Я]+", names[6])
    assert re.fullmatch(r'token = "[0-9a-f]{40}" iban DE\d\d( \d{4}){4} \d\d ssn \d{3}-\d\d-\d{4}', by[4].text) and "04dbebab" not in by[4].text
    assert (by[5].text, by[6].text, by[7].text) == (None, "", TEXTS[6][1])
    assert [by[i].n_entities for i in (1, 2, 3, 4, 5, 6, 7)] == [4, 3, 4, 3, 0, 0, 0]


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 5)], "doc_id long, text string, n_entities int")
    assert S.keep_private(docs).columns == docs.columns and S.keep_private(docs).first().n_entities == 5
    assert S.replace_entities(docs.limit(0)).count() == 0


def test_runs_agree_and_keys_differ(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    once, twice, other = (sorted(str(r) for r in S.replace_entities(docs, key=k).collect()) for k in ("a", "a", "b"))
    assert once == twice != other


def test_colliding_draws_are_repeated(spark, monkeypatch):
    # surrogates of two digits out of a domain that is nearly full
    monkeypatch.setattr(S, "candidate", lambda key, kind, form, sex, attempt: F.pmod(F.xxhash64(form, attempt), F.lit(120)).cast("string"))
    found = spark.range(60).select(F.lit("phone").alias("kind"), F.concat(F.lit("x"), F.col("id")).alias("form"), F.lit("m").alias("sex"))
    rows = S.dictionary(found).collect()
    assert len(rows) == 60 == len({r.surrogate for r in rows})


def test_surrogate_is_never_a_value_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(S, "candidate", lambda key, kind, form, sex, attempt: F.pmod(form.cast("long") + attempt + 1, F.lit(40)).cast("string"))
    found = spark.range(15).select(F.lit("phone").alias("kind"), F.col("id").cast("string").alias("form"), F.lit("m").alias("sex"))
    rows = S.dictionary(found).collect()
    assert len({r.surrogate for r in rows}) == 15 and not {r.surrogate for r in rows} & {str(i) for i in range(15)}


def test_very_long_text(spark):
    text = "word " * 200_000 + "bob.1@acme.org" + "a" * 100_000
    row = replaced(spark, [(1, text), (2, "1" * 50_000), (3, "a." * 30_000 + "@x")])
    assert {r.doc_id: len(r.text) for r in row}[2] == 50_000


def test_forms_without_room_grow(spark):
    texts = [(i, f"write to {chr(97 + i)}@example.com") for i in range(26)] + [(26, "or to _@example.com now"), (27, "and -@example.com")]
    rows = {r.doc_id: r.text for r in replaced(spark, texts)}
    found = [t.split(" to ")[-1].split()[-1 if i < 26 else 0] for i, t in rows.items() if i < 27]
    assert len(set(found)) == 27 and not set(found) & {f"{chr(97 + i)}@example.com" for i in range(26)}
    assert "_@example.com" not in rows[26]


def test_account_numbers_keep_valid_check_digits(spark):
    text = replaced(spark, [(1, "IBAN DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819.")])[0].text
    numbers = [text[5:32].replace(" ", ""), text.split()[-1].rstrip(".")]
    for number, old in zip(numbers, ("DE89370400440532013000", "GB29NWBK60161331926819")):
        digits = "".join(str(int(c, 36)) for c in number[4:] + number[:4])
        assert number != old and number[:2] == old[:2] and int(digits) % 97 == 1


def test_relatives_keep_one_family_name(spark):
    given = ["John", "Peter", "Paul", "Mark", "Luke", "Adam", "Eric", "Hugo", "Ivan", "Karl", "Leon", "Max"]
    rows = replaced(spark, [(i, f"Mr. {g} Smith came.") for i, g in enumerate(given)])
    names = [r.text.split()[1:3] for r in rows]
    assert len({tuple(n) for n in names}) == len(given) and len({n[1] for n in names}) < len(given) / 2
