"""Surrogates: nothing original is left, formats and kinds stay, distinct and coreferent."""

import re

import pytest

from transvoc.llm import pii, queries

KEY = b"k"
TEXT = ("Mail jane.doe+x@Mail.Example.org or JANE.DOE+X@MAIL.EXAMPLE.ORG, call +49 (30) 1234-5678, +49 30 12345678, "
        "(212) 555-1234. Card 4111 1111 1111 1111 / 4111111111111111, IBAN DE89 3704 0044 0532 0130 00, host 10.1.2.3, "
        "SSN 078-05-1120. Mr. John Smith met Frau Anna Müller; Dr. Smith and господин Иван Петров left.")


def kinds(text):
    return [(m.kind, m.normal) for m in pii.detect(text)]


def test_detect():
    found = kinds(TEXT)
    assert found == [
        ("email", "jane.doe+x@mail.example.org"), ("email", "jane.doe+x@mail.example.org"),
        ("phone", "49|3012345678"), ("phone", "49|3012345678"), ("phone", "|2125551234"),
        ("card", "4111111111111111"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"),
        ("ip", "10.1.2.3"), ("ssn", "078051120"), ("given_m", "john"), ("surname", "smith"), ("given_f", "anna"),
        ("surname", "müller"), ("surname", "smith"), ("given_m", "иван"), ("surname", "петров")]


@pytest.mark.parametrize("text", ["version 3.", "Licensed under CC BY-NC 4.0.", "pi 3.14159265358979", "in 2024-2025 or 1,234,567",
                                  "a@b", "@user and x @ y.org", "see 1.2.3 and 1.2.3.4.5", "Don Quixote", "12345",
                                  "0cab398dc11d1a2a11dc6572c8df8bd228c864f3", "AB12 is short", None, "", "@" * 1000])
def test_left_alone(text):
    assert pii.detect(text) == []


PLANTED = {
    "John Smith wrote; Mr. Smith left. SMITH's, Smith-Jones": "John Smith Smith SMITH Smith",
    "Dr. Anna Maria Schmidt came. Maria Schmidt left": "Anna Maria Schmidt Maria Schmidt",
    "Prof. Dr. Müller and Frau Prof. Dr. Weber; Müller spoke": "Müller Weber Müller",
    "Mr. J. Smith, Dr. J. R. R. Tolkien and K. Smith": "J. Smith J. R. R. Tolkien K. Smith",
    "Mr. van der Berg met Mr. John de Souza. Berg and Souza": "Berg John Souza Berg Souza",
    "Mr. Le said The rest; Dr. d'Arcy Jones's book": "Le d'Arcy Jones",
    "Herr Müller\n\nKapitel": "Müller", "Mrs. Smith The book": "Smith",
    "0171 1234567; 01 23 45 67 89; 030/12345678; 020 7946 0958": "0171 1234567;01 23 45 67 89;030/12345678;020 7946 0958",
    "(0171) 1234567, 0612345678, 8 (495) 123-45-67, 1-800-555-1234":
        "(0171) 1234567;0612345678;8 (495) 123-45-67;1-800-555-1234",
    "212 555 1234 and 0049 30 1234567": "212 555 1234;0049 30 1234567"}


@pytest.mark.parametrize("text", PLANTED)
def test_planted(text):
    """What the text's author calls a name or a number, not what detect() does."""
    found = pii.detect(text)
    planted = PLANTED[text]
    assert (";" if ";" in planted else " ").join(text[m.start:m.end] for m in found) == planted


@pytest.mark.parametrize("text", ["05.12.2024", "on 05-12-2024 and 01 05 2024", "0.5 1234", "09:30-10:30", "1/2/2024 3/4/2024",
                                  "0123", "smith", "Smith wrote", "1 234 567 890", "2024/05/12 10 20"])
def test_no_phone_or_name(text):
    assert pii.detect(text) == []


def test_planted_are_gone(spark):
    texts = list(PLANTED) + ["call 0049 30 1234567 or +49 30 1234567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, KEY).collect()}
    for i, old in enumerate(PLANTED):
        planted = PLANTED[old]
        for word in planted.split(";") if ";" in planted else [w for w in planted.split() if len(w) > 2]:
            assert not re.search(rf"(?<!\w){re.escape(word)}(?!\w)", new[i]), (old, new[i])
    smiths = re.fullmatch(r"(\w+) (\w+) wrote; Mr. (\w+) left. (\w+)'s, (\w+)-Jones", new[0])
    assert smiths[2] == smiths[3] == smiths[4].capitalize() == smiths[5]
    assert re.fullmatch(r"Mr. \w+\. \w+, Dr. \w+\. \w+\. \w+\. \w+ and \w+\. \w+", new[3])
    assert re.fullmatch(r"0\d{3} \d{7}; 0\d \d\d \d\d \d\d \d\d; 0\d\d/\d{8}; 0\d\d \d{4} \d{4}", new[8])
    one, two = re.fullmatch(r"call 0049 (\d\d \d{7}) or \+49 (\d\d \d{7})", new[len(PLANTED)]).groups()
    assert one == two


def test_rewritten(spark):
    row = pii.pseudonymize(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), KEY).first()
    new = row["text"]
    a, b = kinds(TEXT), kinds(new)
    assert [k for k, _ in a] == [k for k, _ in b] and row["n_entities"] == len(a)
    assert not {x for x in a} & {x for x in b}
    forth = dict(zip(a, b, strict=True))
    assert all(forth[x] == y for x, y in zip(a, b, strict=True)) and len(set(forth.values())) == len(forth)
    assert re.search(r"call \+49 \(\d\d\) \d{4}-\d{4}, \+49 \d\d \d{8}, \(\d{3}\) \d{3}-\d{4}\.", new)
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) / (\d{16})", new)
    assert card[1].replace(" ", "") == card[2] and pii._luhn(card[2]) == 0
    iban = re.search(r"IBAN ([A-Z0-9 ]{27})", new)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    upper = re.findall(r"\S+@\S+?(?=[ ,])", new)
    assert upper[1].isupper() and upper[0].lower() == upper[1].lower()
    assert pii.script_of(b[-1][1]) == "CYRILLIC" and b[10][1] in [n.casefold() for n in pii.GIVEN["m", "LATIN"]]
    assert b[12][1] in [n.casefold() for n in pii.GIVEN["f", "LATIN"]]


def test_collisions(spark):
    """More names than the list has, and numbers of a tiny space: still one to one."""
    rows = [("surname", f"name{i}") for i in range(300)] + [("ssn", f"{i:02d}") for i in range(60)] \
        + [("given_f", f"x{i}") for i in range(80)]
    # Sixty of the hundred numbers of two digits are originals: some surrogates must be longer.
    table = pii.surrogate_table(spark.createDataFrame(rows, "kind string, normal string"), KEY).collect()
    assert len(table) == len(rows)
    assert len({(r["kind"], r["surrogate"]) for r in table}) == len(rows)
    assert not {(r["kind"], r["surrogate"]) for r in table} & set(rows)


def form(name):
    """The genders that a made or listed name shows."""
    script = pii.script_of(name)
    return {g for (g, x), names in pii.GIVEN.items() if x == script and name in [n.casefold() for n in names]} or {
        g for (g, x), ends in pii.ENDINGS.items() if x == script and name.endswith(tuple(ends))}


def test_gender_never_runs_out(spark):
    """Every listed name is an original and there are hundreds more."""
    listed = [(f"given_{g}", n.casefold()) for (g, _), names in pii.GIVEN.items() for n in names]
    more = [(f"given_{g}", f"{x}{i}") for g in "mfx" for x in ("name", "имя") for i in range(300)]
    rows = {r["normal"] + r["kind"]: r for r in pii.surrogate_table(
        spark.createDataFrame(listed + more, "kind string, normal string"), KEY).collect()}
    assert len(rows) == len({(r["kind"], r["surrogate"]) for r in rows.values()}) == len(listed) + len(more)
    for r in rows.values():
        assert form(r["surrogate"]) == {r["kind"][-1]}, r
        assert pii.script_of(r["surrogate"]) == pii.script_of(r["normal"])
    assert not {(r["kind"], r["surrogate"]) for r in rows.values()} & set(listed + more)


def test_unknown_gender():
    """Neither title nor list tells a gender: neutral, unless the text does elsewhere."""
    assert kinds("Dr. Zoltan Kiss")[0] == ("given_x", "zoltan")
    assert kinds("Dr. Anna Kiss")[0] == ("given_f", "anna") and kinds("Dr. Anna Zoltan Kiss")[1] == ("given_f", "zoltan")
    assert kinds("Dr. Zoe Kiss and Mrs. Zoe Kiss")[0] == ("given_f", "zoe")


def test_key_matters_and_reruns_agree(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    one, two, other = (pii.pseudonymize(df, k).first()["text"] for k in (KEY, KEY, b"other"))
    assert one == two != other


def test_edges(spark, edge_docs, no_docs, clashing):
    mixed = clashing.withColumn("text", pii.F.when(pii.F.col("doc_id") == 1, pii.F.lit(TEXT)).otherwise(pii.F.col("text")))
    rows = pii.pseudonymize(mixed, KEY).collect()
    assert len(rows) == 13 and pii.pseudonymize(mixed, KEY).columns == [*mixed.columns, "n_entities_1"]
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and same[0]["text"] == same[1]["text"] != TEXT
    before = sorted(str(r["text"]) for r in mixed.collect() if r["doc_id"] != 1)
    assert sorted(str(r["text"]) for r in rows if r["doc_id"] != 1) == before
    assert pii.pseudonymize(no_docs, KEY).collect() == []
    assert pii.pseudonymize(edge_docs, KEY).count() == 13


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_pii_surrogates(spark, sf).collect()
    assert len(rows) == len(before)
    for r in rows:
        old = pii.detect(before[r["doc_id"]])
        assert r["n_entities"] == len(old) and (old or r["text"] == before[r["doc_id"]])
        for m in old:
            assert before[r["doc_id"]][m.start:m.end] not in r["text"]


def test_short_addresses_never_run_out(spark):
    from itertools import product as pairs
    from string import ascii_lowercase as az
    rows = [(i, f"write to {a}@{b}.co now") for i, (a, b) in enumerate(pairs(az, az))]
    rows += [(1000 + i, f"or {a}@{b}.com") for i, (a, b) in enumerate(pairs("0123456789", "0123456789"))]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    given = [r.text.split()[2 if r.doc_id < 1000 else 1] for r in out]
    assert len(set(given)) == len(rows) and not set(given) & {t.split()[2 if i < 1000 else 1] for i, t in rows}


def test_no_name_gets_another_name_of_the_corpus(spark):
    men = [n for n in pii.GIVEN["m", "LATIN"]]
    women = [n for n in pii.GIVEN["f", "LATIN"]]
    rows = [(i, f"Mr. Xavi {n} and Ms. Yara {w}") for i, (n, w) in enumerate(zip(men, women, strict=True))]
    rows += [(100 + i, f"Mr. Zed{'abcdefghij'[i]} Quux") for i in range(10)]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    real = {w.casefold() for _, t in rows for w in t.split() if w[0].isupper()} - {"mr.", "ms."}
    for r in out:
        assert not {w.casefold() for w in r.text.split()} & real


def test_one_person_under_two_titles(spark):
    rows = [(1, "Mr. Kimbo Leeson came."), (2, "Dr. Kimbo Leeson left."), (3, "Dr. Qimbo Leeson left.")]
    out = {r.doc_id: r.text.split()[1:3] for r in pii.pseudonymize(
        spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert out[1] == out[2] and out[3][0] != out[1][0] and out[3][1] == out[1][1]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a@b.co", "p", 7, "m")], "doc_id long, text string, pairs string, n_entities int, mark string")
    r = pii.pseudonymize(df, b"k").first()
    assert (r.pairs, r.n_entities, r.mark, r.n_entities_1) == ("p", 7, "m", 1) and r.text != "a@b.co"
