import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import pii
from leafmill.llm.common import Folder
from tests.llm.cases import documents

TEXTS = [
    (20, "Write to ana.12@mail7.example.com, or ANA.12@MAIL7.EXAMPLE.COM; not bo.12@mail7.example.com."),
    (21, "Call +1 (017) 555-7713 or +1 017 555 7713. IP 97.51.17.173. Not 1.2.3.4.5 or 999.1.1.1."),
    (22, "Card 4111 1111 1111 1111 and 4111111111111111### then 9807915762804490!! SSN 123-45-6789."),
    (23, "Mrs. Ann Smith met Mr Bob Smith; later Mr. Smith left. Господин Иван Петров тоже. Dr. Lee"),
    (24, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000, not deadbeef0123456789abcdef01234567"),
    (25, "ana.12@mail7.example.com again 97.51.17.173"),
    (25, "ana.12@mail7.example.com again 97.51.17.173"),
    (None, "Card 4111111111111111"),
]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_replacements(spark):
    docs = documents(spark, TEXTS)
    rows = pii.report(docs).collect()
    assert len(rows) == docs.count()
    made = {}
    for r in rows:
        made.setdefault(r.doc_id, []).append(r)
    old = {i: t for i, t in TEXTS}
    for r in rows:
        if r.n_entities == 0:
            assert r.text in [d.text for d in docs.where(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).collect()]
    text = {i: v[0].text for i, v in made.items()}
    mails = re.findall(r"[\w.]+@[\w.]+\w", text[20])
    assert mails[0].upper() == mails[1] and mails[0] != mails[2] and mails[0].split("@")[1] == mails[2].split("@")[1]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@m[0-9a-f]{10}\.example\.net", mails[0])
    a, b = re.match(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\. IP ", text[21]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and "0175557713" not in re.sub(r"\D", "", a)
    assert text[21].endswith("Not 1.2.3.4.5 or 999.1.1.1.") and "97.51.17.173" not in text[21]
    c, d, e = re.match(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})### then (\d{16})!! SSN \d{3}-\d{2}-\d{4}\.$", text[22]).groups()
    assert c.replace(" ", "") == d and luhn(d) and d != "4" + "1" * 15 and e != d
    m = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+) (\w+); later Mr\. (\w+) left\. Господин (\w+) (\w+) тоже\. Dr\. (\w+)$", text[23]).groups()
    assert m[1] == m[3] == m[4] != m[7] and m[0] != m[2] and re.fullmatch("[А-Яа-я]+", m[5] + m[6])
    assert m[0].endswith(tuple(pii.ENDINGS["f", "Latn"].split())) and m[2].endswith(tuple(pii.ENDINGS["m", "Latn"].split()))
    first, second = re.match(r"IBAN (DE\d\d (?:\d{4} ){4}\d\d) or (DE\d{20}), not deadbeef0123456789abcdef01234567$", text[24]).groups()
    assert first.replace(" ", "") == second != old[24]
    assert mails[0] in text[25] and len(made[25]) == 2
    assert d in [r.text for r in rows if r.doc_id is None and r.n_entities][0]


def test_distinct_even_when_formats_are_crowded(spark):
    # 60 of 90 two-digit numbers: draws clash and are drawn again, in the end with a digit more.
    found = [("ssn", str(n), None) for n in range(10, 70)] + [("given_Latn", f"n{i}", "f") for i in range(200)] + [("local", f"{c}@x.org", None) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    frame = spark.createDataFrame(found, "kind string, norm string, gender string")
    rows = pii.surrogates(frame, Folder(spark, "test")).collect()
    assert len({(r.kind, r.surrogate.lower()) for r in rows}) == len(rows) == 296
    assert not {(r.kind, r.surrogate) for r in rows} & {(r.kind, r.norm) for r in rows}
    assert all(re.fullmatch(r"\d+", r.surrogate) for r in rows if r.kind == "ssn")


def test_a_full_format_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "LAST_DRAW", 2)
    frame = spark.createDataFrame([("ssn", str(n), None) for n in range(10)], "kind string, norm string, gender string")
    with pytest.raises(ValueError, match="ssn"):
        pii.surrogates(frame, Folder(spark, "test"))


def test_names_keep_script_gender_and_coreference(spark):
    texts = [
        (1, "Dr. Ann Smith and Mrs. Ann Smith, or Ann Smith herself; John Smith too. Annabel Lee Street."), (2, "Prof. 王小明 said so. Prof. 王小明 again."),
        (3, "Dr. Παπάς came."), (4, "Mr. Kim Novak and Dr. Kim Novak"), (5, "Dr. Иван Петров"), (6, "Smith alone and ann smith"),
    ]
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    a = re.match(r"Dr\. (\w+ \w+) and Mrs\. (\w+ \w+), or (\w+ \w+) herself; (\w+) (\w+) too\. Annabel Lee Street\.$", rows[1].text).groups()
    assert a[0] == a[1] == a[2] != "Ann Smith" and a[0].split()[1] == a[4] and a[3] != "John"
    assert a[0].split()[0].endswith(tuple(pii.ENDINGS["f", "Latn"].split())) and a[3].endswith(tuple(pii.ENDINGS["m", "Latn"].split()))
    x, y = re.match(r"Prof\. (\w+) said so\. Prof\. (\w+) again\.$", rows[2].text).groups()
    assert x == y != "王小明" and all("\u4e00" <= c <= "\u9fff" for c in x)
    assert re.fullmatch(r"Dr\. [\u0370-\u03ff\u1f00-\u1fff]+ came\.", rows[3].text) and "Παπάς" not in rows[3].text
    m, d = re.match(r"Mr\. (\w+ \w+) and Dr\. (\w+ \w+)$", rows[4].text).groups()
    assert m == d and re.fullmatch(r"Dr\. [А-Яа-я]+ [А-Яа-я]+", rows[5].text) and rows[6].n_entities == 0


def test_pseudonymise_keeps_columns_and_reruns_agree(spark):
    docs = documents(spark, TEXTS)
    a, b = pii.pseudonymise(docs), pii.pseudonymise(docs.repartition(5))
    assert a.columns == docs.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.where("n_chars <> length(text)").count() == 0
    assert pii.report(docs.limit(0)).count() == 0


def test_a_number_ends_before_an_address(spark):
    texts = [
        (1, "+1 (826) 555-4081 190.137.223.204"), (2, "+1 826 555 4081"), (3, "Card 4111111111111111 97.51.17.173"), (4, "+49 30 1234567 97.51.17.173"), (5, "+1.826.555.4081 90 men"),
        (6, "NO93 8601 1117 947 and NO9386011117947"), (7, "ES9121000418450200051332 190.137.223.204"), (8, "+49 30 12 34 56 78"), (9, "+49.30.12.34.56.78"),
    ]
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: r.kinds for i, r in rows.items()} == {1: "phone,ip", 2: "phone", 3: "card,ip", 4: "phone,ip", 5: "phone", 6: "iban,iban", 7: "iban,ip", 8: "phone", 9: "phone"}
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(rows[1].text.rsplit(" ", 1)[0]) == digits(rows[2].text) == digits(rows[5].text[:15]) and rows[5].text.endswith(" 90 men")
    ips = {rows[i].text.rsplit(" ", 1)[1] for i in (1, 7)}
    assert len(ips) == 1 and "190.137.223.204" not in ips and ".223.204" not in rows[1].text
    assert rows[3].text.rsplit(" ", 1)[1] == rows[4].text.rsplit(" ", 1)[1] != "97.51.17.173"
    a, b = re.match(r"(NO\d\d \d{4} \d{4} \d{3}) and (NO\d{13})$", rows[6].text).groups()
    assert a.replace(" ", "") == b != "NO9386011117947"
