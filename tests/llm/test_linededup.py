import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import linededup
from tests.llm.cases import documents

LICENSE = "Licensed under the Public License, Version 2.0."
TEXTS = [
    (30, f"First line of some words.\n{LICENSE}\nthe end of it all now"),
    (31, f"{LICENSE}\n\nAnother thing that is said here. A long passage that two texts hold. And a third sentence to be long enough."),
    (32, f"licensed  UNDER the public license, version 2.0.\nBefore it comes this one sentence here. A long passage that two texts hold. After it this is said as well."),
    (33, "Hm.\nHm.\nHm."),
    (34, f"twice in one text it is\ntwice in one text it is\n{LICENSE}"),
]


def pieces(text, long_words=12):
    made = []
    for line in re.split(r"(?<=\n)", text):
        made += re.split(r"(?<=[.!?] )", line) if len(line.split(" ")) > long_words else [line]
    return made


def norm(unit):
    return re.sub(r"[\x00-\x20]+", " ", unit.lower()).strip(" ")


def brute(rows, version, least_run):
    """(doc_id, text, n_removed, spans) of rows (doc_id, text)."""
    first = {}
    for _, d, v, t in sorted({(d is not None, d or 0, version[d, t], t) for d, t in rows}):
        for at, u in enumerate(u for u in pieces(t) if norm(u)):
            first.setdefault(norm(u), (d, v, at))
    want = set()
    for d, t in rows:
        at, seq, run, runs = 0, 0, [], []
        for u in pieces(t):
            if norm(u):
                if first[norm(u)] != (d or 0, version[d, t], seq):
                    run.append((at, at + len(u), norm(u).count(" ") + 1))
                else:
                    runs, run = [*runs, run], []
                seq += 1
            at += len(u)
        gone = [(a, b) for r in [*runs, run] if sum(n for *_, n in r) >= least_run for a, b, _ in r]
        kept, spans = "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in gone)), []
        for a, b in gone:
            if spans and spans[-1][1] == a:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        want.add((d, kept, len(gone), tuple(f"{a}:{b}" for a, b in spans)))
    return want


@pytest.mark.parametrize("least_run", [1, 9, linededup.LEAST_RUN])
def test_matches_brute_force(spark, least_run):
    passage = "A passage of verse\n\nthat is told in lines\nof few words\neach, again and again,\nuntil there are enough of them\n"
    docs = documents(spark, [*TEXTS, (50, passage + "own end"), (51, "own begin\n" + passage), (52, "of few words\nand no more")])
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    version = {(r.doc_id, r.text or ""): r.v for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS v").collect()}
    want = brute([r for r in rows if len(r[1]) < 20000], version, least_run)
    got = {(r.doc_id, r.text, r.n_removed, tuple(r.spans)) for r in linededup.deduplicated(docs, keep=("doc_id",), least_run=least_run).collect()}
    assert {g for g in got if len(g[1]) < 20000} == want
    assert sum(n for *_, n, _ in want) >= (8 if least_run < 9 else 5)


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units_join_to_the_text(spark, unit):
    docs = documents(spark, TEXTS + [(40, "a\n\nb c\n \nd\n\n\ne\n")])
    rows = docs.select("text", linededup.units(linededup._text(), unit).alias("u")).collect()
    assert all("".join(r.u) == (r.text or "") for r in rows)


def test_paragraphs_part_at_any_blanks(spark):
    text = "one\n" + " " * 40 + "\n\n\ntwo\nstill two\n\t\nthree"
    got = spark.createDataFrame([(text,)], "text string").select(linededup.units(F.col("text"), "paragraph").alias("u")).first().u
    assert [u.strip() for u in got] == ["one", "two\nstill two", "three"] and "".join(got) == text


def test_shapes_and_clashing_columns(spark):
    docs = documents(spark, TEXTS).selectExpr("*", "7 AS n_units", "8 AS SPANS", "9 AS removed", "10 AS version")
    made = linededup.deduplicated(docs)
    assert linededup.report(docs).count() == docs.count() and linededup.report(docs.limit(0)).count() == 0
    assert set(docs.columns) <= set(made.columns) and {"n_units_", "n_removed", "spans_"} <= set(made.columns)
    assert {(r.n_units, r.SPANS, r.removed, r.version) for r in made.collect()} == {(7, 8, 9, 10)}


def test_a_long_line_of_short_sentences_goes_whole(spark):
    line = " ".join(f"W{i}!! GO{i}!!" for i in range(60)) + "\n"
    docs = spark.createDataFrame([(1, "begin with this one\n" + line), (2, line + "end of the second"), (3, "x " + line)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.spans) for r in linededup.deduplicated(docs).collect()}
    assert got[1][1] == 0 and got[2] == ("end of the second", 120, [f"0:{len(line)}"])
    assert got[3][0] == "x W0!! " and got[3][1] == 119


def test_scripts_without_blanks_have_words(spark):
    verse = "全部の権利は留保されています。" * 3 + "\n"
    docs = spark.createDataFrame([(1, verse), (2, "other\n" + verse)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()} == {1: verse, 2: "other\n"}
