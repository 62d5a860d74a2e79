import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import clean, layout, markdown, paginate, redact, search, tables


@pytest.mark.parametrize(
    "lines, want, n",
    [
        (["a-", "b-", "c"], ["ab-", "c"], 1),
        (["recon-", "", "sider"], ["reconsider"], 1),
        (["COVID-", "Nineteen"], ["COVID-", "Nineteen"], 0),
        (["x-", "", "", "y"], ["x-", "", "", "y"], 0),
        (["a state-of-the-art.", "b", "end-"], ["a state-of-the-art.", "b", "end-"], 0),
        (["- ", "b"], ["- ", "b"], 0),
        (["x-", "", "Y-", "z"], ["x-", "", "Yz"], 1),
        (["x-", "  ", "Y"], ["x-", "  ", "Y"], 0),
        (["x-", " indented"], ["x-", " indented"], 0),
        (["", "a-", "", "b-", "c-", "d", "", ""], ["", "ab-", "cd", "", ""], 2),
        (["a-"] + ["b-"] * 4 + ["c"], ["ab-", "bb-", "bc"], 3),
        ([], [], 0),
    ],
)
def test_hyphens(spark, lines, want, n):
    row = spark.createDataFrame([(lines,)], "l array<string>").select(clean.join_hyphens(F.col("l")).alias("j")).first().j
    assert (row.lines, row.joined) == (want, n)


def test_text_functions(spark):
    row = spark.createDataFrame([("\ufb01sh\u00ad\u00a0ball cafe\u0301",)], "t string").select(T.replaced_count(F.col("t")), T.normalised(F.col("t"))).first()
    assert list(row) == [3, "fish ball caf\u00e9"]
    row = spark.createDataFrame([("a\r\nb\x0bc\u2028d\n",)], "t string").select(T.lines(F.col("t")), T.shape(F.lit(" Page 12 of 345\u00a0"))).first()
    assert list(row) == [["a", "b", "c", "d"], "Page # of #"]
    row = spark.createDataFrame([([["a|b", "c\nd"], ["e"], ["f", "g", "h"]],)], "r array<array<string>>").select(T.pipe_table(F.col("r"))).first()[0]
    assert row == "| a\\|b | c d |  |\n| --- | --- | --- |\n| e |  |  |\n| f | g | h |"
    got = spark.range(1).select(T.humanised(F.lit("us:NetIncomeLossTextBlock")), T.local_name(F.lit("{http://x}Name")), T.glued_figure(F.lit("1.234.567Net")), T.glued_figure(F.lit("1.234.567,8")), T.atx_level(F.lit("### x")), T.atx_level(F.lit("#x"))).first()
    assert got[0] == "Net Income Loss" and got[1] == "Name" and tuple(got[2]) == ("1.234.567", "Net") and got[3] is None and list(got)[4:] == [3, 0]
    links = ["https://drive.google.com/file/d/ID/view?usp=x", "https://docs.google.com/document/d/ID/edit", "https://github.com/o/r/blob/m/a.pdf", "https://gitlab.com/g/p/-/blob/m/a.pdf", "https://www.dropbox.com/s/k/a.pdf?dl=0", "https://e.org/x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in links], "u string").select(T.direct_link(F.col("u"))).collect()]
    assert got == ["https://drive.google.com/uc?export=download&id=ID", "https://docs.google.com/document/d/ID/export?format=docx", "https://raw.githubusercontent.com/o/r/m/a.pdf", "https://gitlab.com/g/p/-/raw/m/a.pdf", "https://www.dropbox.com/s/k/a.pdf?dl=1", "https://e.org/x"]
    row = spark.range(1).select(T.data_uri(F.lit("data:text/plain;name=a%20b;base64,aGk=")), T.data_uri(F.lit("data:,x%20y")), T.data_uri(F.lit("http://x"))).first()
    assert (row[0].media_type, bytes(row[0].content), bytes(row[1].content), row[2]) == ("text/plain", b"hi", b"x y", None)


def test_packing(spark):
    got = spark.createDataFrame([([1000, 1500, 900, 2000, 100],)], "s array<int>").select(paginate.packed(F.col("s"))).first()[0]
    assert got == [1, 1, 2, 3, 3]
    blocks = spark.createDataFrame([("d", 1, "para", "x" * 6000), ("d", 2, "para", "tail"), ("e", 1, "para", ""), ("f", 1, "para", "l1" * 700 + "\n" + "l2" * 700 + "\n" + "l3" * 10)], "doc_id string, ord int, kind string, text string")
    rows = [tuple(r) for r in paginate.paginate(blocks).select("doc_id", "page", F.length("text")).orderBy("doc_id", "ord").collect()]
    assert rows == [("d", 1, 2800), ("d", 2, 2800), ("d", 3, 400), ("d", 3, 4), ("e", 1, 0), ("f", 1, 1400), ("f", 2, 1421)]


def test_running_heads(spark):
    lines = [(d, p, n, t) for d, k in (("six", 6), ("two", 2)) for p in range(1, k + 1) for n, t in enumerate(["ACME Report"] + [f"body {p} {i} text" for i in "abc"] + [f"Page {p}"])]
    frame = spark.createDataFrame(lines, "doc_id string, page int, line int, text string")
    pages = frame.select("doc_id", "page").distinct()
    rows = {r.doc_id: r for r in clean.clean(frame, pages).collect()}
    assert rows["six"].running_heads_removed == 12 and rows["six"].running_heads_checked and "ACME" not in rows["six"].text
    assert rows["two"].running_heads_removed == 0 and not rows["two"].running_heads_checked
    blank = pages.unionByName(spark.createDataFrame([("six", p) for p in range(7, 12)], "doc_id string, page int"))
    assert not [r for r in clean.running_heads(frame, blank).where("doc_id = 'six' AND is_head").collect()]  # 6 of 11 pages


def boxes(spark, spots):
    rows = [("d", 1, i, t, float(x), float(y), float(x + w), float(y + 10)) for i, (t, x, y, w) in enumerate(spots)]
    return spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")


def test_two_columns_and_one(spark):
    two = boxes(spark, [(f"R{i}", 330, 110 + 18 * i, 200) for i in range(24)] + [(f"L{i}", 60, 110 + 18 * i, 200) for i in range(24)])
    texts = [r.text for r in layout.lines(layout.reading_order(two)).orderBy("line").collect()]
    assert texts == [f"L{i}" for i in range(24)] + [f"R{i}" for i in range(24)]
    one = boxes(spark, [(f"w{i}", 60, 100 + 16 * i, 400) for i in range(60)])
    row = layout.columns(one).first()
    assert (row.columns, row.looks_tabular) == (1, False)


def test_blocks_without_geometry_are_lines(spark):
    frame = spark.createDataFrame([("d", 1, i, f"t{i}", None, None, None, None) for i in range(3)], "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.lines(layout.reading_order(frame)).orderBy("line").collect()] == ["t0", "t1", "t2"]


def test_cell_order_and_splice(spark):
    words = [(10.0, 30.0, 20.0, "Ada"), (10.5, 5.0, 20.5, "Name:"), (22.0, 5.0, 32.0, "Role:"), (21.5, 30.0, 31.5, "Chair")]
    frame = spark.createDataFrame([([dict(zip(("top", "x0", "bottom", "text"), w)) for w in words],)], f"w {tables.WORD}")
    assert frame.select(tables.cell_text(F.col("w"))).first()[0] == "Name: Ada Role: Chair"
    blocks = boxes(spark, [("before", 60, 50, 30), ("in1", 60, 100, 30), ("in2", 60, 112, 30), ("after", 60, 200, 30)])
    table = spark.createDataFrame([("d", 1, 1, "T", 50.0, 95.0, 200.0, 130.0)], "doc_id string, page int, table_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.kind, r.text) for r in tables.splice(blocks, table).orderBy("ord").collect()] == [("para", "before"), ("table", "T"), ("para", "after")]
    chars = boxes(spark, [("a", 60.2, 50, 5), ("b", 200, 50, 5)])
    assert [tuple(r)[2:4] for r in tables.characters_in_words(chars, blocks).collect()] == [(0, "a")]


def test_headings_by_size(spark):
    assert spark.range(1).select(markdown.upper_median(F.array(F.lit(12.0), F.lit(0.0), F.lit(10.0)))).first()[0] == 12.0
    lines = spark.createDataFrame([("d", 1, 1, "Title", 18.0), ("d", 1, 2, "Part", 12.0)] + [("d", 1, i, f"body {i}", 10.0) for i in range(3, 9)], "doc_id string, page int, line int, text string, size double")
    assert [(r.level, r.title) for r in markdown.inferred_headings(lines).orderBy("line").collect()] == [(1, "Title"), (2, "Part")]


def test_redaction_is_verified(spark):
    runs = spark.createDataFrame([("d", 1, 1, "mail a@b.c now"), ("d", 1, 2, "sec"), ("d", 1, 3, "ret"), ("d", 2, 1, "fine")], "doc_id string, page int, run int, text string")
    assert redact.verified(runs, "a@b.c").count() == 3
    with pytest.raises(redact.ResidualMatch):
        redact.verified(runs, "secret")
    assert redact.verified(runs, "absent").count() == 4


def test_find(spark):
    pages = spark.createDataFrame([("d", 1, "One ant.\nTwo ANTS (x)", "native"), ("d", 2, "", "empty"), ("d", 3, "an ant", "native")], "doc_id string, page int, text string, basis string")
    rows = search.literal_matches(pages, "ant").orderBy("page", "start").collect()
    assert [(r.page, r.line, r.start, r.end) for r in rows] == [(1, 1, 4, 7), (1, 2, 13, 16), (3, 1, 3, 6)]
    assert tuple(search.totals(pages, "ant").first()) == ("d", 3, 2, 1, "1,3")
    named = search.pattern_matches(pages, r"(?P<n>one|two) (?P<what>\w+)").orderBy("start").collect()
    assert [r.groups for r in named] == [{"n": "One", "what": "ant"}, {"n": "Two", "what": "ANTS"}]
    assert rows[0].snippet == "One ant. Two ANTS (x)"
    search.register(spark)
    pages.createOrReplaceTempView("some_pages")
    got = spark.sql(r"SELECT page, m.groups['w'] AS w FROM some_pages, LATERAL find_matches(text, '(?P<w>ant)S') AS m").collect()
    assert [tuple(r) for r in got] == [(1, "ANT")]
    with pytest.raises(search.PatternError):
        search.compiled("(")
    with pytest.raises(search.PatternTimeout), search.deadline(0.3):
        list(search.match_rows("a" * 40 + "!", search.compiled(r"(\w*\w+)+$")))
    passages = spark.createDataFrame([(1, "ant. Two"), (2, "One"), (3, "One ant.\nTwo ANTS")], "item_id int, text string")
    texts = pages.withColumn("text", F.col("text"))
    assert {tuple(r)[:1] + (r.page,) for r in search.passages(texts, passages).collect()} == {(3, 1)}


def test_passages_of_any_length_match_brute_force(spark):
    texts = {1: "One ant.\nTwo ANTS (x)", 2: "", 3: "an ant, a phone: antsy", 4: "ONE"}
    items = {1: "ant. Two", 2: "One", 3: "One ant.\nTwo ANTS", 4: "ne an", 5: "a", 6: "antsy", 7: "phone: ants", 8: "none here", 9: "ant.\nTwo"}
    pages = spark.createDataFrame([("d", p, t, "native") for p, t in texts.items()], "doc_id string, page int, text string, basis string")
    wanted = spark.createDataFrame(list(items.items()), "item_id int, text string")
    got = [(r.item_id, r.page) for r in search.passages(pages, wanted).unionByName(search.short_passages(pages, wanted)).collect()]
    assert sorted(got) == sorted((i, p) for i, s in items.items() for p, t in texts.items() if s in t)
