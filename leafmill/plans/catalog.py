"""The engine's registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import budget as B
from leafmill import ir
from leafmill import selection as S
from leafmill.functions import text as T
from leafmill.operators import assemble, clean, facts, layout, markdown, paginate, probe, redact, search, tables
from leafmill.plans import sql as Q
from leafmill.plans import views as V
from leafmill.sources import base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- find ---


@query(Q.T03_FIND_LITERAL)
def t03_find_literal(spark: SparkSession, d: str) -> DataFrame:
    """Corpus search: hits and pages of a literal per document."""
    return search.totals(V.doc_pages(spark, d), "tion")


@query(Q.A16_HITS_BY_DOC)
def a16_hits_by_doc(spark, d):
    """Hits of every text, with the first place."""
    read = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = read.where(F.col("text").rlike("(?iu)ent")).select("doc_id", T.hits(F.col("text"), "ent").alias("hits"), (F.locate("ent", F.lower("text")) - 1).cast("long").alias("first_at"))
    return hits


@query(Q.F07_SNIPPETS)
def f07_snippets(spark, d):
    """The first three matches of each document in order, of their exact total."""
    found = search.literal_matches(V.doc_pages(spark, d), "license")
    return search.first_matches(found, 3).select("doc_id", "page", "line", "start", "end", "snippet", F.col("total").cast("long").alias("total"), "truncated")


@query(Q.T03_FIND_REGEX_GROUPS)
def t03_find_regex_groups(spark, d):
    """A user's pattern with named groups as rows, per event type."""
    pages = V.table(spark, d, "events").select(F.col("event_type").alias("doc_id"), F.col("event_id").cast("int").alias("page"), F.col("props").alias("text"), F.lit("native").alias("basis"))
    found = search.pattern_matches(pages, r'"(?P<key>[a-z]+)": (?P<number>[0-9]+)')
    return found.groupBy("doc_id", F.col("groups")["key"].alias("key")).agg(F.count("*").alias("matches"), F.sum(F.col("groups")["number"].cast("long")).alias("total"), F.max("end").alias("last_end"))


@query(Q.X01_FIND_PASSAGES)
def x01_find_benchmark_passages(spark, d):
    """Which texts hold which benchmark passage whole."""
    pages = V.table(spark, d, "documents").select(F.col("doc_id"), F.lit(1).alias("page"), "text", F.lit("native").alias("basis"))
    items = V.table(spark, d, "benchmark")
    return search.passages(pages, items).unionByName(search.short_passages(pages, items)).select("item_id", "doc_id")


# --- selections and assembly ---


@query(Q.P01_PAGE_SELECTION)
def p01_page_selection(spark, d):
    """A selection as a set, on conversations."""
    return V.conv_pages(spark, d).where(F.col("page").isin(S.pages("1-2,4,2", 6))).select("doc_id", "page", F.length("text").cast("long").alias("characters"))


@query(Q.P02_ORDERED_SELECTION)
def p02_ordered_selection(spark, d):
    """Selections in a column, each in its order, with repeats."""
    counts = V.conv_pages(spark, d).groupBy("doc_id").agg(F.max("page").alias("n"))
    chosen = counts.select("doc_id", F.posexplode(S.selected(F.lit("3,1,1-2,3-"), F.col("n"))).alias("position", "page"))
    return chosen.select("doc_id", (F.col("position") + 1).alias("position"), "page")


@query(Q.A09_PAGE_RANGES)
def a09_page_ranges(spark, d):
    """Pages with a user's turn, as ranges."""
    some = V.table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"))
    return S.page_ranges(some, ["doc_id"])


@query(Q.U02_ASSEMBLE)
def u02_assemble(spark, d):
    """Pages of two conversations in a given order, one of them turned."""
    plan = assemble.parse("s2:2,1r90,s1:all", ["0", "1"], [2, 2])
    return assemble.assemble(V.conv_pages(spark, d), [(str(i), p, r) for i, p, r in plan]).select("position", "doc_id", "page", "rotation", F.length("text").cast("long").alias("characters"))


@query(Q.U03_REMOVE_PAGES)
def u03_remove_pages(spark, d):
    """Conversations without their second and third page."""
    return assemble.without(V.conv_pages(spark, d), "2-3", 8).select("doc_id", "page", "basis")


@query(Q.J12_UPSERT)
def j12_upsert_pages(spark, d):
    """Recognised text in place of short pages."""
    pages = V.doc_pages(spark, d)
    better = pages.where(F.length("text") < 400).select("doc_id", "page", F.concat(F.lit("ocr of "), F.length("text").cast("string")).alias("text"))
    return assemble.upsert(pages, better).select("doc_id", "page", F.length("text").cast("long").alias("characters"))


# --- budgets ---


@query(Q.A03_TOKEN_BUDGET)
def a03_token_budget(spark, d):
    """Characters and estimated tokens per document."""
    sums = V.doc_pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("characters"))
    return sums.select("doc_id", "pages", "characters", B.tokens(F.col("characters")).alias("tokens"))


@query(Q.M05_PAGES_THAT_FIT)
def m05_pages_that_fit(spark, d):
    """Pages of average length within one response, both budgets."""
    sums = V.doc_pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("chars"))
    fit = [B.pages_that_fit(F.col("chars"), F.col("pages"), b).alias(n) for n, b in (("fit", B.Budget()), ("fit_constrained", B.Budget.constrained()))]
    return sums.select("doc_id", *fit)


@query(Q.M02_RENDER)
def m02_render_budget(spark, d):
    """Bytes of a rendered page and the resolution that fits, for page sizes taken from parts."""
    size = V.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20 + 100).cast("double").alias("w"), (F.col("p_size") * 30 + 100).cast("double").alias("h"), (F.col("p_size") % 9 + 1).alias("pages"))
    made = size.withColumn("bytes", B.render_bytes(F.col("w"), F.col("h"), F.lit(150.0)))
    return made.select("p_partkey", "bytes", B.dpi_that_fits(F.col("w") / 72 * F.col("h") / 72, F.col("pages")).cast("long").alias("dpi"), B.pages_that_fit_render(F.col("bytes")).alias("fit"))


@query(Q.L05_EVEN_SAMPLE)
def l05_even_sample(spark, d):
    """At most 20 pages of each document, spread evenly."""
    counts = V.doc_pages(spark, d).groupBy("doc_id").agg(F.max("page").alias("n"))
    return counts.select("doc_id", F.explode(S.even_sample(F.col("n"), 20)).alias("page"))


@query(Q.L06_STRIDE)
def l06_stride_estimate(spark, d):
    """Tokens estimated from at most eight strided pages."""
    return probe.sampled_tokens(V.doc_pages(spark, d))


@query(Q.B01_ADMISSION)
def b01_admission(spark, d):
    """Whether a whole extract is admitted, and the prefix that fits."""
    return probe.admission(V.doc_pages(spark, d))


# --- pages and probing ---


@query(Q.W06_PAGINATE)
def w06_paginate_text(spark, d):
    """Synthetic pages: lines packed to 2,800 characters."""
    sizes = V.table(spark, d, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(x)).alias("s"))
    paged = sizes.select("doc_id", F.explode(F.arrays_zip("s", paginate.packed(F.col("s")).alias("p"))).alias("x"))
    return paged.groupBy("doc_id", F.col("x.p").alias("page")).agg(F.count("*").alias("lines"), F.sum("x.s").cast("long").alias("characters"))


@query()
def w07_paginate_blocks(spark, d):
    """Texts as blocks, split and packed into pages."""
    return paginate.page_texts(paginate.paginate(V.text_blocks(spark, d))).select("doc_id", "page", F.length("text").cast("long").alias("characters"))


@query(Q.A02_PROBE_KINDS)
def a02_probe_kinds(spark, d):
    """Pages by kind: texts of under 32 characters count as scanned if their id is even."""
    pages = V.doc_pages(spark, d).withColumn("has_content", F.col("page") % 2 == 0)
    kind = ir.page_kind(F.col("basis"), F.col("has_content"))
    return pages.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("pages"))


@query(Q.A04_MODE)
def a04_page_size_mode(spark, d):
    """Most common page size, and the pages of another; sizes are taken from quantities."""
    read = V.table(spark, d, "lineitem").where("l_linenumber <= 7")
    sized = read.select(F.col("l_suppkey").cast("string").alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("page"), (F.col("l_quantity") % 5 + 595).alias("width"), (F.col("l_quantity") % 3 + 842).alias("height"))
    made = probe.page_size_mode(sized)
    return made.select("doc_id", "width", "height", "n_pages", "other_pages")


@query(Q.T01_PROBE)
def t01_probe(spark, d):
    """What every document is."""
    pages = V.doc_pages(spark, d).withColumn("has_content", F.col("page") % 2 == 0)
    return probe.probe(pages)


# --- cleaning ---


@query(Q.A01_RUNNING_HEADS)
def a01_running_heads(spark, d):
    """Shapes of edge lines with their share of pages."""
    return clean.running_heads(V.doc_lines(spark, d), V.doc_pages(spark, d))


@query(Q.W04_STRIP_HEADS)
def w04_strip_heads(spark, d):
    """Lines left where every page got the same head and a numbered foot."""
    lines, pages = V.doc_lines(spark, d), V.doc_pages(spark, d)
    head = pages.select("doc_id", "page", F.lit(-1).alias("line"), F.concat(F.lit("Report of "), "doc_id").alias("text"))
    foot = pages.select("doc_id", "page", F.lit(1_000_000).alias("line"), F.concat(F.lit(" page "), F.col("page").cast("string")).alias("text"))
    kept = clean.strip_heads(lines.unionByName(head).unionByName(foot), pages)
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.sum(F.length("text")).cast("long").alias("characters"))


@query(Q.W03_HYPHEN_JOIN)
def w03_hyphen_join(spark, d):
    """Words that line ends broke; the data has none, so hyphens are put in."""
    broken = F.regexp_replace(F.coalesce("text", F.lit("")), r"([a-z]{4})(tion[ .,])", "$1-\n$2")
    joined = V.table(spark, d, "documents").select("doc_id", clean.join_hyphens(F.split(broken, "\n", -1)).alias("j"))
    return joined.select("doc_id", F.size("j.lines").cast("long").alias("lines"), F.col("j.joined").cast("long").alias("joined"))


@query(Q.W05_COLLAPSE)
def w05_collapse(spark, d):
    """Blanks squeezed and blank lines joined; both are put in first."""
    spread = F.split(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".  \t")), F.lit("\n"), F.lit("\n\n \n")), "\n", -1)
    made = V.table(spark, d, "documents").select("doc_id", F.array_join(clean.collapse_blanks(spread), "\n").alias("t"))
    return made.select("doc_id", F.length("t").cast("long").alias("characters"), F.md5("t").alias("digest"))


@query(Q.F01_NORMALISE)
def f01_normalise(spark, d):
    """Characters replaced and composed; ligatures and decomposed accents are put in first."""
    odd = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("fi"), F.lit("\ufb01")), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("th "), F.lit("th\u00a0"))
    made = V.table(spark, d, "documents").select("doc_id", odd.alias("odd"))
    return made.select("doc_id", T.replaced_count(F.col("odd")).alias("replaced"), F.md5(T.normalised(F.col("odd"))).alias("digest"))


@query(Q.F02_SHAPE)
def f02_line_shapes(spark, d):
    """How often each line shape with a digit occurs."""
    return V.doc_lines(spark, d).where(F.col("text").rlike("[0-9]")).groupBy(T.shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))


@query(Q.T04_EXTRACT)
def t04_extract(spark, d):
    """Cleaned text of every document with what was changed."""
    return clean.clean(V.doc_lines(spark, d), V.doc_pages(spark, d))


# --- layout and tables ---


@query(Q.W09_ROWS)
def w09_rows(spark, d):
    """Baseline rows of word boxes."""
    return layout.baseline_rows(V.boxes(spark)).groupBy("doc_id", "page", "row").agg(F.count("*").alias("words"), F.min("y0").alias("y0"))


@query(Q.W10_SEGMENTS)
def w10_segments(spark, d):
    """Rows broken at wide gaps."""
    return layout.row_segments(layout.baseline_rows(V.boxes(spark))).select("doc_id", "page", "row", "segment", "x0", "x1")


@query(Q.G01_GUTTERS)
def g01_gutters(spark, d):
    """The gap between two columns."""
    return layout.gutters(V.boxes(spark))


@query(Q.L02_READING_ORDER)
def l02_reading_order(spark, d):
    """Words column by column."""
    return layout.reading_order(V.boxes(spark)).select("doc_id", "page", "position", "column", "text")


@query(Q.G05_LINES)
def g05_lines(spark, d):
    """Lines of text in reading order."""
    return layout.lines(layout.reading_order(V.boxes(spark))).select("doc_id", "page", "line", "text")


@query(Q.J04_WORD_IN_CELL)
def j04_word_in_cell(spark, d):
    """Words by the ruled cell that holds their centre."""
    return tables.words_in_cells(V.boxes(spark), V.cells(spark)).select("row", "col", "text")


@query(Q.W12_CELL_ORDER)
def w12_cell_order(spark, d):
    """Cells with their words in reading order."""
    rows = tables.filled(V.boxes(spark), V.cells(spark)).select(F.posexplode("rows").alias("row", "cells"))
    return rows.select("row", F.array_join("cells", " | ").alias("cells"))


@query(Q.T05_MIN_CONFIDENCE)
def t05_min_confidence(spark, d):
    """Tables found with enough confidence."""
    return tables.confident(V.found_tables(spark, d), 0.9).select("doc_id", "table_no", "basis", "confidence")


@query(Q.A07_BY_BASIS)
def a07_by_basis(spark, d):
    """Tables by how they were found."""
    return tables.by_basis(V.found_tables(spark, d))


@query(Q.A06_WEAKEST)
def a06_weakest_basis(spark, d):
    """The weakest basis of a document, and the agreed one."""
    return V.found_tables(spark, d).groupBy("doc_id").agg(ir.weakest(F.col("basis"), "native").alias("weakest"), ir.agreed(F.col("basis")).alias("agreed"))


@query(Q.F10_PIPE_TABLE)
def f10_pipe_table(spark, d):
    """Ragged rows drawn as Markdown tables."""
    rows = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.array_compact(F.array("role", F.when(F.col("turn") % 2 == 0, F.coalesce("text", F.lit(""))))).alias("r"))))["r"].alias("rows"))
    return rows.select("conv_id", T.pipe_table(F.col("rows")).alias("md"))


@query(Q.A08_UPPER_MEDIAN)
def a08_upper_median(spark, d):
    """The value at n // 2 of sorted sizes."""
    return V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(markdown.upper_median(F.collect_list("l_quantity")).alias("median"))


# --- facts ---


def _contexts(spark, d):
    day = F.date_format(F.lit("2020-01-01").cast("date") + F.col("p_size"), "yyyy-MM-dd")
    when = facts.period(F.when(F.col("p_size") % 2 == 0, day), F.when(F.col("p_size") % 2 == 1, F.lit("2020-01-01")), F.when(F.col("p_size") % 2 == 1, day))
    parts = V.table(spark, d, "part").where("p_size > 10")
    return parts.select(F.col("p_partkey").cast("string").alias("id"), when.alias("period"))


def _facts(spark, d):
    found = V.facts(spark, d)
    # One corpus-wide set of contexts and units: the document is no part of the key here.
    contexts = _contexts(spark, d).withColumnRenamed("id", "context_ref")
    units = V.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("unit_ref"), F.col("s_name").alias("measure"))
    whole = F.lit("all").alias("doc_id")
    star = found.select("fact", "context_ref", "unit_ref", "value", whole)
    star = facts.with_context(star, contexts.select(whole, F.col("context_ref").alias("id"), "period"))
    return facts.with_unit(star, units.select(whole, F.col("unit_ref").alias("id"), "measure"))


@query(Q.J01_FACTS)
def j01_fact_context(spark, d):
    """Facts by context: a reference without a context stays."""
    return _facts(spark, d).groupBy("context").agg(F.count("*").alias("facts"))


@query(Q.J02_FACTS)
def j02_fact_unit(spark, d):
    """Facts by unit, without one: an empty unit."""
    return _facts(spark, d).groupBy("unit").agg(F.count("*").alias("facts"), F.sum(F.col("value").try_cast("decimal(20,0)")).cast("long").alias("total"))


@query(Q.A14_FACTS)
def a14_fact_counts(spark, d):
    """Numeric facts are those with a unit."""
    found = _facts(spark, d).select(F.substring_index("fact", "-", 1).alias("doc_id"), "unit")
    return facts.counts(found)


# --- redaction ---

MAIL = r"[a-z0-9.]+@[a-z0-9.]+"


def _runs(spark, d):
    return V.doc_lines(spark, d).withColumnRenamed("line", "run")


@query(Q.T13_REDACT)
def t13_redact(spark, d):
    """Lines that hold an address go whole."""
    return redact.summary(_runs(spark, d), MAIL, regex=True)


@query(Q.T13_RESIDUAL)
def t13_residual(spark, d):
    """What still matches after redaction: nothing, on any page."""
    left = redact.residual(redact.redact(_runs(spark, d), MAIL, regex=True), MAIL, regex=True, glue="\n")
    return left.agg(F.count("*").alias("pages"), F.coalesce(F.sum("residual_matches"), F.lit(0)).cast("long").alias("residual_matches"))


# --- readers ---


def _web(spark, d):
    return base.read_column(V.table(spark, d, "pages").withColumn("name", F.concat(F.col("page_id").cast("string"), F.lit(".html"))), "name", "html")


def _as(spark, d, extension, text):
    read = V.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(extension)).alias("name"), text.alias("content"))
    return base.read_column(read, "name", "content")


@query(Q.S06_HTML_META)
def s06_html_meta(spark, d):
    """Title, language and links of raw pages."""
    meta = _web(spark, d).groupBy("doc_id").agg(F.first("meta").alias("m"))
    return meta.select(F.split("doc_id", "[.]")[0].cast("long").alias("page_id"), F.col("m")["title"].alias("title"), F.col("m")["lang"].alias("lang"), F.col("m")["links"].cast("long").alias("links"))


@query()
def s06_html_blocks(spark, d):
    """Blocks of raw pages by kind."""
    return _web(spark, d).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("long").alias("characters"))


@query(Q.T02_OUTLINE_HTML)
def t02_outline_html(spark, d):
    """Headings that raw pages declare."""
    return markdown.outline(_web(spark, d)).select(F.split("doc_id", "[.]")[0].cast("long").alias("page_id"), "level", "title", "basis")


@query()
def t07_to_markdown(spark, d):
    """Raw pages as Markdown."""
    return markdown.to_markdown(_web(spark, d)).select("doc_id", "characters", "headings", "tables", F.md5("markdown").alias("digest"))


@query(Q.S07_PARAGRAPHS)
def s07_paragraphs(spark, d):
    """Paragraphs between blank lines; some line ends are doubled first."""
    spread = F.replace(F.coalesce("text", F.lit("")), F.lit("the\n"), F.lit("the\n\n"))
    spread = F.replace(spread, F.lit(".\n"), F.lit(".\n \n"))
    return _as(spark, d, ".txt", spread).where("text <> ''").groupBy("doc_id").agg(F.sum(F.length(F.translate("text", "\n", ""))).cast("long").alias("characters"))


@query()
def s08_markdown_blocks(spark, d):
    """Texts read as Markdown, their first line a heading."""
    return _as(spark, d, ".md", F.concat(F.lit("# "), F.coalesce("text", F.lit("")))).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.max("level").alias("level"))


@query(Q.S09_CSV)
def s09_csv_rows(spark, d):
    """Customers written and read as CSV, by market segment."""
    line = F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit(', Ltd"')), "c_mktsegment")
    files = V.table(spark, d, "customer").groupBy("c_nationkey").agg(F.concat_ws("\n", F.lit("key,name,segment"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("content"))
    rows = base.read_column(files.withColumn("name", F.concat(F.col("c_nationkey").cast("string"), F.lit(".csv"))), "name", "content")
    cells = rows.select(F.explode("rows").alias("r")).where(F.col("r")[0] != "key")
    return cells.groupBy(F.col("r")[2].alias("segment")).agg(F.count("*").alias("rows"), F.sum(F.col("r")[0].cast("long")).alias("keys"), F.min(F.col("r")[1]).alias("first_name"))


# --- scalar functions ---


@query(Q.F12_ESCAPE)
def f12_html_escape(spark, d):
    """Raw pages as escaped text."""
    return V.table(spark, d, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("digest"))


@query(Q.F17_SAFE_NAME)
def f17_safe_name(spark, d):
    """File names made of URLs."""
    return V.table(spark, d, "pages").select("page_id", T.safe_name(F.concat(F.regexp_replace("url", "/", " "), F.lit(" é.html"))).alias("name"))


@query(Q.F04_COLLAPSE)
def f04_collapse(spark, d):
    """Texts on one line."""
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.collapse(F.coalesce("text", F.lit("")))).alias("digest"))


@query(Q.S19_LINKS)
def s19_share_links(spark, d):
    """Share links turned into direct ones."""
    key = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://github.com/o/r/blob/main/"), key)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.dropbox.com/s/"), key, F.lit("/f.pdf?rlkey=k"), key, F.lit("&dl=0"))).otherwise(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", T.direct_link(url).alias("direct"))


@query(Q.S20_DATA_URI)
def s20_data_uri(spark, d):
    """Inline files taken apart."""
    uri = F.concat(F.lit("data:text/html;name=p.html;base64,"), F.base64(F.col("html").cast("binary")))
    made = V.table(spark, d, "pages").select("page_id", T.data_uri(uri).alias("u"))
    return made.select("page_id", "u.media_type", "u.name", F.sha2("u.content", 256).alias("sha256"))


def queries() -> dict:
    """Query name to a function of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(ORACLES)
