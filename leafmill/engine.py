"""One entry for every action: arguments are checked, budgets kept, answers wrapped."""

from __future__ import annotations

import difflib
import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import ir
from leafmill import selection as S
from leafmill.budget import Budget, json_safe, ocr_admitted, size_ratio
from leafmill.functions import text as T
from leafmill.operators import assemble as A
from leafmill.operators import clean, markdown, probe, redact, search, tables
from leafmill.sinks.paths import output_path
from leafmill.sinks.pdf import text_pdf
from leafmill.sources import base
from leafmill.sources.archive import member


class Refused(RuntimeError):
    """A request that would exceed a limit; hint is a request that would not."""

    def __init__(self, error: str, hint: str, limit: int | float, seen: int | float):
        super().__init__(error)
        self.hint, self.limit, self.seen = hint, limit, seen


def counted(returned: int, total: int) -> dict:
    """The one place where counts are made."""
    if returned > total:
        raise ValueError(f"{returned} returned of {total}")
    return {"returned": returned, "total": total, "truncated": returned < total}


def envelope(op: str, result: dict | None = None, basis: str = "", error: Exception | None = None) -> dict:
    """An answer: JSON-safe, with its own size in tokens; every failure has a hint."""
    made: dict = {"success": error is None, "op": op, "result": json_safe(result or {})}
    if basis:
        made["basis"] = basis
        made["confidence"] = ir.CONFIDENCE.get(basis, 0.0)
    if error is not None:
        made["error"] = str(error)
        made["hint"] = getattr(error, "hint", "") or "check the arguments"
        if isinstance(error, Refused):
            made |= {"refused": True, "limit": error.limit, "seen": error.seen}
    made["token_estimate"] = len(json.dumps(made, default=str)) // 4
    return made


@dataclass
class Engine:
    """Actions over a corpus of blocks (sources.base.BLOCK_ROWS). Frames come from the *_frame
    methods, for corpora; run() answers about one document, as a tool call would.

    What Spark can't do itself is plugged in; without a plug its action refuses and says so:
    recogniser(source, pages) gives {page: text}; renderer(source, pages, dpi, out) and
    converter(source, to, out) write files; rewriter(source, action, out) gives the bytes before and
    after; cipher(source, action, password, out) writes a file.
    """

    spark: SparkSession
    blocks: DataFrame
    budget: Budget = field(default_factory=Budget)
    one: Callable[[str], DataFrame] | None = None  # the blocks of one document, read alone
    out_root: str = ""
    recogniser: Callable | None = None
    renderer: Callable | None = None
    converter: Callable | None = None
    rewriter: Callable | None = None
    cipher: Callable | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, glob: str = "*", budget: Budget | None = None, **plugs) -> Engine:
        """An engine over files."""
        budget = budget or Budget()
        return cls(spark, base.read_files(spark, path, glob, budget), budget, lambda source: base.read_files(spark, path, glob, budget, source), **plugs)

    # Corpus-wide relations

    def pages_frame(self) -> DataFrame:
        return base.pages(self.blocks)

    def probe_frame(self) -> DataFrame:
        return probe.probe(self.pages_frame(), self.budget)

    def find_frame(self, query: str, regex: bool = False) -> DataFrame:
        return search.find(self.pages_frame(), query, regex)

    def extract_frame(self) -> DataFrame:
        return clean.clean(base.block_lines(self.blocks), self.pages_frame())

    def outline_frame(self) -> DataFrame:
        return markdown.outline(self.blocks.where("error IS NULL"), base.block_lines(self.blocks))

    def tables_frame(self, blocks: DataFrame | None = None) -> DataFrame:
        found = (self.blocks if blocks is None else blocks).where("error IS NULL AND rows IS NOT NULL")
        number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))
        return found.select("doc_id", "page", number.alias("table_no"), "rows", F.size("rows").alias("row_count"), T.width(F.col("rows")).alias("column_count"), "basis", ir.confidence(F.col("basis")).alias("confidence"))

    def markdown_frame(self) -> DataFrame:
        return markdown.to_markdown(markdown.prepared(self.blocks.where("error IS NULL")))

    # One document

    def _mine(self, source: str) -> DataFrame:
        """Its blocks; no other file is parsed for them."""
        return (self.one(source) if self.one else self.blocks).where(F.col("doc_id") == source)

    def _tables(self, source: str) -> DataFrame:
        return self.tables_frame(self._mine(source))

    def _details(self, source: str) -> dict:
        """What its reader says of it: format, pagination, meta; layout: a dict for each page, if known."""
        row = self._mine(source).select("format", "pagination", "meta").first().asDict()
        return row | {"layout": json.loads((row["meta"] or {}).get("layout", "[]"))}

    def _pages(self, source: str) -> DataFrame:
        mine = self._mine(source)
        said = mine.where("error IS NOT NULL").select("error", "hint").first()
        if said:
            raise base.ReadError(said["error"], said["hint"])
        found = base.pages(mine)
        if found.isEmpty():
            raise base.ReadError(f"no document {source!r}", self._nearest(source))
        return found

    def _nearest(self, source: str) -> str:
        """Names like it: of all names those with the fewest edits are compared on the driver, and few."""
        stem = source.rsplit("/", 1)[-1]
        name = F.element_at(F.split("doc_id", "/"), -1)
        like = self.blocks.select(name.alias("name")).distinct().orderBy(F.levenshtein(F.lower("name"), F.lit(stem.lower())), "name").limit(self.budget.most_matches)
        best = difflib.get_close_matches(stem, [r["name"] for r in like.collect()], 5, 0.6)
        return "did you mean " + ", ".join(best) if best else "list the documents first"

    def _selected(self, source: str, pages: str) -> tuple[DataFrame, list[int], int]:
        found = self._pages(source)
        n = found.agg(F.max("page")).first()[0]
        chosen = S.pages(pages, n)
        return found.where(F.col("page").isin(chosen)), chosen, n

    def _admit(self, found: DataFrame) -> None:
        row = probe.admission(found, self.budget).first()
        if row and not row["admitted"]:
            raise Refused(f"about {row['estimate']} tokens", f"ask for pages {row['suggested_pages']}", self.budget.response_tokens, row["estimate"])

    def probe(self, source: str) -> dict:
        row = probe.probe(self._pages(source), self.budget).first().asDict()
        said = self._details(source)
        made = {"basis": row.pop("basis"), "format": said["format"], "pagination": said["pagination"], "format_details": said["meta"], **row}
        if said["layout"]:
            sizes = self.spark.createDataFrame([(source, n, float(p["width"]), float(p["height"])) for n, p in enumerate(said["layout"], 1)], "doc_id string, page int, width double, height double")
            mode = probe.page_size_mode(sizes).first()
            made |= {"page_size": [mode["width"], mode["height"]], "other_sized_pages": mode["other_pages"]}
        sampled = [r["page"] for r in self.spark.range(1).select(F.explode(S.even_sample(F.lit(int(row["pages"])), self.budget.table_pages)).alias("page")).collect()]
        drawn = self._tables(source).where((F.col("basis") == "ruled") & F.col("page").isin(sampled)).select("page").distinct().collect()
        return made | {"ruled_pages": S.collapse([r["page"] for r in drawn]), "ruled_pages_sampled": len(sampled)}

    def outline(self, source: str) -> dict:
        self._pages(source)
        mine = self._mine(source)
        rows = markdown.outline(mine, base.block_lines(mine)).orderBy("page").limit(self.budget.most_matches).collect()
        kinds = {r["basis"] for r in rows}
        return {"basis": kinds.pop() if len(kinds) == 1 else "tagged", "entries": [{"level": r["level"], "title": r["title"], "page": r["page"]} for r in rows], "count": len(rows)}

    def find(self, source: str, query: str, regex: bool = False, pages: str = "", max_hits: int = 50) -> dict:
        found, chosen, _ = self._selected(source, pages)
        matches = search.find(found, query, regex)
        total = matches.count()
        most = min(max_hits, self.budget.most_matches)
        rows = matches.orderBy("page", "start").limit(most).collect()
        where = S.page_ranges(matches, ["doc_id"]).first()
        skipped = found.where(ir.is_scanned(F.col("basis"))).count()
        listed = [{k: v for k, v in r.asDict().items() if k != "doc_id" and v is not None} for r in rows]
        return {"basis": self._weakest(found), "hits": total, "pages": where["pages"] if where else "", "pages_searched": len(chosen) - skipped, "pages_skipped_no_text": skipped, "matches": listed, **counted(len(rows), total)}

    def _weakest(self, found: DataFrame) -> str:
        return found.agg(ir.weakest(F.col("basis"), "empty")).first()[0]

    def extract(self, source: str, pages: str = "", clean_text: bool = True) -> dict:
        found, chosen, _ = self._selected(source, pages)
        self._admit(found)
        mine = base.block_lines(self._mine(source)).where(F.col("page").isin(chosen))
        layout = self._details(source)["layout"]
        columns = sorted({layout[p - 1]["columns"] for p in chosen}) if layout else [1]
        if clean_text:
            row = clean.clean(mine, found).first().asDict()
            text = row.pop("text")
            row.pop("doc_id")
        else:
            text, row = "\n".join(r["text"] for r in found.orderBy("page").collect()), None
        made = {"basis": self._weakest(found), "text": text, "pages": S.collapse(chosen), "characters": len(text), "columns": columns, "pages_without_text": found.where(ir.is_scanned(F.col("basis"))).count()}
        return made | ({"cleaned": row} if row else {})

    def extract_tables(self, source: str, pages: str = "", min_confidence: float = 0.0) -> dict:
        _, chosen, _ = self._selected(source, pages)
        some, admitted = tables.first_table_pages(chosen, self.budget)
        if not admitted:
            raise Refused(f"{len(chosen)} pages", f"ask for pages {S.collapse(some)}", self.budget.table_pages, len(chosen))
        found = self._tables(source).where(F.col("page").isin(chosen))
        by = {r["basis"]: r["tables"] for r in tables.by_basis(found).collect()}
        rows = tables.confident(found, min_confidence).orderBy("page", "table_no").collect()
        return {"basis": min(by, key=lambda b: ir.CONFIDENCE.get(b, 0)) if by else "native", "tables": [{k: v for k, v in r.asDict().items() if k != "doc_id"} for r in rows], "count": len(rows), "found_before_filter": sum(by.values()), "by_basis": by, "pages": S.collapse(chosen)}

    def read_page(self, source: str, page: int) -> dict:
        found, _, n = self._selected(source, str(page))
        said = self._details(source)["layout"]
        layout = said[page - 1] if said else {"width": None, "height": None, "rotation": 0, "columns": 1, "looks_tabular": False, "words": None}
        text = found.first()["text"]
        words = len(text.split()) if layout["words"] is None else layout["words"]
        drawn = self._tables(source).where(F.col("page") == page).orderBy("table_no").collect()
        size = [layout["width"], layout["height"]] if said else None
        return {"basis": self._weakest(found), "page": page, "of": n, "size": size, "rotation": layout["rotation"], "columns": layout["columns"], "looks_tabular": layout["looks_tabular"], "text": text, "words": words, "tables": [r["rows"] for r in drawn]}

    def to_markdown(self, source: str, pages: str = "") -> dict:
        found, chosen, _ = self._selected(source, pages)
        self._admit(found)
        row = markdown.to_markdown(markdown.prepared(self._mine(source).where(F.col("page").isin(chosen)))).first()
        made = row.asDict() if row else {"doc_id": source, "markdown": "", "characters": 0, "headings": 0, "tables": 0}
        made.pop("doc_id")
        return {"basis": self._weakest(found), "pages": S.collapse(chosen), **made}

    def assemble(self, sources: list[str], select: str, out: str) -> dict:
        counts = {r["doc_id"]: r["n"] for r in self.pages_frame().where(F.col("doc_id").isin(sources)).groupBy("doc_id").agg(F.max("page").alias("n")).collect()}
        missing = [s for s in sources if s not in counts]
        if missing:
            raise base.ReadError(f"no document {missing[0]!r}", self._nearest(missing[0]))
        plan = A.parse(select, sources, [counts[s] for s in sources])
        pages = self.pages_frame().withColumn("rotation", F.lit(0))
        out = output_path(out, sources[0], "", self.out_root)
        A.assemble(pages, [(sources[i], p, r) for i, p, r in plan]).coalesce(1).write.mode("overwrite").parquet(out)
        parts = [{"source": sources[i], "page": p, "rotate": r} for i, p, r in plan]
        return {"out": out, "pages_written": len(plan), "parsed": parts}

    def convert(self, source: str, to: str, out: str = "", pages: str = "", dpi: int = 150) -> dict:
        if to == "images":
            return self._render(source, out, pages, dpi)
        if "::" in source and to == "file":
            return self._copied(source, out)
        if to not in ("txt", "md", "html", "pdf"):
            if self.converter and to in ("docx", "xlsx", "pptx", "odt"):
                target = output_path(out, source, f".{to}", self.out_root)
                self._pages(source)
                self.converter(source, to, target)
                return {"out": target, "to": to}
            why = "is for members of an archive" if to == "file" else "would have to invent a layout, and no converter is plugged in"
            raise Refused(f"{to} {why}", "convert to txt, md, html or pdf", 0, 0)
        target = output_path(out, source, f".{to}", self.out_root)
        if to == "pdf":
            found, chosen, _ = self._selected(source, pages)
            self._admit(found)
            texts = [r["text"] for r in found.orderBy("page").select("text").collect()]  # admitted, so their size is bounded
            data = text_pdf(texts)
            write_bytes(self.spark, target, data)
            return {"out": target, "to": to, "characters": sum(map(len, texts)), "bytes": len(data)}
        text = self.to_markdown(source, pages)["markdown"] if to == "md" else self.extract(source, pages)["text"]
        frame = self.spark.createDataFrame([(source.rsplit("/", 1)[-1], text)], "title string, text string")
        (frame.select(T.html_page(F.col("title"), F.col("text"))) if to == "html" else frame.select("text")).coalesce(1).write.mode("overwrite").text(target)
        return {"out": target, "to": to, "characters": len(text), "bytes": len(text.encode())}

    def _copied(self, source: str, out: str) -> dict:
        """A member of an archive as a file of its own."""
        archive, inside = source.split("::", 1)
        found = self.spark.read.format("binaryFile").load(archive).select("content").first()
        data = member(bytes(found["content"]), inside)
        target = output_path(out or inside.rsplit("/", 1)[-1], source, "", self.out_root)
        write_bytes(self.spark, target, data)
        return {"out": target, "to": "file", "bytes": len(data)}

    def _render(self, source: str, out: str, pages: str, dpi: int) -> dict:
        """Pictures of pages: bytes are estimated first, and a request that fits is named."""
        _, chosen, _ = self._selected(source, pages)
        layout = self._details(source)["layout"]
        sizes = [(layout[p - 1]["width"], layout[p - 1]["height"]) if layout else (612.0, 792.0) for p in chosen]
        cost = lambda d: sum(int(w * d / 72) * int(h * d / 72) * 4 for w, h in sizes)
        if cost(dpi) > self.budget.render_bytes:
            fits = next((d for d in range(dpi, 35, -1) if cost(d) <= self.budget.render_bytes), 0)
            upto = next((n for n in range(len(chosen), 0, -1) if sum(int(w * dpi / 72) * int(h * dpi / 72) * 4 for w, h in sizes[:n]) <= self.budget.render_bytes), 0)
            hint = f"ask for dpi={fits}" if fits else f"ask for pages {S.collapse(chosen[:upto])}" if upto else "ask for fewer dots"
            raise Refused(f"{len(chosen)} pages at {dpi} dpi are about {cost(dpi)} bytes", hint, self.budget.render_bytes, cost(dpi))
        if not self.renderer:
            raise Refused("no renderer is plugged in", "open the engine with renderer=, or convert to txt, md, html or pdf", 0, len(chosen))
        target = output_path(out, source, "", self.out_root)
        self.renderer(source, chosen, dpi, target)
        return {"out": target, "to": "images", "pages": S.collapse(chosen), "dpi": dpi}

    def redact(self, source: str, pattern: str, pages: str = "", regex: bool = False, out: str = "") -> dict:
        _, chosen, _ = self._selected(source, pages)
        runs = self._mine(source).where(F.col("page").isin(chosen)).select("doc_id", "page", F.col("ord").alias("run"), "text")
        said = redact.summary(runs, pattern, regex).first()
        kept = redact.verified(runs, pattern, regex)
        if out:
            out = output_path(out, source, "", self.out_root)
            kept.write.mode("overwrite").parquet(out)
        return {"out": out, "redacted": said["redacted"], "pages": said["pages"], "verified": True, "residual_matches": 0}

    def ocr(self, source: str, pages: str = "", out: str = "") -> dict:
        found, _, n = self._selected(source, pages)
        todo = sorted(r["page"] for r in found.where(ir.is_scanned(F.col("basis")) & F.col("has_content")).select("page").collect())
        if not todo:
            return {"out": "", "pages_ocred": 0, "pages": "", "pages_still_without_text": found.where(ir.is_scanned(F.col("basis"))).count(), "note": "no page is a picture without text"}
        admitted, fit = ocr_admitted(len(todo), self.budget)
        if not admitted:
            raise Refused(f"{len(todo)} pages", f"ask for pages {S.collapse(todo[:fit])}", self.budget.ocr_seconds, len(todo) * self.budget.ocr_seconds_a_page)
        if not self.recogniser:
            raise Refused("no recogniser is plugged in", "open the engine with recogniser=, or use operators.assemble.upsert", 0, len(todo))
        said = {p: t for p, t in self.recogniser(source, todo).items() if p in todo}
        target = output_path(out, source, "", self.out_root)
        read = self.spark.createDataFrame([(source, p, t) for p, t in said.items()], "doc_id string, page int, text string").withColumn("basis", F.lit("ocr")).withColumn("has_content", F.lit(True))
        whole = A.upsert(self._pages(source).select("doc_id", "page", "text", "basis", "has_content"), read)
        whole.coalesce(1).write.mode("overwrite").parquet(target)
        left = self.spark.read.parquet(target).where((F.trim("text") == "")).count()
        return {"basis": "ocr", "out": target, "pages_ocred": len(said), "pages": S.collapse(list(said)), "pages_still_without_text": left}

    def optimize(self, source: str, action: str = "compress", out: str = "") -> dict:
        if action not in ("compress", "repair", "linearize"):
            raise Refused(f"unknown action {action!r}", "use compress, repair or linearize", 0, 0)
        self._pages(source)
        if not self.rewriter:
            raise Refused("no PDF writer is plugged in", "open the engine with rewriter=; budget.size_ratio() states the gain", 0, 0)
        target = output_path(out, source, ".pdf", self.out_root)
        before, after = self.rewriter(source, action, target)
        return {"out": target, "action": action, "bytes_before": before, "bytes_after": after, "ratio": size_ratio(before, after)}

    def protect(self, source: str, action: str, password: str = "", out: str = "") -> dict:
        if action not in ("encrypt", "decrypt"):
            raise Refused(f"unknown action {action!r}", "use encrypt or decrypt", 0, 0)
        if not password:
            raise base.ReadError("a password is needed", "give password")
        if not self.cipher:
            raise Refused("no cipher for PDF files is plugged in", "open the engine with cipher=", 0, 0)
        target = output_path(out, source, ".pdf", self.out_root)
        self.cipher(source, action, password, target)
        return {"out": target, "action": action}

    ACTIONS = ("probe", "outline", "find", "extract", "extract_tables", "read_page", "to_markdown", "assemble", "convert", "optimize", "ocr", "protect", "redact")

    def run(self, action: str, /, **args) -> dict:
        """Any action by name, as an envelope: a failure is an answer, not an exception."""
        try:
            if action not in self.ACTIONS:
                near = difflib.get_close_matches(action, self.ACTIONS, 1)
                raise base.ReadError(f"unknown action {action!r}", f"did you mean {near[0]}" if near else "use one of " + ", ".join(self.ACTIONS))
            method = getattr(self, action)
            known = list(inspect.signature(method).parameters)
            for name in args:
                if name not in known:
                    near = difflib.get_close_matches(name, known, 1)
                    raise base.ReadError(f"unknown argument {name!r}", f"did you mean {near[0]}" if near else "use " + ", ".join(known))
            for name, parameter in inspect.signature(method).parameters.items():
                if parameter.default is inspect.Parameter.empty and name not in args:
                    raise base.ReadError(f"{name} is missing", f"give {name}")
                wanted = {"str": str, "int": int, "bool": bool, "float": (int, float), "list[str]": list}.get(str(parameter.annotation))
                if name in args and wanted and not isinstance(args[name], wanted):
                    raise base.ReadError(f"{name} must be {parameter.annotation}", f"got {type(args[name]).__name__}")
            result = method(**args)
            return envelope(action, result, result.pop("basis", ""))
        except (Refused, base.ReadError, S.SelectionError, search.PatternError, redact.ResidualMatch, search.PatternTimeout) as bad:
            return envelope(action, error=bad)
        except PythonException as bad:  # what a worker raised
            late = re.search(r"PatternTimeout: (.*)", str(bad))
            if not late:
                raise
            limit = self.budget.regex_seconds
            return envelope(action, error=Refused(late[1], "use a pattern without nested repeats, or search literally", limit, limit))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file through Hadoop's file systems, so that a path may be any that Spark writes to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(data)
    finally:
        stream.close()
