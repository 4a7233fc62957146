"""Documents to ordered elements: paragraphs and table rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from reconlink.config import DEFAULTS, Thresholds
from reconlink.functions.text import base_name, squeeze, text

# Words that mark a table's header row and the file formats read.
HEADER_KEYWORDS = ("дата", "время", "подраздел", "пу", "кпп", "событ", "наруш", "статья", "комментар")
HEADER_CELL_CHARS = 40
EXTENSIONS = ("docx", "odt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
RAW_SCHEMA = "doc_id string, idx int, kind string, text string, cells array<string>, table_no int, row_no int, error string"


def _docx_rows(data: bytes) -> Iterator[tuple]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def words(node) -> str:
        return "".join(n.text or "" for n in node.iter(f"{_W}t"))

    table = 0
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            yield "paragraph", words(child), None, None, None
        elif child.tag == f"{_W}tbl":
            for row_no, row in enumerate(child.iter(f"{_W}tr")):
                cells = [" ".join("\n".join(words(p) for p in cell.iter(f"{_W}p")).split()) for cell in row.iter(f"{_W}tc")]
                yield "table_row", " | ".join(cells), cells, table, row_no
            table += 1


def _odt_rows(data: bytes) -> Iterator[tuple]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    for node in root.iter():
        if node.tag in (f"{_T}h", f"{_T}p"):
            yield "paragraph", " ".join(p.strip() for p in node.itertext() if p and p.strip()), None, None, None


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(elements, errors) of the files under ``path``; one task row per file, bad files go to errors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.select(base_name("path").alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, ext, content in batch.itertuples(index=False):
                out, error = [], None
                try:
                    if ext not in EXTENSIONS:
                        raise ValueError(f"unsupported extension: {ext}")
                    found = _docx_rows(content) if ext == "docx" else _odt_rows(content)
                    kept = (r for r in found if r[0] == "table_row" or " ".join((r[1] or "").split()))
                    out = [(doc, i, kind, body, cells, table, row, None) for i, (kind, body, cells, table, row) in enumerate(kept)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                if error:
                    out = [(doc, None, None, None, None, None, None, error)]
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in RAW_SCHEMA.split(", ")])
                for c in ("idx", "table_no", "row_no"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    raw = named.mapInPandas(parse, RAW_SCHEMA)
    return with_headers(raw.filter("error IS NULL").drop("error")), raw.filter("error IS NOT NULL").select("doc_id", "error")


def header_by_keyword(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.lower(c).rlike("|".join(HEADER_KEYWORDS)))


def header_by_shape(cells: Column, next_cells: Column, min_chars: int) -> Column:
    short = F.forall(F.filter(cells, lambda c: c != ""), lambda c: F.length(c) <= HEADER_CELL_CHARS)
    return next_cells.isNotNull() & short & (F.length(squeeze(F.array_join(next_cells, " "))) >= min_chars)


def with_headers(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, idx, kind, text, cells, header_cells, is_header: a table's header row copied to its data rows.

    Only row 0 of a table and the row after it decide, so the header is found
    on those rows and joined back; no table is gathered.
    """
    first = rows.filter("kind = 'table_row' AND row_no = 0").select("doc_id", "table_no", F.col("cells").alias("_head"))
    second = rows.filter("kind = 'table_row' AND row_no = 1").select("doc_id", "table_no", F.col("cells").alias("_next"))
    any_cell = F.exists("_head", lambda c: c != "")
    decided = first.join(second, ["doc_id", "table_no"], "left").select(
        "doc_id", "table_no", "_head",
        (any_cell & (header_by_keyword(F.col("_head")) | header_by_shape(F.col("_head"), F.col("_next"), t.min_mention_chars))).alias("_is"))
    joined = rows.join(decided.filter("_is"), ["doc_id", "table_no"], "left")
    is_header = F.coalesce(F.col("_is") & (F.col("row_no") == 0), F.lit(False))
    return joined.select(
        "doc_id", "idx", "kind", squeeze("text").alias("text"), "cells",
        F.when(~is_header, F.col("_head")).alias("header_cells"), is_header.alias("is_header"))


def _pieces(value, pattern: str) -> Column:
    whole = F.coalesce(text(value), F.lit(""))
    return F.filter(F.transform(F.split(whole, pattern), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")


def text_blocks(value) -> Column:
    """Trimmed, non-empty blocks between blank lines."""
    return _pieces(value, r"\n\s*\n+")


def text_lines(value) -> Column:
    """Trimmed, non-empty lines."""
    return _pieces(value, r"\r\n|\r|\n")


def elements_of_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, by: str = "blocks") -> DataFrame:
    """Paragraph elements of plain text, one per block or per line."""
    pieces = text_lines(text_col) if by == "lines" else text_blocks(text_col)
    blocks = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("idx", "text"))
    return blocks.select(
        "doc_id", "idx", F.lit("paragraph").alias("kind"), squeeze("text").alias("text"),
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("array<string>").alias("header_cells"),
        F.lit(False).alias("is_header")).filter("text <> ''")


def _joined(cells: Column) -> Column:
    return squeeze(F.array_join(F.transform(cells, squeeze), " "))


def classed_elements(elements: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds the mention text and fate: header, empty_row, short or kept."""
    row = F.col("kind") == "table_row"
    body = F.when(row, _joined(F.col("cells"))).otherwise(squeeze("text"))
    blank = row & ~F.exists("cells", lambda c: F.trim(c) != "")
    return elements.withColumn("mention", body).withColumn(
        "fate", F.when(F.col("is_header"), "header").when(F.coalesce(blank, F.lit(False)), "empty_row")
        .when(F.length("mention") < t.min_mention_chars, "short").otherwise("kept"))


def mentions_of(elements: DataFrame, t: Thresholds = DEFAULTS, *, whole_text: bool = False) -> DataFrame:
    """doc_id, idx (from 1), kind, text, cells, header_cells of the kept elements.

    ``whole_text``: a document of which nothing is kept gives its whole text as one mention.
    """
    classed = classed_elements(elements, t)
    kept = classed.filter("fate = 'kept'")
    rows = kept.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))).select(
        "doc_id", F.col("_n").alias("idx"), "kind", F.col("mention").alias("text"), "cells", "header_cells")
    if not whole_text:
        return rows
    bare = elements.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = bare.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("_l")).select(
        "doc_id", F.lit(1).alias("idx"), F.lit("paragraph").alias("kind"),
        squeeze(F.array_join(F.transform("_l", lambda x: x["text"]), "\n")).alias("text"),
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("array<string>").alias("header_cells"))
    return rows.unionByName(whole.filter("text <> ''"))


def slicing_summary(elements: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    classed = classed_elements(elements, t)
    return classed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("fate") == "kept").alias("kept"),
        F.count_if(F.col("fate") == "short").alias("skipped_short"),
        F.count_if(F.col("fate") == "empty_row").alias("skipped_empty_rows"))
