"""Word files as ordered blocks: Spark reads the bytes, the standard library the XML.

Only the walk over one file's XML is Python (Arrow batches of one file); headings, sections, tables and
chunks are the folds of ``operators.chunking``.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivia.functions.text import cell, squeeze
from scrivia.operators import chunking

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCKS = pa.list_(pa.struct([("style", pa.string()), ("is_list", pa.bool_()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))
_DDL = "raw array<struct<style:string,is_list:boolean,text:string,rows:array<array<string>>>>, error string"


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("word/styles.xml"))
    names = ((s.get(f"{_W}styleId"), s.find(f"{_W}name")) for s in root.iter(f"{_W}style"))
    return {k: n.get(f"{_W}val", "") for k, n in names if k and n is not None}


def _run(run) -> str:
    out = []
    for e in run:
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}noBreakHyphen":
            out.append("-")
        elif e.tag in (f"{_W}tab", f"{_W}ptab", f"{_W}cr") or e.tag == f"{_W}br" and e.get(f"{_W}type", "textWrapping") == "textWrapping":
            out.append(" ")
    return "".join(out)


def _text(p) -> str:
    """The text of a paragraph's own runs and links; drawings, text boxes and alternatives inside a run have none."""
    own = (r for e in p for r in (e if e.tag == f"{_W}hyperlink" else (e,)))
    return "".join(_run(r) for r in own if r.tag == f"{_W}r")


def _rows(table) -> list[list[str]]:
    """A table's cell texts; a cell merged over columns or rows is repeated in all of them, tables inside cells are left out."""
    out: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            span, down = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
            if down is not None and down.get(f"{_W}val", "continue") == "continue" and out and len(cells) < len(out[-1]):
                text = out[-1][len(cells)]
            else:
                text = " ".join(_text(p) for p in tc.findall(f"{_W}p"))
            cells += [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
        out.append(cells)
    return out


def _body(xml) -> Iterator:
    """The body's own elements, each forgotten once the next is asked for."""
    depth, body = 0, None
    for event, e in ElementTree.iterparse(xml, ("start", "end")):
        if event == "start":
            if depth == 1 and e.tag == f"{_W}body":
                body = e
            depth += 1
            continue
        depth -= 1
        if e is body:
            body = None
        elif body is not None and depth == 2:
            yield e
            body.clear()


def iter_blocks(content: bytes) -> Iterator[dict]:
    """Paragraphs (style name, whether numbered, text) and tables (rows of cell texts) in body order, read one at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = _styles(z)
        with z.open("word/document.xml") as xml:
            for e in _body(xml):
                if e.tag == f"{_W}p":
                    style, numbered = e.find(f"{_W}pPr/{_W}pStyle"), e.find(f"{_W}pPr/{_W}numPr") is not None
                    sid = style.get(f"{_W}val", "") if style is not None else ""
                    yield {"style": styles.get(sid, sid), "is_list": numbered, "text": _text(e), "rows": None}
                elif e.tag == f"{_W}tbl":
                    yield {"style": None, "is_list": False, "text": None, "rows": _rows(e)}


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, content) of the Word files under ``path``, lock files left out."""
    return named(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path))


def named(files: DataFrame) -> DataFrame:
    """(path, filename, content) of files as ``binaryFile`` gives them, lock files left out."""
    name = F.call_function("url_decode", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return files.select("path", name.alias("filename"), "content").where(~F.startswith("filename", F.lit("~$")))


def _items():
    """Blocks as ``section_fold`` takes them; a table's pieces follow one another."""

    def one(b):
        level = F.nullif(F.regexp_extract(F.coalesce(b["style"], F.lit("")), r"(?i)heading\s*(\d)", 1), F.lit("")).cast("int")
        text = squeeze(F.coalesce(b["text"], F.lit("")))
        text = F.when(level.isNull() & b["is_list"] & (text != ""), F.concat(F.lit("- "), text)).otherwise(text)
        para = F.array(F.struct(level.alias("level"), F.lit("text").alias("kind"), text.alias("text")))
        pieces = F.transform(
            chunking.table_blocks(F.transform(b["rows"], lambda r: F.transform(r, cell))),
            lambda t: F.struct(F.lit(None).cast("int").alias("level"), F.lit("table").alias("kind"), t.alias("text")),
        )
        return F.when(b["rows"].isNotNull(), pieces).otherwise(para)

    return F.flatten(F.transform("raw", one))


_UNREADABLE = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, EOFError, RuntimeError, NotImplementedError)


def extract(files: DataFrame) -> DataFrame:
    """``files`` (path, filename, content, ...) without content, with ``blocks`` (with heading paths) and ``error`` (unreadable files)."""
    kept = [c for c in files.columns if c != "content"]
    src = files.select(*kept, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            blocks, error = [], None
            try:
                blocks = list(iter_blocks(one.column(len(kept))[0].as_py()))
            except _UNREADABLE as e:
                error = f"{type(e).__name__}: " + re.sub(r"\s+", " ", str(e))
            yield pa.RecordBatch.from_arrays([*one.columns[: len(kept)], pa.array([blocks], _BLOCKS), pa.array([error], pa.string())], [*kept, "raw", "error"])

    raw = src.mapInArrow(run, StructType([*src.schema.fields[:-1], *StructType.fromDDL(_DDL).fields]))
    return raw.withColumn("blocks", chunking.section_fold(_items())).drop("raw")
