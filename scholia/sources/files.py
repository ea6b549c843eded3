"""Files as tables: text, Markdown, Word and PowerPoint files to pages, JSON lines with diagnostics, strict CSV."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import clean_title, paragraphs

# The extensions that can be read, and the namespaces of the office formats.
TEXT, OFFICE = ["txt", "md", "markdown"], ["docx", "pptx"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
PAGES = "path string, page_num int, text string, error string"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, extension, title, sha256, supported, content of all files below the folder but hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.expr("substring_index(path, '/', -1)")
    rows = files.where(~F.col("path").rlike(r"/\.[^/]"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.select("path", ext.alias("extension"), clean_title(inner).alias("title"), F.sha2("content", 256).alias("sha256"), ext.isin([*TEXT, *OFFICE]).alias("supported"), "content")


def decoded(content):
    """UTF-8, or Latin-1 where the bytes are none."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def text_pages(files: DataFrame) -> DataFrame:
    """path, page_num, text, error: each paragraph is a page, numbered from 1."""
    text = files.where(F.col("extension").isin(TEXT)).select("path", F.posexplode(paragraphs(decoded(F.col("content")))).alias("n", "text"))
    return text.select("path", (F.col("n") + 1).alias("page_num"), "text", F.lit(None).cast("string").alias("error"))


def word_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ["".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p")]
    return [p for p in found if p]


def slides(data: bytes) -> list[str]:
    """Slide texts with their notes, in the order of the presentation; a relation that leads out of the file is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:

        def related(part: str) -> dict[str, tuple[str, str]]:
            folder, name = part.rsplit("/", 1)
            rels = f"{folder}/_rels/{name}.rels"
            if rels not in z.namelist():
                return {}
            out = {}
            for r in ElementTree.fromstring(z.read(rels)).iter(f"{_REL}Relationship"):
                kind = r.get("Type", "").rsplit("/", 1)[-1]
                if kind in ("slide", "notesSlide"):
                    steps: list[str] = []
                    target = r.get("Target", "")
                    for s in target.lstrip("/").split("/") if target.startswith("/") else [*folder.split("/"), *target.split("/")]:
                        if s == "..":
                            if not steps:
                                raise ValueError("a relation leads out of the file")
                            steps.pop()
                        else:
                            steps.append(s)
                    if r.get("TargetMode") == "External":
                        raise ValueError("a relation leads out of the file")
                    out[r.get("Id", "")] = (kind, "/".join(steps))
            return out

        def text(part: str) -> str:
            return "\n".join(x for p in ElementTree.fromstring(z.read(part)).iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()))

        links = related("ppt/presentation.xml")
        order = [x.get(f"{_R}id") for x in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        out = []
        for i in order:
            part = links[i][1]
            notes = [text(t) for kind, t in related(part).values() if kind == "notesSlide"]
            out.append("\n".join(x for x in [text(part), *notes] if x))
        return out


def office_pages(files: DataFrame) -> DataFrame:
    """path, page_num, text, error: paragraphs of Word files, slides of presentations; a file that can't be read is one row with its error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, ext, data in zip(b["path"], b["extension"], b["content"], strict=True):
                try:
                    pages = word_paragraphs(data) if ext == "docx" else slides(data)
                    rows += [(path, n, t, None) for n, t in enumerate(pages, 1)]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error"])

    return files.where(F.col("extension").isin(OFFICE)).select("path", "extension", "content").mapInPandas(each, PAGES)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of the folder's files; unsupported files as one row with an error."""
    files = discover(spark, folder)
    other = files.where(~F.col("supported")).select("path", F.lit(0).alias("page_num"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported: "), F.col("extension")).alias("error"))
    return text_pages(files).unionByName(office_pages(files)).unionByName(other)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, raw, row, problem: every line; problem is 'blank' or 'malformed' where it is no object of the schema."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    parsed = raw.withColumn("row", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))
    bad = ~F.trim("raw").rlike(r"(?s)^\{.*\}$") | F.get_json_object("raw", "$").isNull()
    return parsed.withColumn("problem", F.when(F.trim("raw") == "", "blank").when(bad, "malformed"))


def strict_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The CSV's rows; an error for a duplicate or missing column, a row of another length, or an empty cell."""
    head = spark.read.text(path).first()
    names = [] if head is None else [x.strip() for x in head[0].split(",")]
    if len(set(names)) != len(names) or not set(columns) <= set(names):
        raise ValueError(f"columns {names}; {columns} are needed, each once")
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    cells = F.array(*[F.col(f"`{n}`") for n in columns])
    empty = F.exists(cells, lambda c: c.isNull() | (F.trim(c) == ""))
    return rows.withColumn("_ok", F.when(empty, F.raise_error(F.lit("an empty cell"))).otherwise(F.lit(True))).where("_ok").drop("_ok")
