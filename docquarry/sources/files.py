"""Files as DataFrames: validation, kinds, hashes, and readers for the formats that need no foreign decoder.

PDF pages, OCR and page images come from a decoder outside this library: their decoded output enters as DataFrames
(pages, layout lines and words, OCR tokens, chart ticks) with the columns named in the operators that take them.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, time, timedelta
from functools import lru_cache

import pandas as pd
from pandas.io.parsers import TextParser
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import text as X
from ..operators.numbering import numbered

MATRIX = T.ArrayType(T.ArrayType(T.StringType()))


def upload_paths(files: Iterable) -> list[str]:
    """Paths given as strings or as objects with a name."""
    return [f if isinstance(f, str) else str(f.name) for f in files or []]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, size_bytes, content of every file under a path, in path order (input_pos)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), "content").withColumn("input_pos", F.col("file_path"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def file_kind(path: Column) -> Column:
    """S02."""
    ext = extension(path)
    image = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
    return F.when(ext.isin("pdf", "docx", "txt", "csv", "xlsx"), ext).when(ext.isin(*image), F.lit("image")).otherwise(F.lit("unknown"))


def content_hash(content: Column) -> Column:
    """S03."""
    return F.sha2(content.cast("binary"), 256)


def validate(files: DataFrame, strict: bool = True) -> DataFrame:
    """Extension and size. strict: a bad file fails the batch; else its row carries the reason."""
    bad = F.when(~extension(F.col("file_path")).isin(*config.EXTENSIONS), F.concat(F.lit("Unsupported file type: "), "file_path")).when(
        F.col("size_bytes") > config.MAX_FILE_BYTES, F.concat(F.lit("File is larger than 100 MB: "), "file_path")
    )
    if not strict:
        return files.withColumn("reject_reason", bad)
    checked = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("file_path")).cast("string")
    return files.withColumn("file_path", checked)


#: Kinds whose name settles the type, whatever they say.
TYPE_OF_KIND = {"csv": "Spreadsheet", "xlsx": "Spreadsheet", "txt": "Text Document", "image": "Image Document"}


def type_of(kind: Column, sample: Column, name: Column) -> Column:
    """X14 behind the kinds of TYPE_OF_KIND: the type from a text sample and the file's name."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in TYPE_OF_KIND.items() for x in pair))[kind], X.doc_type(sample, name))


def registry(files: DataFrame) -> DataFrame:
    """The first file of each content, numbered in input order; its type is that of its name until typed().

    files: input_pos, file_path, size_bytes, content (or file_hash). Numbers come from ranges of input_pos, not from one task.
    """
    hashed = files if "file_hash" in files.columns else files.withColumn("file_hash", content_hash(F.col("content")))
    kept = hashed.groupBy("file_hash").agg(F.min(F.struct("input_pos", "file_path", "size_bytes")).alias("f")).select("file_hash", "f.*")
    kind = file_kind(F.col("file_path"))
    return numbered(kept, ["input_pos", "file_path"]).select(
        F.format_string("doc_%03d", "number").alias("document_id"),
        file_name(F.col("file_path")).alias("file"),
        type_of(kind, F.lit(""), file_name(F.col("file_path"))).alias("doc_type"),
        "file_path",
        kind.alias("file_kind"),
        "file_hash",
        F.col("size_bytes").alias("file_size_bytes"),
        "input_pos",
    )


def typed(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Documents with their types from text samples (document_id, sample); without a sample the name alone decides."""
    with_sample = documents.join(samples, "document_id", "left")
    return with_sample.withColumn("doc_type", type_of(F.col("file_kind"), F.coalesce("sample", F.lit("")), F.col("file"))).drop("sample")


def text_sample(c: Column, most: int = 4000) -> Column:
    """S05."""
    return F.substring(X.text(c), 1, most)


def page_sample(pages: DataFrame, most_pages: int = 2, most: int = 4000) -> DataFrame:
    """The first pages' text of each document."""
    first = pages.filter(F.col("page") <= most_pages).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", X.text(F.col("text")).alias("text")))).alias("p"))
    return first.select("document_id", F.substring(F.array_join(F.transform("p", lambda p: p["text"]), "\n"), 1, most).alias("sample"))


def unit_counts(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Pages of PDF files and sheets of XLSX files (units: document_id, a row each), 0 where none could be read; other kinds
    count as one."""
    n = units.groupBy("document_id").agg(F.count("*").alias("num_pages"))
    several = F.col("file_kind").isin("pdf", "xlsx")
    return documents.join(n, "document_id", "left").withColumn("num_pages", F.when(several, F.coalesce("num_pages", F.lit(0))).otherwise(1).cast("int"))


def decode_text(content: Column) -> Column:
    """UTF-8, undecodable bytes left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATA, ROW, CELL, VALUE, TEXT = (S + name for name in ("sheetData", "row", "c", "v", "t"))


def _printed(column: pd.Series) -> list[str]:
    """A column's cells as text; plain numbers and texts print as pandas prints them, without its detours."""
    values = column.tolist()
    if column.dtype.kind in "iub":
        return [str(v) for v in values]
    if column.dtype.kind == "f":
        return ["" if v != v else str(v) for v in values]
    if all(type(v) is str for v in values):
        return values
    there = column.notna()
    return (column if there.all() else column.astype(object).where(there, "")).astype(str).tolist()


def shown(frame: pd.DataFrame) -> list[list[str]]:
    """A frame's header and cells as text; missing cells are empty."""
    return [[str(c) for c in frame.columns], *map(list, zip(*(_printed(c) for _, c in frame.items()), strict=True))]


def _by_place(frame: pd.DataFrame) -> pd.DataFrame:
    """The same frame if its names are all different (pandas numbers repeated ones while reading)."""
    if not frame.columns.is_unique:
        raise ValueError("repeated column names")
    return frame


def csv_cells(content: bytes) -> list[list[str]]:
    """Header and cells of a CSV file as its columns' narrowest types print: integers beside gaps are floats, words for
    missing values are empty, repeated headers are numbered. An empty file is an error."""
    return shown(_by_place(pd.read_csv(io.BytesIO(content))))


def docx_parts(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Paragraph text outside tables, and the tables' cells, of a DOCX file."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    said = lambda p: "".join((n.text or "") if n.tag == f"{W}t" else "\t" if n.tag == f"{W}tab" else "\n" if n.tag == f"{W}br" else "" for n in p.iter())
    paragraphs = [t for p in body.findall(f"{W}p") if (t := said(p).strip())]
    tables = [[["\n".join(said(p) for p in cell.findall(f"{W}p")) for cell in row.findall(f"{W}tc")] for row in table.findall(f"{W}tr")] for table in body.findall(f"{W}tbl")]
    return "\n".join(paragraphs), tables


# Built-in number formats of dates and times, and the days before the first one.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time: a letter of one outside quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', "", code.split(";")[0])
    return bool(re.search("[dmhysDMHYS]", plain)) and "general" not in plain.lower()


def date_styles(raw: bytes) -> list[bool]:
    """For each cell style of a workbook, whether its number format is one of dates."""
    root = ET.fromstring(raw)
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{S}numFmt")}
    styles = root.find(f"{S}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
    return [is_date_format(own[i]) if i in own else i in DATE_FORMATS for i in ids]


def serial_date(days: float, epoch: datetime) -> datetime | time:
    """A serial number as a moment (to the millisecond); below one day as a time of day."""
    at = epoch + timedelta(milliseconds=round(days * 86_400_000))
    return at.time() if 0 <= days < 1 else at


def xlsx_value(kind: str, value: str, dated: bool, shared: list[str], epoch: datetime):
    """A cell's value: text, number (whole ones as integers), boolean, date or nothing."""
    if kind == "s":
        return shared[int(value)]
    if kind in ("str", "inlineStr"):
        return value
    if value == "" or kind == "e":
        return "" if kind != "e" else float("nan")
    if kind == "b":
        return value.strip() in ("1", "true")
    if kind == "d":
        return datetime.fromisoformat(value)
    number = float(value)
    return serial_date(number, epoch) if dated else int(number) if number.is_integer() else number


def _texts(stream, tag: str) -> list[str]:
    """Shared strings, one element at a time (phonetic readings are left out)."""
    out = []
    for _, node in ET.iterparse(stream):
        if node.tag == f"{S}rPh":
            node.clear()
        elif node.tag == tag:
            out.append("".join(t.text or "" for t in node.iter(f"{S}t")))
            node.clear()
    return out


def _sheet_rows(stream) -> Iterator[ET.Element]:
    """The rows of a sheet, each given up once it is read: the parser's own tree is emptied after every piece of the file."""
    data: list[ET.Element] = []

    def element(tag: str, attributes: dict) -> ET.Element:
        new = ET.Element(tag, attributes)
        if tag == DATA:
            data.append(new)
        return new

    parser = ET.XMLParser(target=ET.TreeBuilder(element_factory=element))
    while piece := stream.read(1 << 16):
        parser.feed(piece)
        for at in data:
            whole = list(at)[:-1]  # the last one may be open
            yield from (row for row in whole if row.tag == ROW)
            del at[: len(whole)]
    parser.close()
    yield from (row for at in data for row in at if row.tag == ROW)


@lru_cache(1024)
def _column(letters: str) -> int:
    at = 0
    for x in letters:
        at = at * 26 + ord(x.upper()) - 64
    return at


def xlsx_rows(stream, shared: list[str], dates: list[bool], epoch: datetime) -> list[list]:
    """Typed cells of a sheet, read row by row; skipped rows and cells are empty, empty rows at the end are left out."""
    rows: list[list] = []
    for row in _sheet_rows(stream):
        number = int(row.get("r") or len(rows) + 1)
        rows += [[] for _ in range(number - 1 - len(rows))]
        cells: list = []
        for c in row.iterfind(CELL):
            at = _column("".join(filter(str.isalpha, c.get("r") or "")))
            if at - 1 > len(cells):
                cells += [""] * (at - 1 - len(cells))
            kind, style = c.get("t") or "n", int(c.get("s") or 0)
            value = "".join(t.text or "" for t in c.iter(TEXT)) if kind == "inlineStr" else c.findtext(VALUE) or ""
            cells.append(xlsx_value(kind, value, style < len(dates) and dates[style], shared, epoch))
        rows.append(cells)
    while rows and all(isinstance(c, str) and c == "" for c in rows[-1]):
        rows.pop()
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, header and cells as text) of every sheet of an XLSX file, its columns as their narrowest types print."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names, book = set(z.namelist()), ET.fromstring(z.read("xl/workbook.xml"))
    shared = _texts(z.open("xl/sharedStrings.xml"), f"{S}si") if "xl/sharedStrings.xml" in names else []
    dates = date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
    properties = book.find(f"{S}workbookPr")
    epoch = EPOCH_1904 if properties is not None and properties.get("date1904") in ("1", "true") else EPOCH
    places = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in book.find(f"{S}sheets"):
        place = places[sheet.get(f"{R}id")]
        rows = xlsx_rows(z.open(place.lstrip("/") if place.startswith("/") else f"xl/{place}"), shared, dates, epoch)
        out.append((sheet.get("name"), shown(_by_place(TextParser(rows, header=0).read())) if rows else []))
    return out


def read_docx(files: DataFrame) -> DataFrame:
    """document_id, text, tables (array of matrices) and error of DOCX files (document_id, content)."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("tables", T.ArrayType(MATRIX)), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def decode(content: pd.Series) -> pd.DataFrame:
        def one(raw) -> tuple:
            try:
                return (*docx_parts(bytes(raw)), None)
            except Exception as e:  # noqa: BLE001 - a broken file becomes a warning of its document
                return "", [], f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(c) for c in content], columns=["text", "tables", "error"])

    return files.withColumn("d", decode("content")).select("document_id", "d.*")


def _sheets(files: DataFrame, parts) -> DataFrame:
    """document_id, page, sheet_name, matrix (header first) and error: a row for each of a file's sheets, or one with the error of
    a file that can't be read. parts: content -> (name, cells) of its sheets."""
    schema = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("sheet_name", T.StringType()), T.StructField("matrix", MATRIX), T.StructField("error", T.StringType())]))

    @F.pandas_udf(schema)
    def decode(content: pd.Series) -> pd.Series:
        def one(raw) -> list:
            try:
                return [{"page": i, "sheet_name": n, "matrix": m, "error": None} for i, (n, m) in enumerate(parts(bytes(raw)), 1)]
            except Exception as e:  # noqa: BLE001 - a broken file becomes a warning of its document
                return [{"page": None, "sheet_name": None, "matrix": None, "error": f"{type(e).__name__}: {e}"}]

        return content.map(one)

    return files.select("document_id", F.explode(decode("content")).alias("s")).select("document_id", "s.*")


def read_xlsx(files: DataFrame) -> DataFrame:
    """document_id, page (sheet from 1), sheet_name, matrix and error of XLSX files (document_id, content)."""
    return _sheets(files, xlsx_sheets)


def read_csv_content(files: DataFrame) -> DataFrame:
    """document_id, page (1), matrix and error of CSV files (document_id, content)."""
    return _sheets(files, lambda raw: [(None, csv_cells(raw))])


def table_from_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows of a frame gathered to a matrix per key, header first; fewer than one data row gives no matrix."""
    cells = F.array(*(X.text(F.col(c)) for c in columns))
    grouped = df.select(*keys, F.struct(*order).alias("o"), cells.alias("cells")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "cells"))).alias("m"))
    return grouped.select(*keys, F.concat(F.array(X.lit_array(columns)), F.transform("m", lambda r: r["cells"])).alias("matrix"))
