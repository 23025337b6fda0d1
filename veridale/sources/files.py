"""Readers and writers: files as DataFrames, JSON and JSON-lines stores, previews and reports.

PDF pages are a data source of their own (`sources.pdf`); workbooks and word-processor files are read here. What needs a model or
a library that isn't there comes in through a function given by the caller, run batch by batch in tasks with mapInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension -> extraction method; fixed values.
METHODS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "excel", "xls": "excel", "txt": "text", "md": "text", "png": "ocr", "jpg": "ocr", "jpeg": "ocr", "bmp": "ocr", "tif": "ocr", "tiff": "ocr"}
REPORTS = ["review_report", "audit_log"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def method(path: Column) -> Column:
    out = F.lit("unknown")
    for ext, name in METHODS.items():
        out = F.when(suffix(path) == ext, name).otherwise(out)
    return out


def wanted(path: Column, out_name: str, include_all: bool = False) -> Column:
    """Not in the output folder at any depth, not hidden or temporary, no earlier report, and of a known extension unless include_all."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    clean = ~F.array_contains(F.split(path, "/"), out_name) & ~name.rlike(r"^(\.|~\$)|\.tmp$")
    for r in REPORTS:
        clean = clean & ~name.startswith(r)
    return clean & (F.lit(True) if include_all else method(path) != "unknown")


#: Tasks that small files are dealt to, about: Spark takes some 30 files a task, so with more tasks than that each gets up to 32 times as many.
TASKS = 1 << 10


#: Rows that `extracted` holds before it hands them on, and bytes that `with_content` does.
ROWS, BYTES = 1 << 12, 1 << 24
#: Files that share a folder where many are saved, about: in one folder of all, writers wait for each other.
SHARED = 1 << 9


def packed(files: DataFrame) -> DataFrame:
    """files as Spark reads them, for `extracted`: fewer tasks where many small files make too many, as each needs a Python worker; nothing is shuffled."""
    n = files.rdd.getNumPartitions()
    return files.coalesce(max(TASKS, n // 32)) if n > TASKS else files


def listed(spark: SparkSession, folder: str, folders: int) -> DataFrame:
    """path, length, modified (microseconds) of the files that `saved` put into its numbered folders. Each folder is listed by a task, so the driver holds no list of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from .pdf import file_system

        system, to = file_system(folder)
        for batch in batches:
            for k in batch["id"]:
                found = system.get_file_info(fs.FileSelector(f"{to}/{k}", allow_not_found=True))
                rows = [(f.path, f.size, f.mtime_ns // 1000) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
                yield pd.DataFrame(rows, columns=["path", "length", "modified"])

    return spark.range(0, folders, 1, min(folders, TASKS)).mapInPandas(run, "path string, length long, modified long")


def with_content(files: DataFrame, folder: str) -> DataFrame:
    """path, length, modified, content of files of the folder as `listed` gives them, each read by the task that has its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .pdf import file_system

        system, _ = file_system(folder)
        for batch in batches:
            start, size, read = 0, 0, []
            for k, path in enumerate(batch["path"], 1):
                with system.open_input_stream(path) as f:
                    read.append(f.read())
                size += len(read[-1])
                if k == len(batch) or size >= BYTES:
                    yield batch[start:k].assign(content=read)
                    start, size, read = k, 0, []

    read = files.select("path", "length", "modified").mapInPandas(run, "path string, length long, modified long, content binary")
    return read.withColumn("modified", F.timestamp_micros("modified"))


def _read(spark: SparkSession, folder: str, keep: Column, recursive: bool, folders: int) -> DataFrame:
    if folders:
        return with_content(listed(spark, folder, folders).where(keep), folder)
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).where(keep).withColumnRenamed("modificationTime", "modified")


def scan(spark: SparkSession, folder: str, out_name: str = "out", recursive: bool = True, include_all: bool = False, folders: int = 0) -> DataFrame:
    """path, length, modified, method, content_hash of the files of a folder; folders: as many numbered ones as `saved` had. Without, Spark's reader passes over empty files."""
    files = _read(spark, folder, wanted(F.col("path"), out_name, include_all), recursive, folders)
    return files.select("path", "length", "modified", method(F.col("path")).alias("method"), F.sha2("content", 256).alias("content_hash"))


def changed(found: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index doesn't have as completed with the same content."""
    return found.join(index.where("status = 'completed'").select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def texts(spark: SparkSession, folder: str, folders: int = 0) -> DataFrame:
    """path, text of whole .txt and .md files; folders as for `scan`."""
    if folders:
        return _read(spark, folder, F.col("path").rlike(r"\.(txt|md)$"), True, folders).select("path", F.col("content").cast("string").alias("text"))
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def preview(text: Column, lines: int = 5, chars: int = 300) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, chars)


def scanned(pages: DataFrame, sample: int = 3) -> DataFrame:
    """doc_id, scanned: under 10 characters on average on the first pages."""
    return pages.where(F.col("page") <= sample).groupBy("doc_id").agg((F.avg(F.length("text")) < 10).alias("scanned"))


def extracted(files: DataFrame, schema: str, extract: Callable[[str, bytes], list[tuple]], retries: int = 0, keep_errors: bool = False) -> DataFrame:
    """What `extract(path, content)` gives for each file, as rows of schema: the place for OCR, PDF and vision libraries or services.

    A call that raises is tried `retries` times more. keep_errors: a file that fails all the same gives one row
    with its path, nulls, and `error`; otherwise the error ends the job. schema begins with path.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def rows_of(path: str, content: bytes) -> list[tuple]:
        for left in range(retries, -1, -1):
            try:
                return [(*row, None) for row in extract(path, content)]
            except Exception as e:  # whatever a caller's library raises
                if not left and not keep_errors:
                    raise
                error = f"{type(e).__name__}: {e}"
        return [(path, *[None] * (len(names) - 1), error)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=[*names, "error"], dtype=object)
        made: list[tuple] = []
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                made += rows_of(p, c)
                if len(made) >= ROWS:
                    yield frame(made)
                    made = []
        yield frame(made)

    made = files.select("path", "content").mapInPandas(run, schema + ", error string")
    return made if keep_errors else made.drop("error")


def saved(contents: DataFrame, folder: str, folders: int = 0) -> DataFrame:
    """path of each file written to the folder from (name, content), by the tasks that hold them. A file is put in its place whole, so a task that runs again does no harm.

    folders: the file's name decides in which of so many numbered folders of the folder it is; none: in the folder itself.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid
        import zlib

        from .pdf import file_system

        system, to = file_system(folder)
        system.create_dir(to)
        made = set()
        for batch in batches:
            paths = [f"{to}/{zlib.crc32(name.encode()) % folders}/{name}" if folders else f"{to}/{name}" for name in batch["name"]]
            for path, content in zip(paths, batch["content"]):
                at = path.rpartition("/")[0]
                if folders and at not in made:
                    system.create_dir(at)
                    made.add(at)
                part = f"{at}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, path)
            yield pd.DataFrame({"path": paths})

    return contents.select("name", "content").mapInPandas(put, "path string")


def docx_paragraphs(path: str, content: bytes) -> list[tuple]:
    """(path, paragraph, text) of the paragraphs of a .docx document with text, for `extracted`; tabs and breaks as characters."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in (x for x in body.iter() if x.tag.endswith("}p")):
        kinds = {"t": None, "tab": "\t", "br": "\n", "cr": "\n"}
        runs = [(x.tag.rpartition("}")[2], x.text or "") for r in p.iter() if r.tag.endswith("}r") for x in r]
        text = "".join(kinds[k] or said for k, said in runs if k in kinds)
        if text.strip():
            out.append((path, len(out) + 1, text))
    return out


#: Number formats that are dates or times; fixed values.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def sheet_rows(path: str, content: bytes) -> list[tuple]:
    """(path, sheet, row, cells, name) of every row with a value of an .xlsx workbook, for `extracted`: its parts are XML in a zip.

    Sheets are numbered in the order of the workbook. Empty cells between others are empty strings; numbers in a date format are ISO dates or times;
    formulas count as the value they had; truth values are TRUE and FALSE.
    """
    import datetime
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    def texts(node) -> str:
        return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))

    def date(number: float) -> str:
        if number < 1:
            return (datetime.datetime(1900, 1, 1) + datetime.timedelta(seconds=round(number * 86400))).strftime("%H:%M:%S")
        day = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=int(number), seconds=round(number % 1 * 86400))
        return day.strftime("%Y-%m-%d" if number % 1 == 0 else "%Y-%m-%d %H:%M:%S")

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        part = lambda name: ElementTree.fromstring(book.read(name)) if name in names else ElementTree.Element("none")
        shared = [texts(s) for s in part("xl/sharedStrings.xml") if s.tag.endswith("}si")]
        styles = part("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in styles.iter() if f.tag.endswith("}numFmt") and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        dated = {k for xfs in styles if xfs.tag.endswith("}cellXfs") for k, f in enumerate(xfs) if int(f.get("numFmtId", 0)) in DATE_FORMATS | own}
        targets = {r.get("Id"): "xl/" + r.get("Target", "").removeprefix("/xl/") for r in part("xl/_rels/workbook.xml.rels")}
        listed = [(s.get("name", ""), next((targets.get(v) for k, v in s.attrib.items() if k.endswith("}id")), None)) for s in part("xl/workbook.xml").iter() if s.tag.endswith("}sheet")]
        sheets = [(n, t) for n, t in listed if t in names] or [("", n) for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.findall("[0-9]+", n)[0]))]
        for number, (name, target) in enumerate(sheets, 1):
            last = 0
            for row in (r for r in part(target).iter() if r.tag.endswith("}row")):
                last = int(row.get("r", last + 1))
                cells: list[str] = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                    value, kind = next((v.text or "" for v in c if v.tag.endswith("}v")), ""), c.get("t", "n")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = texts(c)
                    elif kind == "b" and value:
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind == "n" and value and int(c.get("s", 0)) in dated:
                        value = date(float(value))
                    cells += [""] * (at - len(cells)) + [value]
                if any(cells):
                    out.append((path, number, last, cells, name))
    return out


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages under their marks, in order."""
    marked = F.concat(F.lit("=== 第 "), F.col("page").cast("string"), F.lit(" 页 ===\n"), "text")
    return pages.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", marked.alias("t"))))["t"], "\n").alias("text"))


def _objects(spark: SparkSession, folder: str, schema: str, lines: bool, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=not lines, recursiveFileLookup=True, mode="PERMISSIVE", **options).json(folder)


def json_documents(spark: SparkSession, folder: str, schema: str, lines: bool = False) -> DataFrame:
    """Documents, one JSON object a file (lines: one a line), with `rows`: structured_rows if there are any."""
    docs = _objects(spark, folder, schema, lines)
    return docs.withColumn("rows", F.coalesce("structured_rows", "rows")).drop("structured_rows")


def json_records(spark: SparkSession, folder: str, schema: str, key: str, glob: str = "*.json", lines: bool = False) -> DataFrame:
    """Objects that have the key, one a file (lines: one a line): rules, feedback, audit logs; unreadable ones are left out."""
    return _objects(spark, folder, schema, lines, pathGlobFilter=glob).where(F.col(key).isNotNull())


def json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events, one a line, in files by date; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def append_lines(events: DataFrame, folder: str) -> None:
    """Adds events to the files of their date."""
    events.write.mode("append").partitionBy("date").json(folder)


def save_json(frame: DataFrame, folder: str) -> None:
    frame.write.mode("overwrite").json(folder)


def markdown_rows(columns: list[str]) -> Column:
    """A line of a pipe table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", "\\\\|"), F.lit("")) for c in columns]), F.lit(" |"))


def html_report(summary: DataFrame, title: str, most: int = 10_000) -> str:
    """A page with the rows of an aggregate; an error beyond `most` rows."""
    rows = summary.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    body = rows.to_html(index=False, escape=True)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{body}</body></html>"


def cheapest(providers: DataFrame) -> DataFrame:
    """The configured provider with the lowest price."""
    return providers.where("configured").orderBy("price", "name").limit(1)
