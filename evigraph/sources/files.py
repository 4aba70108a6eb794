"""File sources: text resources, corpus files by class of reader, archives, table and configuration files.

Files are read by Spark's binaryFile source; formats that need a parser run in Arrow batches on the executors with what
Python's standard library offers. Optical recognition, legacy office formats and the like are callables to plug in.
"""

from __future__ import annotations

import email
import email.policy
import html
import io
import json
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.ids import resource_document_id, stable_filename
from evigraph.functions.text import looks_binary
from evigraph.operators import ingest
from evigraph.schemas import empty

#: Extensions of text resources.
RESOURCES = ["md", "txt", "text", "rst", "csv", "tsv", "log"]
SHEET_ROWS = 2000


def binary_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, modified_after: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files below a folder; filters on names and times reach the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(folder).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def text_of(content):
    """Bytes as UTF-8, undecodable ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def load_resources(spark: SparkSession, folder: str, cap: int = ingest.RESOURCE_CHARS) -> DataFrame:
    """Document rows of the text files below a folder: blank ones dropped, at most ``cap`` characters each."""
    f = binary_files(spark, folder, RESOURCES)
    text = F.substring(text_of(F.col("content")), 1, cap)
    name = F.element_at(F.split("path", "/"), -1)
    meta = F.create_map(F.lit("original_path"), F.col("path"))
    return f.select(
        resource_document_id(F.col("path"), F.col("modificationTime").cast("string")).alias("document_id"), F.concat(F.lit("file://"), "path").alias("url"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"),
        text.alias("content"), F.lit("local_resource").alias("source_type"), F.lit("").alias("query"), F.col("modificationTime").alias("retrieved_at"), F.lit("file_read").alias("acquisition_method"), meta.alias("metadata"),
    ).where(r"content RLIKE '\\S'")


def corpus_files(spark: SparkSession, folder: str, include_code: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """path, modificationTime, length, content, class, name (stable) of the files that are not hidden or ignored."""
    f = binary_files(spark, folder)
    f = f.where(~ingest.hidden(F.col("path")) & ~ingest.ignored(F.regexp_replace("path", "^" + re.escape(folder.rstrip("/")) + "/", ""), ignore or []))
    return f.withColumn("class", ingest.route(F.col("path"), include_code)).withColumn("name", stable_filename(F.col("path")))


# --- readers of formats ----------------------------------------------------------------------------------------------------
def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and file of each worksheet in the workbook's order, by the workbook's relationships; by number where it has none."""
    sheets = [s for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
    have = set(z.namelist())
    targets: dict[str, str] = {}
    if "xl/_rels/workbook.xml.rels" in have:
        targets = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if "Id" in r.attrib}
    out = []
    for i, s in enumerate(sheets, 1):
        ref = next((v for k, v in s.attrib.items() if k.rsplit("}", 1)[-1] == "id" and "}" in k), "")
        target = targets.get(ref, f"worksheets/sheet{i}.xml")
        out.append((s.attrib.get("name", ""), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return [(name, file) for name, file in out if file in have]


def read_xlsx(data: bytes, max_chars: int = ingest.SHARD_CHARS) -> str | None:
    """"## Sheet: name" and tab-separated rows of each sheet that is not empty; SHEET_ROWS rows a sheet, sheets until ``max_chars``."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    parts, total = [], 0
    for name, file in _sheets(z):
        if total >= max_chars:
            break
        lines = []
        for row in (r for r in ET.fromstring(z.read(file)).iter() if _tag(r) == "row"):
            if len(lines) >= SHEET_ROWS:
                break
            cells: list[str] = []
            for c in row:
                letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                cells += [""] * (at - len(cells))
                v = next((x.text or "" for x in c if _tag(x) == "v"), "".join(t.text or "" for t in c.iter() if _tag(t) == "t"))
                cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
            lines.append("\t".join(cells))
        if lines:
            parts.append(f"## Sheet: {name}\n" + "\n".join(lines))
            total += len(parts[-1])
    return "\n\n".join(parts) or None


def read_slides(data: bytes) -> str | None:
    """"## Slide i" and the non-blank text of its shapes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    files = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    parts = []
    for i, file in enumerate(files, 1):
        shapes = ["\n".join("".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in body.iter() if _tag(p) == "p") for body in ET.fromstring(z.read(file)).iter() if _tag(body) == "txBody"]
        text = "\n".join(s for s in shapes if s.strip())
        if text:
            parts.append(f"## Slide {i}\n{text}")
    return "\n\n".join(parts) or None


def read_docx(data: bytes) -> str | None:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in root.iter() if _tag(p) == "p") or None


def read_notebook(data: bytes) -> str | None:
    return "\n\n".join("".join(c.get("source", [])) for c in json.loads(data).get("cells", [])) or None


def _plain(html_text: str) -> str | None:
    """Text of HTML: no scripts and styles, tags to spaces, entities read, white space collapsed."""
    bare = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html_text))
    return re.sub(r"\s+", " ", html.unescape(bare)).strip() or None


def _palmdoc(data: bytes) -> bytes:
    """One record of PalmDOC compression: literals, runs of literals, back references and spaces joined to a letter."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, length = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                continue
            for _ in range(length):
                out.append(out[-back])
    return bytes(out)


def read_mobi(data: bytes) -> str | None:
    """Text of a Palm database book, stored plainly or by PalmDOC; null for other compressions, encrypted books and other data."""
    if len(data) < 86 or data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        return None
    records = int.from_bytes(data[76:78], "big")
    offsets = [int.from_bytes(data[78 + 8 * i : 82 + 8 * i], "big") for i in range(records)] + [len(data)]
    if records < 2 or sorted(offsets) != offsets:
        return None
    head = data[offsets[0] : offsets[1]]
    kind, count, locked = (int.from_bytes(head[a:b], "big") for a, b in ((0, 2), (8, 10), (12, 14)))
    if kind not in (1, 2) or locked:
        return None
    mobi = head[16:20] == b"MOBI" and len(head) >= 32
    encoding = "utf-8" if mobi and int.from_bytes(head[28:32], "big") == 65001 else "cp1252"
    flags = int.from_bytes(head[242:244], "big") if mobi and len(head) >= 244 else 0
    parts = []
    for i in range(1, min(count, records - 1) + 1):
        r = data[offsets[i] : offsets[i + 1]]
        for _ in range((flags >> 1).bit_count()):  # entries behind the text, each of which ends in its own size
            size = shift = 0
            for b in reversed(r[-4:]):
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            r = r[: len(r) - size] if 0 < size <= len(r) else r
        if flags & 1 and r:
            r = r[: len(r) - (r[-1] & 3) - 1]
        parts.append(_palmdoc(r) if kind == 2 else r)
    return _plain(b"".join(parts).decode(encoding, "replace"))


def read_epub(data: bytes) -> str | None:
    """Text of the pages of an e-book in the order of its spine (by name where it has none)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    pages = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    package = next((n for n in z.namelist() if n.lower().endswith(".opf")), None)
    if package:
        root = ET.fromstring(z.read(package))
        items = {e.attrib.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), e.attrib.get("href", ""))) for e in root.iter() if _tag(e) == "item"}
        pages = [items[e.attrib["idref"]] for e in root.iter() if _tag(e) == "itemref" and items.get(e.attrib.get("idref")) in set(z.namelist())] or pages
    return "\n\n".join(t for p in pages if (t := _plain(z.read(p).decode("utf-8", "replace")))) or None


def read_mbox(data: bytes) -> str | None:
    """Subject, sender and text of each message of a mailbox."""
    out = []
    for raw in re.split(rb"(?m)^From [^\n]*\n", data):
        if not raw.strip():
            continue
        m = email.message_from_bytes(raw, policy=email.policy.default)
        body = m.get_body(("plain", "html"))
        text = body.get_content() if body else ""
        out.append("\n".join(x for x in (m["subject"] and f"Subject: {m['subject']}", m["from"] and f"From: {m['from']}", (_plain(text) if body and body.get_content_subtype() == "html" else text.strip())) if x))
    return "\n\n".join(filter(None, out)) or None


def read_open_document(data: bytes) -> str | None:
    """Paragraphs of a text document, or "## Sheet: name" and tab-separated rows of a spreadsheet."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    tables = [t for t in root.iter() if _tag(t) == "table" and any(_tag(x) == "spreadsheet" for x in root.iter())]
    if not tables:
        return "\n".join("".join(p.itertext()) for p in root.iter() if _tag(p) in ("p", "h")) or None
    parts = []
    for t in tables:
        rows = ["\t".join("".join(c.itertext()) for c in r if _tag(c) == "table-cell").rstrip("\t") for r in t.iter() if _tag(r) == "table-row"]
        lines = [r for r in rows if r][:SHEET_ROWS]
        if lines:
            name = next((v for k, v in t.attrib.items() if k.rsplit("}", 1)[-1] == "name"), "")
            parts.append(f"## Sheet: {name}\n" + "\n".join(lines))
    return "\n\n".join(parts) or None


READERS: dict[str, Callable[[bytes], str | None]] = {".xlsx": read_xlsx, ".xlsm": read_xlsx, ".ppsx": read_slides, ".pptm": read_slides, ".pptx": read_slides, ".docx": read_docx, ".ipynb": read_notebook, ".mobi": read_mobi, ".epub": read_epub, ".mbox": read_mbox, ".odt": read_open_document, ".ods": read_open_document}


def expand_zip(data: bytes, limit: int = ingest.ARCHIVE_BYTES, depth: int = 3) -> Iterator[tuple[str, bytes]]:
    """Members of an archive, archives in it included; nothing for an invalid one or one of more declared bytes than ``limit``."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    if sum(i.file_size for i in z.infolist()) > limit:
        return
    for i in z.infolist():
        name = os.path.basename(i.filename)
        if i.is_dir() or not name or name.startswith("."):
            continue
        body = z.read(i)
        if name.lower().endswith(".zip") and depth > 1:
            for inner, b in expand_zip(body, limit, depth - 1):
                yield f"{i.filename}!{inner}", b
        else:
            yield i.filename, body


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, modified, content in zip(f["path"], f["modificationTime"], f["content"]):
            rows = [(f"{path}!{n}", modified, len(b), b) for n, b in expand_zip(bytes(content))]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "modificationTime", "length", "content"])


def _read_with(readers: dict[str, Callable[[bytes], str | None]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                reader = readers.get(os.path.splitext(path)[1].lower())
                try:
                    rows.append((path, reader(bytes(content)) if reader else None))
                except Exception:  # one broken file must not end the corpus
                    rows.append((path, None))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return run


def converted_documents(spark: SparkSession, folder: str, include_code: bool = False, readers: dict[str, Callable[[bytes], str | None]] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """source_path, target_path, title, format, text, char_count of every file that gives text; archives are expanded.

    ``readers`` adds or replaces readers by extension (PDF, optical recognition, e-books ...). Unreadable files give no row.
    """
    files = corpus_files(spark, folder, include_code, ignore)
    inner = files.where("class = 'zip'").select("path", "modificationTime", "content").mapInPandas(_expand, "path string, modificationTime timestamp, length long, content binary")
    inner = inner.withColumn("class", ingest.route(F.col("path"), include_code)).withColumn("name", stable_filename(F.col("path")))
    every = files.where("class <> 'zip'").unionByName(inner.where("class <> 'zip'")).where("class <> 'skip'")
    plain = every.where("class IN ('plain', 'fallback', 'code')").select("path", "name", "class", text_of(F.col("content")).alias("text"))
    plain = plain.where((F.col("class") != "fallback") | ~looks_binary(F.col("text")))
    rich = every.where("class NOT IN ('plain', 'fallback', 'code')")
    read = rich.select("path", "content").mapInPandas(_read_with(READERS | (readers or {})), "path string, text string")
    rich = rich.select("path", "name", "class").join(read, "path")
    both = plain.unionByName(rich).where(r"text RLIKE '\\S'")
    label = F.when(F.col("class").isin("excel", "code", "ocr"), F.col("class")).when(F.col("class") == "slides", "pptx").when(F.col("class") == "fallback", "txt").otherwise(F.regexp_replace(ingest.extension(F.col("path")), r"^\.", ""))
    full = F.concat(ingest.metadata_header(F.col("path")), "text")
    return both.select(F.col("path").alias("source_path"), F.col("name").alias("target_path"), F.element_at(F.split("path", "[/!]"), -1).alias("title"), label.alias("format"), full.alias("text"), F.length("text").alias("char_count"))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), sha256 of files that are not hidden."""
    f = binary_files(spark, folder).where(~ingest.hidden(F.col("path")))
    return f.select(F.regexp_replace("path", "^" + re.escape(folder.rstrip("/")) + "/", "").alias("path"), F.sha2("content", 256).alias("sha256"))


# --- tables and small files ------------------------------------------------------------------------------------------------
def _fs_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


INDEX_TABLES = ["entities", "communities", "community_reports", "text_units", "relationships", "covariates"]


class TableProvider:
    """Parquet tables in a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def has(self, name: str) -> bool:
        return _fs_exists(self.spark, self.path(name))

    def list(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")) if fs.exists(p) else []

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise ValueError(f"no table {name!r} in {self.folder}")
        return self.spark.read.parquet(self.path(name))

    def read_or_empty(self, name: str) -> DataFrame:
        return self.read(name) if self.has(name) else empty(self.spark, name)

    def index_tables(self) -> dict[str, DataFrame]:
        return {n: self.read_or_empty(n) for n in INDEX_TABLES}

    def rows(self, name: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        return transform(self.read(name)) if transform else self.read(name)

    def write(self, name: str, df: DataFrame, truncate: bool = True) -> None:
        """Overwrite, or append with missing columns filled. An empty append to no table makes no file."""
        if truncate:
            df.write.mode("overwrite").parquet(self.path(name))
        elif self.has(name):
            have = self.read(name)
            df.unionByName(have.limit(0), allowMissingColumns=True).write.mode("append").parquet(self.path(name))
        elif df.limit(1).count():
            df.write.parquet(self.path(name))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def has_row(self, name: str, column: str, value) -> bool:
        return bool(self.read(name).where(F.col(column) == F.lit(value)).limit(1).count())


def output_folder(folder: str) -> str:
    """folder/output if it exists, else the folder itself if it holds entities, else folder/output."""
    if os.path.isdir(f"{folder}/output"):
        return f"{folder}/output"
    return folder if os.path.exists(f"{folder}/entities.parquet") else f"{folder}/output"


def usage_history(spark: SparkSession, path: str, key_tail: str, n: int = 20) -> DataFrame:
    """The last ``n`` rows of one key of a JSON-lines file; blank and broken lines are skipped."""
    from evigraph.operators.usage import tail
    from evigraph.schemas import schema

    rows = spark.read.schema(schema("usage_history")).option("mode", "DROPMALFORMED").json(path)
    return tail(rows.where(F.col("key_tail") == key_tail), "key_tail", ["timestamp"], n)


def dotenv(path: str) -> dict[str, str]:
    """key=value lines; the first value of a key stands, comments and blank lines are skipped."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        for line in open(path, encoding="utf-8"):
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out


def topic_folder(folder: str) -> dict[str, str | None]:
    """Files of a topic by convention: requirements.md, else topic.md, else the first other Markdown file, else the folder's name."""
    names = sorted(os.listdir(folder))
    markdown = [n for n in names if n.endswith(".md") and n.lower() != "readme.md"]
    chosen = next((n for n in ("requirements.md", "topic.md") if n in markdown), markdown[0] if markdown else None)
    at = lambda *p: os.path.join(folder, *p) if os.path.exists(os.path.join(folder, *p)) else None
    return {"requirements": os.path.join(folder, chosen) if chosen else None, "query": None if chosen else os.path.basename(folder.rstrip("/")).replace("-", " ").replace("_", " "), "prompts": at("prompts"), "resources": at("resources"), "settings": at("graphrag", "settings.yaml")}
