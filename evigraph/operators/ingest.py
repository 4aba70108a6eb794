"""File tables to text tables: routing by extension, ignore patterns, shards, chunks, what is up to date."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.ids import stable_filename

# --- Fixed values: extensions by class, in the order of the tests. ---
CODE = ".py .js .ts .tsx .jsx .java .cs .go .rs .c .cpp .cc .cxx .h .hpp .rb .php .swift .kt .scala .sh .bash .ps1 .bat .sql .r .m .lua .Makefile .Dockerfile".split()
EXCEL = ".xls .xlsx .xlsb .xlsm .odf .ods .odt".split()
SLIDES = ".ppsx .pptm".split()
LEGACY_OFFICE = ".doc .ppt .pps".split()
PLAINTEXT = ".md .txt .text .rst .csv .tsv .log .json .yaml .yml .toml .ini .cfg .xml .html .htm".split()
RICH = ".pdf .docx .epub .csv .md .txt .pptx .ipynb .hwp .mbox".split()
SKIP = ".exe .dll .so .dylib .bin .dat .iso .img .dmg .7z .tar .gz .bz2 .xz .db .sqlite .sqlite3 .chm .tn6 .tne".split()
IMAGES = ".jpg .jpeg .png .gif .bmp .tiff .tif .webp".split()
MEDIA = ".svg .ico .heic .heif .mp3 .mp4 .wav .ogg .flac .aac .avi .mov .mkv".split()
# --- End of fixed values. ---
RESOURCE_CHARS, SHARD_CHARS, ARCHIVE_BYTES = 80_000, 200_000, 500_000_000


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; Makefile and Dockerfile are extensions of their own; "" for none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.isin("Makefile", "Dockerfile"), F.concat(F.lit("."), name)).otherwise(F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)))


def route(path: Column, include_code: bool = False, ocr: bool = False) -> Column:
    """Class of the reader for a file."""
    e = extension(path)
    return (
        F.when(e.isin(CODE) & F.lit(include_code), "code").when(e == ".mobi", "mobi").when(e.isin(EXCEL), "excel").when(e == ".zip", "zip").when(e == ".rar", "rar")
        .when(e.isin(SLIDES), "slides").when(e.isin(LEGACY_OFFICE), "legacy_office").when(e.isin(PLAINTEXT), "plain").when(e.isin(RICH), "rich").when(e.isin(CODE), "plain")
        .when(e.isin(SKIP), "skip").when(e.isin(IMAGES), "ocr" if ocr else "skip").when(e.isin(MEDIA), "skip").otherwise("fallback")
    )


def hidden(path: Column) -> Column:
    return F.startswith(F.element_at(F.split(path, "/"), -1), F.lit("."))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a part of the path starts with a match of a glob pattern ("build" also ignores "builder.py")."""
    if not patterns:
        return F.lit(False)
    rules = "|".join(fnmatch.translate(p).removeprefix("(?s:").rsplit(")", 1)[0] for p in patterns)
    return F.exists(F.split(path, "/"), lambda part: part.rlike(f"^(?s:{rules})"))


def shard_rows(docs: DataFrame, key: str, text: str, size: int = SHARD_CHARS) -> DataFrame:
    """key, part (from 1), parts, shard: slices of exactly ``size`` characters; null texts give no rows."""
    s = docs.where(F.col(text).isNotNull()).select(key, T.shards(F.col(text), size).alias("_s"))
    return s.select(key, F.size("_s").alias("parts"), F.posexplode("_s").alias("_i", "shard")).select(key, (F.col("_i") + 1).alias("part"), "parts", "shard")


def chunk_rows(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """key, chunk (from 1), text of each window of white-space tokens; null texts give no rows."""
    c = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(T.token_chunks(F.col(text), size, overlap)).alias("_i", "chunk_text"))
    return c.select(key, (F.col("_i") + 1).alias("chunk"), "chunk_text")


def line_parts(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, part, part_text: lines packed greedily to at most ``limit`` characters."""
    p = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(T.line_groups(F.col(text), limit)).alias("_i", "part_text"))
    return p.select(key, (F.col("_i") + 1).alias("part"), "part_text")


def metadata_header(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.lit("Source: "), name, F.lit("\nPath: "), path, F.lit("\nFormat: "), F.regexp_replace(extension(path), r"^\.", ""), F.lit("\n---\n\n"))


def stale(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sources (path, modified) without an output (name, modified) at least as new, by stable file name."""
    o = outputs.groupBy("name").agg(F.max("modified").alias("_out"))
    s = sources.withColumn("_name", stable_filename(F.col("path")))
    return s.join(o, s["_name"] == o["name"], "left").where("_out IS NULL OR modified > _out").drop("_name", "name", "_out")


def split_schedule(chunk_size: Column) -> Column:
    """First limit of shards: four chunks, at least 2,000 characters."""
    return F.greatest(F.lit(2000), chunk_size * 4)


def next_limit(limit: int) -> int:
    """Half the limit, at least 800."""
    return max(800, limit // 2)
