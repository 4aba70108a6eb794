"""A fast index build: text units, entities, relationships, communities and reports from documents, without a model.

Entities are runs of capitalised words in the text units; two that follow each other in a unit are related, so a unit of k
mentions gives k - 1 relations, not k x k. Everything is expressions and joins; each table is written once and read on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.operators import graph, ingest
from evigraph.search import search
from evigraph.sources.files import TableProvider

#: A run of capitalised words.
MENTION = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"
TABLES = ("text_units", "entities", "relationships", "communities", "community_reports")


def text_units(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """id (hash of key and chunk), document_id, chunk, text of each window of white-space tokens."""
    c = ingest.chunk_rows(docs, key, text, size, overlap)
    return c.select(F.sha1(F.concat_ws("\u0001", F.col(key).cast("string"), F.col("chunk").cast("string"))).alias("id"), F.col(key).cast("string").alias("document_id"), "chunk", F.col("chunk_text").alias("text"))


def mentions(units: DataFrame) -> DataFrame:
    """unit, pos (from 0), title of each mention."""
    return units.select(F.col("id").alias("unit"), F.posexplode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("pos", "title"))


def index_entities(units: DataFrame) -> DataFrame:
    """title, frequency (mentions), units (text units that hold it)."""
    each = mentions(units).groupBy("title", "unit").agg(F.count("*").alias("n"))
    return each.groupBy("title").agg(F.sum("n").alias("frequency"), F.count("*").alias("units"))


def index_relationships(units: DataFrame) -> DataFrame:
    """source < target, weight: how often the two follow each other in a unit."""
    after = F.lead("title").over(Window.partitionBy("unit").orderBy("pos"))
    pairs = mentions(units).withColumn("next", after).where("next IS NOT NULL AND next <> title")
    return pairs.groupBy(F.least("title", "next").alias("source"), F.greatest("title", "next").alias("target")).agg(F.count("*").alias("weight"))


def build(spark: SparkSession, docs: DataFrame, folder: str, key: str = "document_id", text: str = "content", size: int = 1200, overlap: int = 100) -> list[tuple[str, str | None]]:
    """Builds the tables of ``folder`` step by step: (step, error or None) of each; the first error ends it."""
    t = TableProvider(spark, folder)
    pairs = lambda: t.read("relationships").select("source", "target")
    triplets = lambda: t.read("relationships").select(F.col("source").alias("subject"), F.lit("related to").alias("predicate"), F.col("target").alias("object"), F.lit(None).cast("string").alias("triplet_id"), F.lit(None).cast("string").alias("source_document_id"))
    steps: list[tuple[str, Callable[[], DataFrame]]] = [
        ("text_units", lambda: text_units(docs, key, text, size, overlap)),
        ("relationships", lambda: graph.finalize_relationships(index_relationships(t.read("text_units")))),
        ("entities", lambda: graph.finalize_entities(index_entities(t.read("text_units")), pairs())),
        ("communities", lambda: graph.communities(pairs())),
        ("community_reports", lambda: search.community_reports(t.read("communities"), triplets())),
    ]
    out: list[tuple[str, str | None]] = []
    for name, make in steps:
        try:
            t.write(name, make())
            out.append((name, None))
        except Exception as e:  # the outcome of a step is data here
            out.append((name, f"{type(e).__name__}: {e}".split("\n")[0]))
            break
    return out


def outcome(steps: DataFrame) -> DataFrame:
    """One row of an index run's steps (step, error): completed, failed, errors (joined by "; ", in order of step)."""
    failed = F.col("error").isNotNull()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("step", "error")))), lambda x: F.concat(x["step"], F.lit(": "), x["error"])), "; ")
    return steps.agg(F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"), joined.alias("errors"))


def command_arguments(processes: DataFrame) -> DataFrame:
    """pid, root, method, command_line of processes whose command (pid, command) is an index run: values of --root and --method, quoted or bare."""
    value = lambda name: F.nullif(F.regexp_replace(F.regexp_extract("command", rf'--{name}[ =]("[^"]*"|\S+)', 1), '"', ""), F.lit(""))
    return processes.where(F.col("command").rlike(r"\bindex\b.*--root[ =]")).select("pid", value("root").alias("root"), value("method").alias("method"), F.col("command").alias("command_line"))


def model_names(lines: DataFrame) -> DataFrame:
    """name: distinct models of a listing (line): the first word of each line but the heading."""
    return lines.select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias("name")).where("name <> '' AND name <> 'NAME'").distinct()


def group_parts(parts: DataFrame) -> DataFrame:
    """path, text of files read in parts (path, part, text): non-blank parts in order, joined by blank lines."""
    kept = parts.where(r"text RLIKE '\\S'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("ps"))
    return kept.select("path", F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text"))


def truncated_code(files: DataFrame, limit: int) -> DataFrame:
    """path, text: code files cut at ``limit`` characters, which is what this writer is for."""
    return files.where("text IS NOT NULL").select("path", F.substring("text", 1, limit).alias("text"))


def part_files(docs: DataFrame, limit: int = ingest.SHARD_CHARS) -> DataFrame:
    """name, text of the files a converted document (path, text) is written as: a header, and _partN names where it takes several."""
    base = ingest.stable_filename(F.col("path"))
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    rows = ingest.shard_rows(docs.withColumn("_path", F.col("path")), "_path", "text", limit).withColumn("path", F.col("_path"))
    named = F.when(F.col("parts") > 1, F.concat(stem, F.lit("_part"), F.col("part").cast("string"), F.lit(".txt"))).otherwise(F.concat(stem, F.lit(".txt")))
    return rows.select(named.alias("name"), F.concat(ingest.metadata_header(F.col("path")), F.col("shard")).alias("text"))
