"""Documents from search results: tiers of content, and projections of results and answers to document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ids import answer_document_id, web_document_id

RICH_CHARS = 500


def tiered(results: DataFrame, extracted: DataFrame, scraped: DataFrame, query: str) -> DataFrame:
    """Documents from results (ord, title, url, body, raw_content): raw content from 500 characters on, else the extract, else the
    scrape, else the snippet; results with neither, and without url, are dropped. Rich rows come first (``tier``).

    ``extracted`` and ``scraped`` hold url and content; of repeated urls the last by content hash counts.
    """
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.where("url <> '' AND content <> ''").groupBy("url").agg(F.max_by("content", F.sha1("content")).alias(name))

    r = results.join(one(extracted, "_e"), "url", "left").join(one(scraped, "_s"), "url", "left")
    rich = F.coalesce(F.length("raw_content") >= RICH_CHARS, F.lit(False))
    snippet = F.nullif(F.trim("body"), F.lit(""))
    content = F.when(rich, F.col("raw_content")).otherwise(F.coalesce("_e", "_s", snippet))
    method = F.when(rich, "tavily_raw_content").when(F.col("_e").isNotNull(), "tavily_extract").when(F.col("_s").isNotNull(), "playwright").otherwise("tavily_snippet")
    return r.where("url <> ''").select(
        web_document_id(F.lit(query), F.col("url")).alias("document_id"), "url", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url")).alias("title"),
        content.alias("content"), F.lit("web").alias("source_type"), F.lit(query).alias("query"), method.alias("acquisition_method"), F.when(rich, 0).otherwise(1).alias("tier"), "ord",
    ).where("content IS NOT NULL")


def answers_to_documents(answers: DataFrame) -> DataFrame:
    """Documents from search answers (method, question, content, metadata); empty answers and errors are dropped."""
    kept = answers.where("trim(content) <> '' AND NOT startswith(content, 'Error:')")
    own = F.create_map(F.lit("method"), F.col("method"), F.lit("question"), F.col("question"))
    base = F.map_filter(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin("method", "question"))
    return kept.select(
        answer_document_id(F.col("method"), F.col("question")).alias("document_id"), F.concat(F.lit("graphrag://"), "method").alias("url"), F.substring("question", 1, 80).alias("title"),
        "content", F.lit("graphrag").alias("source_type"), F.col("question").alias("query"), F.concat(F.lit("graphrag_"), "method").alias("acquisition_method"), F.map_concat(base, own).alias("metadata"),
    )


def unseen(paths: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths not met before."""
    return paths.join(seen.select("path").distinct(), "path", "left_anti")


def entity_hints(entities: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """name: entities with a local resource among their documents, in order of lower case, at most ``k``."""
    local = documents.where("source_type = 'local_resource'").select("document_id").distinct()
    named = entities.select(F.trim("canonical_name").alias("name"), F.explode("source_document_ids").alias("document_id")).where("name <> ''")
    return named.join(local, "document_id", "left_semi").select("name").distinct().orderBy(F.lower("name"), "name").limit(k)


def effective_query(query, hint, constraint):
    return F.concat(query, F.coalesce(hint, F.lit("")), F.coalesce(constraint, F.lit("")))
