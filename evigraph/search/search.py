"""Search over the index tables: basic (text or vectors), local, global and drift.

The reference delegates ranking to an external index; the rankings here are our own, documented ones. Errors are answers
that start with "Error:".
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators import graph

WORD = r"[^\p{L}\p{N}]+"


def terms(question: str) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", question.lower()) if len(w) > 2})


def lexical_score(text, question: str):
    """Share of the question's words that occur in a text, as a column."""
    asked = terms(question)
    if not asked:
        return F.lit(0.0)
    words = F.array_distinct(F.split(F.lower(text), WORD))
    return F.size(F.array_intersect(words, F.array(*map(F.lit, asked)))) / len(asked)


def _blocks(size: int):
    def run(frames):
        for f in frames:
            for start in range(0, len(f), size):
                part = f.iloc[start : start + size]
                v = [np.asarray(x, np.float64) for x in part["v"]]
                keep = [i for i, x in enumerate(v) if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0]
                for width in {len(v[i]) for i in keep}:
                    at = [i for i in keep if len(v[i]) == width]
                    m = np.stack([v[i] / np.linalg.norm(v[i]) for i in at])
                    yield pd.DataFrame({"width": [width], "ids": [part["k"].to_numpy()[at]], "values": [m.reshape(-1)]})

    return run


def _best(k: int):
    def run(frames):
        for f in frames:
            for width, q_ids, q, ids, v in zip(f["width"], f["q_ids"], f["q_values"], f["ids"], f["values"]):
                scores = np.round(np.asarray(q).reshape(-1, width) @ np.asarray(v).reshape(-1, width).T, 9)
                ids = np.asarray(ids)
                for query, row in zip(q_ids, scores):
                    best = np.lexsort((ids, -row))[:k]
                    yield pd.DataFrame({"query_id": query, "id": ids[best], "score": row[best]})

    return run


def vector_top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, block: int = 256) -> DataFrame:
    """query_id, key, rank by cosine similarity (9 places; ties by key) of a stated query set against all rows; keys are whole numbers.

    Both sides are packed into blocks of vectors. Blocks of rows fall into parts, as many as shuffle partitions; blocks of the
    query set are sent to each part, so no task gets all rows and nothing is broadcast. Each pair of blocks is one matrix
    product, and of it each query keeps its best ``k``, before anything is shuffled by query. Null, empty and zero vectors are
    left out; so are pairs of other widths.
    """
    def packed(df: DataFrame, size: int) -> DataFrame:
        base = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
        return base.mapInPandas(_blocks(size), "width int, ids array<long>, values array<double>")

    q = packed(queries, block).withColumnsRenamed({"ids": "q_ids", "values": "q_values"})
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed(vectors, 1024).withColumn("part", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(parts)).cast("int"))
    sent = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = sent.join(rows.hint("shuffle_merge"), ["width", "part"]).select("width", "q_ids", "q_values", "ids", "values")
    scored = pairs.mapInPandas(_best(k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "rank")


def basic(units: DataFrame, question: str, k: int = 10) -> DataFrame:
    """id, score: text units by the share of the question's words they hold; ties by id."""
    s = units.select("id", F.round(lexical_score(F.col("text"), question), 6).alias("score")).where("score > 0")
    return s.orderBy(F.desc("score"), "id").limit(k)


def local(entities: DataFrame, triplets: DataFrame, documents: DataFrame, question: str, k_entities: int = 8, k_triplets: int = 20) -> DataFrame:
    """Entities near the question, the triplets at them, the documents behind these: entity, triplet_id, statement, document_id, title, score."""
    label = F.concat_ws(" ", "canonical_name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "description")
    near = entities.where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("entity"), F.round(lexical_score(label, question), 6).alias("score")).where("score > 0")
    near = near.groupBy("entity").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "entity").limit(k_entities)
    ends = triplets.select("triplet_id", "subject", "predicate", "object", "source_document_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    hit = ends.join(F.broadcast(near), "entity")  # k_entities rows
    best = hit.groupBy("triplet_id").agg(F.max_by(F.struct("entity", "subject", "predicate", "object", "source_document_id", "confidence", "score"), F.struct("score", "confidence", "entity", "subject", "object")).alias("t")).select("triplet_id", "t.*")
    best = best.orderBy(F.desc("score"), F.desc("confidence"), "triplet_id").limit(k_triplets)
    d = documents.groupBy("document_id").agg(F.min("title").alias("title"))
    return best.join(d, best["source_document_id"] == d["document_id"], "left").select("entity", "triplet_id", F.concat_ws(" ", "subject", "predicate", "object").alias("statement"), F.col("source_document_id").alias("document_id"), "title", "score")


def community_reports(members: DataFrame, triplets: DataFrame, cap: int = 5) -> DataFrame:
    """community, level, size, title (its best connected member), summary (its strongest statements, ``cap`` at most), rank (its share of members)."""
    d = graph.degrees(triplets)
    m = members.join(d, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    base = m.groupBy("level", "community").agg(F.count("*").alias("size"), F.max_by("name", F.struct("degree", "name")).alias("title"))
    e = graph.edges(triplets).select("source", "target", "weight", F.array_join("predicates", "/").alias("p"))
    inside = e.join(members.withColumnRenamed("name", "source"), "source").select("level", "community", "weight", F.concat_ws(" ", "source", "p", "target").alias("s"))
    i = F.row_number().over(Window.partitionBy("level", "community").orderBy(F.desc("weight"), "s"))
    lines = inside.withColumn("i", i).where(F.col("i") <= cap).groupBy("level", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "; ").alias("summary"))
    total = members.groupBy("level").agg(F.count("*").alias("n"))
    return base.join(lines, ["level", "community"], "left").join(total, "level").select("community", "level", "size", "title", F.coalesce("summary", F.lit("")).alias("summary"), F.round(F.col("size") / F.col("n"), 6).alias("rank"))


def global_search(reports: DataFrame, question: str, community_level: int, k: int = 10) -> DataFrame:
    """community, level, title, score: reports down to a level by words of the question and rank."""
    s = reports.where(F.col("level") <= community_level).withColumn("score", F.round(lexical_score(F.concat_ws(" ", "title", "summary"), question), 6))
    return s.where("score > 0").orderBy(F.desc("score"), F.desc("rank"), "level", "community").limit(k).select("community", "level", "title", "score")


def drift(reports: DataFrame, entities: DataFrame, triplets: DataFrame, documents: DataFrame, question: str, community_level: int = 2, rounds: int = 2) -> DataFrame:
    """A global primer whose titles widen the question, then local searches: their rows with the round they came in first."""
    out, asked = None, question
    for i in range(rounds):
        titles = [r["title"] for r in global_search(reports, asked, community_level, 3).collect()]  # three rows
        found = local(entities, triplets, documents, asked).withColumn("round", F.lit(i))
        out = found if out is None else out.unionByName(found.join(out.select("triplet_id").distinct(), "triplet_id", "left_anti").select(*found.columns))
        asked = " ".join([question, *titles])
    return out


METHODS = ("local", "global", "drift", "basic")


def answer(spark, method: str, question: str, tables: dict[str, DataFrame], community_level: int = 2) -> DataFrame:
    """content, method, question of one answer; unknown methods and empty indexes give an error as content."""
    def one(content: str) -> DataFrame:
        return spark.createDataFrame([(content, method, question)], "content string, method string, question string")

    if method not in METHODS:
        return one(f"Error: unknown method {method!r}")
    if "entities" not in tables or not tables["entities"].limit(1).count():
        return one("Error: the index is empty")
    e, t, d = tables["entities"], tables["triplets"], tables["documents"]
    if method == "basic":
        found = basic(tables["text_units"], question).select("score", F.col("id").alias("line"))
    elif method == "local":
        found = local(e, t, d, question).select("score", F.col("statement").alias("line"))
    elif method == "global":
        found = global_search(tables["community_reports"], question, community_level).select("score", F.col("title").alias("line"))
    else:
        found = drift(tables["community_reports"], e, t, d, question, community_level).select("score", F.col("statement").alias("line"))
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "line"))), lambda x: x["line"]), "\n").alias("content")).select("content", F.lit(method).alias("method"), F.lit(question).alias("question"))
