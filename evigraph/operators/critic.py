"""Candidate contradictions and gaps found by joins: a deterministic stand-in for the model's reading of the triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ids import contradiction_id, gap_id


def split_iteration(triplets: DataFrame, iteration: int) -> tuple[DataFrame, DataFrame]:
    """Triplets of this iteration, and all others, null iterations among these."""
    now = F.col("extraction_iteration").eqNullSafe(F.lit(iteration))
    return triplets.where(now), triplets.where(~now)


def _statements(triplets: DataFrame, name: str) -> DataFrame:
    return triplets.where("subject <> '' AND predicate <> '' AND object <> ''").select("subject", "predicate", F.col("object").alias(name)).distinct()


def candidate_contradictions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """contradiction_id, subject, predicate, claim_a (existing object), claim_b (new object): every pair of differing objects.

    Both sides are reduced to distinct statements before the join, so repeated triplets cost nothing; a (subject, predicate) of
    very many objects is split by adaptive execution. ``contradiction_groups`` counts the pairs without making them.
    """
    pairs = _statements(new, "claim_b").join(_statements(existing, "claim_a"), ["subject", "predicate"]).where("claim_a <> claim_b")
    return pairs.select(contradiction_id(F.col("subject"), F.col("claim_a"), F.col("claim_b")).alias("contradiction_id"), "subject", "predicate", "claim_a", "claim_b")


def contradiction_groups(new: DataFrame, existing: DataFrame) -> DataFrame:
    """subject, predicate, new_objects, existing_objects, pairs (of differing objects), for groups with such a pair."""
    both = _statements(new, "object").withColumn("side", F.lit(1)).unionByName(_statements(existing, "object").withColumn("side", F.lit(2)))
    each = both.groupBy("subject", "predicate", "object").agg(F.sum("side").alias("side"))
    counts = each.groupBy("subject", "predicate").agg(F.count_if(F.col("side") != 2).alias("new_objects"), F.count_if(F.col("side") != 1).alias("existing_objects"), F.count_if(F.col("side") == 3).alias("same"))
    pairs = F.col("new_objects") * F.col("existing_objects") - F.col("same")
    return counts.select("subject", "predicate", "new_objects", "existing_objects", pairs.alias("pairs")).where("pairs > 0")


def candidate_gaps(triplets: DataFrame, entities: DataFrame, prefix: str = "What is known about ") -> DataFrame:
    """gap_id, question for endpoints that the registry lacks (names trimmed)."""
    ends = triplets.select(F.explode(F.array("subject", "object")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()
    known = entities.select(F.trim("canonical_name").alias("name")).distinct()
    question = F.concat(F.lit(prefix), F.col("name"), F.lit("?"))
    return ends.join(known, "name", "left_anti").select(gap_id(question).alias("gap_id"), question.alias("question"))
