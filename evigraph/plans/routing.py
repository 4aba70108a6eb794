"""Metrics of a run and the decision after each iteration, as expressions over one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.synthesis import PRIORITY, rank_of

SATURATION = 0.10


def run_metrics(entities: DataFrame, triplets: DataFrame, contradictions: DataFrame, gaps: DataFrame, previous_triplets: int = 0) -> DataFrame:
    """One row of counts. Open is what is not resolved, accepted uncertainty included."""
    t = triplets.agg(F.count("*").alias("triplet_count"))
    e = entities.agg(F.count("*").alias("entity_count"))
    c = contradictions.agg(F.count_if(F.col("status") != "resolved").alias("open_contradiction_count"), F.count_if((F.col("status") != "resolved") & (F.col("severity") == "high")).alias("high_severity_contradiction_count"))
    g = gaps.agg(F.count_if(F.col("status") != "resolved").alias("open_gap_count"))
    one = t.crossJoin(e).crossJoin(c).crossJoin(g)  # one row each
    new = F.greatest(F.col("triplet_count") - previous_triplets, F.lit(0))
    ratio = F.when(F.lit(previous_triplets) > 0, new / F.greatest(F.lit(previous_triplets), F.lit(1))).when(F.col("triplet_count") > 0, 1.0).otherwise(0.0)
    return one.withColumn("new_triplets_last_iteration", new).withColumn("graph_growth_ratio", F.round(ratio, 6))


def growth_by_iteration(triplets: DataFrame) -> DataFrame:
    """extraction_iteration, new_triplets, triplet_count, growth_ratio, stable. The window is over iterations, not triplets."""
    per = triplets.groupBy(F.coalesce("extraction_iteration", F.lit(0)).alias("extraction_iteration")).agg(F.count("*").alias("new_triplets"))
    w = Window.orderBy("extraction_iteration")
    total = F.sum("new_triplets").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("new_triplets").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ratio = F.when(before > 0, F.round(F.col("new_triplets") / before, 6)).otherwise(1.0)
    return per.select("extraction_iteration", "new_triplets", total.alias("triplet_count"), ratio.alias("growth_ratio")).withColumn("stable", F.col("growth_ratio") <= SATURATION)


def open_conflict(contradictions: DataFrame) -> DataFrame:
    """At most one row: the first open contradiction of high severity by id."""
    c = contradictions.where("status <> 'resolved' AND severity = 'high'")
    text = F.concat(F.lit("Verify conflicting claims about "), F.trim("topic"), F.lit(": "), F.trim("claim_a"), F.lit(" vs "), F.trim("claim_b"))
    return c.orderBy("contradiction_id").limit(1).select("contradiction_id", text.alias("conflict_query"))


def open_gap(gaps: DataFrame) -> DataFrame:
    """At most one row: the open gap of the highest priority, first by id."""
    return gaps.where("status <> 'resolved'").orderBy(rank_of("priority", PRIORITY), "gap_id").limit(1).select("gap_id", F.trim("question").alias("gap_query"))


def should_continue(metrics: DataFrame, contradictions: DataFrame, gaps: DataFrame, iteration: int, max_iterations: int, query: str, conflicts: bool = True, gap_resolution: bool = True, saturation: float = SATURATION) -> DataFrame:
    """One row: route, reason, target_query, contradiction_id, gap_id. Cap, conflict, gap, saturation, in this order."""
    none = F.lit(None).cast("string")
    c = metrics.agg(F.max("graph_growth_ratio").alias("ratio"))
    con = open_conflict(contradictions).agg(F.max("contradiction_id").alias("con"), F.max("conflict_query").alias("conq"))
    gap = open_gap(gaps).agg(F.max("gap_id").alias("gap"), F.max("gap_query").alias("gapq"))
    one = c.crossJoin(con).crossJoin(gap)  # one row each
    capped = F.lit(iteration >= max_iterations)
    conflict = ~capped & F.lit(conflicts) & F.col("con").isNotNull()
    is_gap = ~capped & ~conflict & F.lit(gap_resolution) & F.col("gap").isNotNull()
    stable = ~capped & ~conflict & ~is_gap & (F.col("ratio") <= saturation)
    return one.select(
        F.when(capped, "finalize").when(conflict, "resolve_conflict").when(is_gap, "resolve_gap").when(stable, "finalize").otherwise("continue_research").alias("route"),
        F.when(capped, "iteration limit reached").when(conflict, "open high-severity contradiction requires verification").when(is_gap, "open research gap requires targeted follow-up")
        .when(stable, "graph growth is below the saturation threshold").otherwise("graph is still growing and no blocking conflict or gap remains").alias("reason"),
        F.when(conflict, F.col("conq")).when(is_gap, F.col("gapq")).when(capped | stable, none).otherwise(F.lit(query)).alias("target_query"),
        F.when(conflict, F.col("con")).alias("contradiction_id"), F.when(is_gap, F.col("gap")).alias("gap_id"),
    )
