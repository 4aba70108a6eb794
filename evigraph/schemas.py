"""Schemas of the relations, their defaults and allowed values, and conforming a DataFrame to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "documents": "document_id string, url string, title string, content string, source_type string, query string, retrieved_at timestamp, acquisition_method string, metadata map<string,string>",
    "entities": "canonical_name string, type string, aliases array<string>, description string, evidence_refs array<string>, source_document_ids array<string>, confidence double",
    "triplets": "triplet_id string, subject string, predicate string, object string, evidence string, source_document_id string, source_url string, confidence double, extraction_iteration int",
    "contradictions": "contradiction_id string, topic string, claim_a string, claim_b string, evidence_a string, evidence_b string, source_document_id_a string, source_document_id_b string, severity string, status string, resolution_notes string",
    "research_gaps": "gap_id string, question string, trigger string, priority string, status string, created_iteration int, resolved_iteration int",
    "route_history": "iteration int, route string, reason string, target string, timestamp timestamp",
    "relationships": "source string, target string, combined_degree long, human_readable_id long, id string",
    "search_results": "title string, url string, body string, raw_content string",
    "usage_history": "timestamp string, key_tail string, source string, key_usage long, credits_used long, credits_limit long, credits_remaining long",
    "communities": "community long, level int, title string",
    "community_reports": "community long, level int, title string, summary string, rank double",
    "text_units": "id string, text string, document_id string",
    "covariates": "id string, subject_id string, description string",
}
DEFAULTS = {
    "documents": {"source_type": "web", "acquisition_method": "unknown"},
    "triplets": {"extraction_iteration": 0},
    "contradictions": {"severity": "low", "status": "open"},
    "research_gaps": {"priority": "medium", "status": "open", "created_iteration": 0},
}
ALLOWED = {
    "contradictions": {"severity": ["low", "high"], "status": ["open", "investigating", "resolved", "accepted_uncertainty"]},
    "research_gaps": {"priority": ["low", "medium", "high"], "status": ["open", "investigating", "resolved"]},
}
#: The value an unknown one is read as; columns not listed here are checked by ``violations`` alone.
FALLBACK = {("contradictions", "severity"): "low", ("research_gaps", "priority"): "medium"}


def schema(relation: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[relation])


def conform(df: DataFrame, relation: str, closed: bool = True) -> DataFrame:
    """Columns of the relation in order and of its types; missing ones null, nulls and unknown values by their defaults.

    With ``closed`` an unknown column is an error; else it is dropped.
    """
    fields = schema(relation).fields
    extra = set(df.columns) - {f.name for f in fields}
    if closed and extra:
        raise ValueError(f"{relation}: unknown columns {sorted(extra)}")
    out = []
    for f in fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if (relation, f.name) in FALLBACK:
            c = F.when(c.isin(ALLOWED[relation][f.name]), c).otherwise(FALLBACK[relation, f.name])
        default = DEFAULTS.get(relation, {}).get(f.name)
        if default is not None:
            c = F.coalesce(c, F.lit(default))
        elif f.dataType.typeName() == "array" and relation == "entities":
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.dataType.typeName() == "map":
            c = F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        elif f.name in ("retrieved_at", "timestamp") and f.dataType.typeName() == "timestamp":
            c = F.coalesce(c, F.current_timestamp())
        out.append(c.alias(f.name))
    return df.select(*out)


def violations(df: DataFrame, relation: str) -> DataFrame:
    """Rows with a value outside of the allowed ones, and the column's name as ``violation``."""
    tests = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.lit(c)) for c, v in ALLOWED.get(relation, {}).items()]
    if not tests:
        return df.limit(0).withColumn("violation", F.lit(None).cast("string"))
    return df.withColumn("violation", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))


def empty(spark, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema(relation))
