"""Payloads and small configuration texts as expressions: extraction and critic JSON, requirement files, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import json_span

EXTRACTION = (
    "struct<entities:array<struct<canonical_name:string,type:string,aliases:array<string>,description:string>>,"
    "triplets:array<struct<subject:string,predicate:string,object:string,evidence:string,confidence:double>>>"
)
CRITIC = (
    "struct<contradictions:array<struct<subject:string,topic:string,claim_a:string,claim_b:string,evidence_a:string,evidence_b:string,severity:string>>,"
    "research_gaps:array<struct<question:string,trigger:string,priority:string>>>"
)


def _parsed(text, schema: str):
    """The whole text as JSON, else its span of braces; null where neither is a JSON object."""
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(F.trim(c), F.lit("{")), F.from_json(F.trim(c), schema))
    return F.coalesce(valid(text), valid(json_span(text)))


def parse_extraction(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, valid, entities, triplets. All or nothing: an entity without name, or a triplet without one of its four texts, makes
    the payload invalid, with both lists null. Missing lists are empty; unknown fields are dropped."""
    p = df.select(key, _parsed(F.col(text), EXTRACTION).alias("p"))
    e, t = F.coalesce("p.entities", F.expr("cast(array() AS array<struct<canonical_name:string,type:string,aliases:array<string>,description:string>>)")), F.coalesce("p.triplets", F.expr("cast(array() AS array<struct<subject:string,predicate:string,object:string,evidence:string,confidence:double>>)"))
    p = p.select(key, F.col("p").isNotNull().alias("ok"), e.alias("e"), t.alias("t"))
    valid = F.col("ok") & F.forall("e", lambda x: x["canonical_name"].isNotNull()) & F.forall("t", lambda x: x["subject"].isNotNull() & x["predicate"].isNotNull() & x["object"].isNotNull() & x["evidence"].isNotNull())
    return p.select(key, valid.alias("valid"), F.when(valid, F.col("e")).alias("entities"), F.when(valid, F.col("t")).alias("triplets"))


def parse_critic(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, valid, contradictions, research_gaps; all or nothing, as for extractions."""
    p = df.select(key, _parsed(F.col(text), CRITIC).alias("p")).select(key, F.col("p").isNotNull().alias("ok"), "p.contradictions", "p.research_gaps")
    valid = F.col("ok") & F.coalesce(F.forall("contradictions", lambda x: x["claim_a"].isNotNull() & x["claim_b"].isNotNull()), F.lit(True)) & F.coalesce(F.forall("research_gaps", lambda x: x["question"].isNotNull()), F.lit(True))
    return p.select(key, valid.alias("valid"), F.when(valid, F.col("contradictions")).alias("contradictions"), F.when(valid, F.col("research_gaps")).alias("research_gaps"))


def triplet_rows(parsed: DataFrame, key: str, iteration: int) -> DataFrame:
    """Complete triplets of parsed payloads with ids and lineage; white space counts as text."""
    from evigraph.functions.ids import triplet_id

    t = parsed.where("valid").select(F.col(key).cast("string").alias("source_document_id"), F.explode("triplets").alias("t")).select("source_document_id", "t.*")
    t = t.where("subject <> '' AND predicate <> '' AND object <> ''")
    return t.select(triplet_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("source_document_id")).alias("triplet_id"), "subject", "predicate", "object", "evidence", "source_document_id", "confidence", F.lit(iteration).alias("extraction_iteration"))


def requirements(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, query, user_prompt, constraints of Markdown with "## Section" headings.

    With a topic section it is the query and the other sections (prompt and constraints apart) the prompt; with other sections
    alone all text before and in them is the query; without sections a heading on the first line is the query and the whole
    text the prompt, else the whole text is the query. An empty query falls back to the whole text.
    """
    raw = F.col(text)
    parts = F.split(raw, r"(?m)^##[ \t]+(?=\S)")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pairs = F.transform(F.slice(parts, 2, 100_000), lambda s: F.named_struct(F.lit("k"), F.lower(trim(F.substring_index(s, "\n", 1))), F.lit("v"), trim(F.regexp_replace(s, r"^[^\n]*\n?", ""))))
    d = df.select(key, raw.alias("_raw"), trim(F.element_at(parts, 1)).alias("_head"), pairs.alias("_p"))
    def of(name: str):
        return F.try_element_at(F.transform(F.filter("_p", lambda x: x["k"] == name), lambda x: x["v"]), F.lit(-1))
    def rest(*skip: str):
        return F.transform(F.filter("_p", lambda x: ~x["k"].isin(*skip) & (x["v"] != "")), lambda x: x["v"])
    blank = lambda c: F.nullif(c, F.lit(""))
    heading = blank(F.regexp_extract(F.regexp_replace(F.substring_index("_raw", "\n", 1), r"^\s+|\s+$", ""), r"^#{1,3}\s+(.+)$", 1))
    topic, sections = of("topic").isNotNull(), F.size("_p") > 0
    context = F.array_join(rest("topic", "prompt", "constraints"), "\n\n")
    joined = F.array_join(F.filter(F.concat(F.array("_head"), rest("prompt", "constraints")), lambda x: x != ""), "\n\n")
    query = F.when(topic, of("topic")).when(sections, joined).otherwise(F.coalesce(heading, "_raw"))
    return d.select(
        key, F.coalesce(blank(query), "_raw").alias("query"), F.when(topic, blank(context)).when(~sections & heading.isNotNull(), F.col("_raw")).alias("user_prompt"),
        F.when(sections, blank(of("constraints"))).alias("constraints"),
    )


#: Settings read for thresholds, the key each is written as, and its default.
THRESHOLDS = {"chunk_size": ("size", 2000), "overlap": ("overlap", 150), "batch_size": ("batch_size", 8), "batch_max_tokens": ("batch_max_tokens", 2000)}


def thresholds(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the first value of each setting of THRESHOLDS, else its default."""
    found = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^\s*{name}:\s*(\d+)", 1), F.lit("")).try_cast("int")
    return df.select(key, *[F.coalesce(found(name), F.lit(default)).alias(out) for out, (name, default) in THRESHOLDS.items()])
