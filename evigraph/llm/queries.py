"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import names, neardup, packing, pages, splitting, subjects, tokens, truncation
from evigraph.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.furniture_lines(table(spark, sf_dir, "source_documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(table(spark, sf_dir, "entity_records"), table(spark, sf_dir, "triplet_records"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_entities(table(spark, sf_dir, "entity_records"), table(spark, sf_dir, "triplet_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.residue_records(table(spark, sf_dir, "source_documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, sf_dir, "source_documents"), table(spark, sf_dir, "settings_config"), with_text=False)
    return pieces.select("settings_id", "document_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "source_documents"), table(spark, sf_dir, "settings_config"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces say of themselves: hash of the text put together again, and pieces over the limit."""
    docs, settings = table(spark, sf_dir, "source_documents"), table(spark, sf_dir, "settings_config")
    pieces = splitting.split_documents(docs, settings)
    return splitting.restored(pieces, settings)


def _cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(truncation.text_values(table(spark, sf_dir, "source_documents"), table(spark, sf_dir, "triplet_records")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_values(spark, sf_dir).where("is_cut").select("record_kind", "record_id")


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_share(_cut_values(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(neardup.page_texts(table(spark, sf_dir, "source_documents")))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and links by the default of five words and a similarity of 0.8."""
    return neardup.near_duplicate_classes(neardup.page_texts(table(spark, sf_dir, "source_documents")), 5, 0.8)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "byte_bpe_50k")


def p8_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_by_specs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"), tokens.token_sizes)


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container kind: documents placed, containers over their capacity, pieces of texts that would have fitted whole, and whether 95 % of the room is used."""
    return packing.checked(p8_placements(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_restored": p4_restored, "p5_found": p5_found, "p5_share": p5_share, "p6_found": p6_found, "p6_classes": p6_classes, "p7_ids": p7_ids, "p8_placements": p8_placements, "p8_use": p8_use, "p9_found": p9_found, "p9_composition": p9_composition}


P4_SQL = r"""
SELECT DISTINCT s.settings_id AS settings_id, d.document_id AS document_id
FROM source_documents d JOIN settings_config s ON CASE s.chunk_unit
    WHEN 'words' THEN len(regexp_extract_all(d.content, '[^ \t\n\r]+'))
    WHEN 'chars' THEN length(d.content)
    WHEN 'bytes' THEN strlen(d.content) END > s.chunk_size
WHERE d.content IS NOT NULL
"""


P4_RESTORED = P4_SQL.replace("d.document_id AS document_id", "d.document_id AS document_id, sha1(d.content) AS text_hash, 0::BIGINT AS over_limit")
P8_USE = "SELECT spec_id, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS split_though_fitting, true AS well_filled FROM container_specs"


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p4_restored": P4_RESTORED, "p8_use": P8_USE}
