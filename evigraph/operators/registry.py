"""Entity registry: additive upsert, replacing merge, and the state's append-only relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_entities(mentions: DataFrame, order: list[str]) -> DataFrame:
    """One row per trimmed name from mentions (name, type, aliases, description, document_id) in the order of ``order``.

    The first type stands, null or not; the description is the first non-empty one; the first mention's aliases stay as they
    are and later ones add what is new and not empty; documents are distinct. Blank names are skipped. Confidence is null.
    Grouped by (name, alias) and (name, document) first, so a name with a third of all mentions never gathers them in one task.
    ``order`` must be total within a name.
    """
    m = mentions.withColumn("name", F.trim("name")).where("name <> ''")
    m = m.select("name", F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "description", F.col("document_id").alias("doc"))
    filled = F.when(F.col("description") != "", F.col("o"))
    first = m.groupBy("name").agg(F.min_by(F.struct("type", "aliases", "description"), "o").alias("f"), F.min_by("description", filled).alias("d"), F.min(filled).alias("has"))

    def ordered(rows: DataFrame, value: str, out: str) -> DataFrame:
        at = rows.groupBy("name", value).agg(F.min("at").alias("at"))
        return at.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(out))

    aliases = ordered(m.select("name", "o", F.posexplode("aliases").alias("p", "alias")).where("alias <> ''").select("name", "alias", F.struct("o", "p").alias("at")), "alias", "more")
    docs = ordered(m.where("doc <> ''").select("name", "doc", F.col("o").alias("at")), "doc", "docs")
    none = F.array().cast("array<string>")
    return first.join(aliases, "name", "left").join(docs, "name", "left").select(
        F.col("name").alias("canonical_name"), F.col("f.type").alias("type"), F.concat("f.aliases", F.array_except(F.coalesce("more", none), F.col("f.aliases"))).alias("aliases"),
        F.when(F.col("has").isNotNull(), F.col("d")).otherwise(F.col("f.description")).alias("description"), none.alias("evidence_refs"), F.coalesce("docs", none).alias("source_document_ids"),
        F.lit(None).cast("double").alias("confidence"),
    )


def replace_entities(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key; ``order`` must be total within a key. One struct per key is kept, not the group."""
    rest = [c for c in updates.columns if c != key]
    return updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def append(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def new_rows(candidates: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Candidates whose key is not there yet; of repeated keys the first by ``order``. Null keys are dropped."""
    rest = [c for c in candidates.columns if c != key]
    first = candidates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    return first.join(existing.select(key).distinct(), key, "left_anti").select(*candidates.columns)


def unanalysed(documents: DataFrame, triplets: DataFrame) -> DataFrame:
    """Documents that no triplet names as its source; blank ids are dropped."""
    seen = triplets.where("source_document_id IS NOT NULL").select(F.col("source_document_id").alias("document_id")).distinct()
    return documents.where("document_id <> ''").join(seen, "document_id", "left_anti")


def hash_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, changed) between two keyed tables; keys are unique on each side."""
    a, b = old.select(F.col(key), F.col(value).alias("_a"), F.lit(1).alias("_ia")), new.select(F.col(key), F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    change = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def needs_reindex(old: DataFrame, new: DataFrame, key: str, value: str) -> bool:
    return bool(hash_diff(old, new, key, value).limit(1).count())
