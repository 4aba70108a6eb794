"""Structured Streaming: watched folders, append-only relations, keyed upsert, rows once per id, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import registry
from evigraph.sources.fs import Files


def watch_resources(spark: SparkSession, folder: str, cap: int = 80_000) -> DataFrame:
    """Document rows of new text files in a folder; the query's checkpoint knows what has been seen. Edited files don't come again."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    from evigraph.functions.ids import resource_document_id
    from evigraph.sources.files import RESOURCES, text_of

    f = f.where(F.col("path").rlike(r"\.(" + "|".join(RESOURCES) + ")$"))
    text = F.substring(text_of(F.col("content")), 1, cap)
    return f.select(resource_document_id(F.col("path"), F.col("modificationTime").cast("string")).alias("document_id"), F.col("path").alias("url"), text.alias("content"), F.lit("local_resource").alias("source_type"), F.col("modificationTime").alias("retrieved_at")).where(r"content RLIKE '\\S'")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Appends what is there to a Parquet folder and ends; started again it goes on where it was."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_id(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row per id; with an event time, ids are forgotten ``delay`` after it, which bounds the state."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def upsert_stream(mentions: DataFrame, folder: str, checkpoint: str, order: list[str]):
    """Keeps the entity registry of a stream of mentions: each batch is merged with the entities of the last finished version that
    it names, and written with the others as a new version; batch ids may leave gaps."""
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in (int(x.removeprefix("version=")) for x in Files(spark).names(folder) if x.startswith("version=")) if v < n and Files(spark).exists(f"{folder}/version={v}/_SUCCESS")]
        new = registry.upsert_entities(batch, order)
        if before:
            all_ = spark.read.parquet(f"{folder}/version={max(before)}")
            have = all_.join(new.select("canonical_name"), "canonical_name", "left_semi")  # the rest stays as it is
            as_mention = lambda e, rank: e.select(F.col("canonical_name").alias("name"), "type", "aliases", "description", F.explode_outer("source_document_ids").alias("document_id"), F.lit(rank).alias("_o"))
            new = registry.upsert_entities(as_mention(have, 0).unionByName(as_mention(new, 1)).withColumn("_p", F.coalesce("document_id", F.lit(""))), ["_o", "_p"])
            new = new.unionByName(all_.join(new.select("canonical_name"), "canonical_name", "left_anti"))
        new.write.mode("overwrite").parquet(f"{folder}/version={n}")

    return mentions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_budget(calls: DataFrame, key: str, credits: str, limit: float) -> DataFrame:
    """key, used, exceeded after each batch, by a stateful operator (one number of state per key)."""
    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0.0
        used += float(sum(f[credits].fillna(0).sum() for f in frames))
        state.update((used,))
        yield pd.DataFrame({key: [k[0]], "used": [used], "exceeded": [used >= limit]})

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, used double, exceeded boolean", "used double", "update", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, window: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Beyond the reference: counts by tumbling or sliding window with a watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
