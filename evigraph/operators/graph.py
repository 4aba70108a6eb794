"""The knowledge graph as two DataFrames: nodes and edges, degrees, disputed marks, finalised tables, communities, hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import cut


def edges(triplets: DataFrame) -> DataFrame:
    """source, target, weight (triplets), predicates (sorted, distinct), triplet_ids, source_document_ids (sorted).

    One row per ordered pair; rows with a null subject or object make no edge. Null predicates and ids are left out of the lists.
    """
    t = triplets.where("subject IS NOT NULL AND object IS NOT NULL")
    return t.groupBy(F.col("subject").alias("source"), F.col("object").alias("target")).agg(
        F.count("*").alias("weight"),
        F.array_sort(F.collect_set("predicate")).alias("predicates"),
        F.array_sort(F.collect_list("triplet_id")).alias("triplet_ids"),
        F.array_sort(F.collect_list("source_document_id")).alias("source_document_ids"),
    )


def node_names(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """Distinct names of registry entities and of endpoints, with ``registered``."""
    ends = triplets.where("subject IS NOT NULL AND object IS NOT NULL").select(F.explode(F.array("subject", "object")).alias("name"), F.lit(False).alias("registered"))
    known = entities.where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("name"), F.lit(True).alias("registered"))
    return known.unionByName(ends).groupBy("name").agg(F.max("registered").alias("registered"))


def degrees(triplets: DataFrame) -> DataFrame:
    """name, degree: in plus out over distinct ordered pairs; a loop counts twice."""
    pairs = triplets.where("subject IS NOT NULL AND object IS NOT NULL").select("subject", "object").distinct()
    return pairs.select(F.explode(F.array("subject", "object")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def disputed_entities(entities: DataFrame, contradictions: DataFrame) -> DataFrame:
    """name of registry entities that occur, letter case apart, inside a topic or claim. Status plays no part; empty names match nothing.

    A substring join without a nested loop: names and texts meet on a character run of 8 (3, 1 for short names). Of its runs a
    name takes the one that is in the fewest texts, and a name with a run that is in none is done with, so names that begin
    alike don't meet all texts.

    Runs and texts are moved as hashes; whole texts come back for what met alone, and ``contains`` decides, so clashes of hashes
    add nothing and lose nothing. Rows made by ``explode`` are many times what Spark guesses from their table, so the joins are
    by sorting: a guess must not send them to the driver. Names whose first run is in no text leave before their other runs are
    made, and texts give runs of the widths that some name has.
    """
    names = entities.where("canonical_name <> ''").select(F.col("canonical_name").alias("name"), F.lower("canonical_name").alias("low")).distinct()
    texts = contradictions.select(F.explode(F.array("topic", "claim_a", "claim_b")).alias("text")).where("text IS NOT NULL").select(F.lower("text").alias("text")).distinct()
    texts = texts.select("text", F.xxhash64("text").alias("text_hash"))
    width = F.when(F.length("low") >= 8, F.lit(8)).when(F.length("low") >= 3, F.lit(3)).otherwise(F.lit(1))
    widths = names.agg(F.coalesce(F.collect_set(width), F.array()).alias("widths"))  # one row of three values at most is broadcast
    runs = lambda c, w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - w + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col(c), i, w)))
    asked = texts.crossJoin(F.broadcast(widths))
    grams = asked.select("text_hash", F.explode(F.array_distinct(F.flatten(F.transform("widths", lambda w: runs("text", w))))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    lows = names.select("low", F.xxhash64(F.substring(F.col("low"), F.lit(1), width)).alias("gram")).distinct().join(counts.hint("merge"), "gram", "left_semi").select("low")
    held = lows.select("low", F.explode(F.array_distinct(runs("low", width))).alias("gram")).join(counts.hint("merge"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = held.groupBy("low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n")).where("n > 0").select("low", "gram")
    met = grams.hint("merge").join(rarest, "gram").select("low", "text_hash")
    inside = met.join(texts.hint("merge"), "text_hash").where(F.contains("text", F.col("low"))).select("low").distinct()
    return names.join(inside.hint("merge"), "low").select("name").distinct()


def nodes(entities: DataFrame, triplets: DataFrame, contradictions: DataFrame) -> DataFrame:
    """name, registered, disputed, degree, centrality (degree / (nodes - 1), 0 for one node, 4 places)."""
    base = node_names(entities, triplets).join(degrees(triplets), "name", "left").join(
        disputed_entities(entities, contradictions).withColumn("disputed", F.lit(True)), "name", "left"
    )
    n = node_names(entities, triplets).agg(F.count("*").alias("n"))
    degree = F.coalesce("degree", F.lit(0))
    central = F.when(F.col("n") > 1, F.round(degree / (F.col("n") - 1), 4)).otherwise(0.0)
    # one row is broadcast
    return base.crossJoin(F.broadcast(n)).select("name", "registered", F.coalesce("disputed", F.lit(False)).alias("disputed"), degree.alias("degree"), central.alias("centrality"))


def graph_counts(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """node_count, edge_count, density (directed, 4 places, 0 for one node): one row."""
    n = node_names(entities, triplets).agg(F.count("*").alias("node_count"))
    m = triplets.where("subject IS NOT NULL AND object IS NOT NULL").select("subject", "object").distinct().agg(F.count("*").alias("edge_count"))
    density = F.when(F.col("node_count") > 1, F.round(F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1.0)), 4)).otherwise(0.0)
    return n.crossJoin(m).select("node_count", "edge_count", density.alias("density"))


def undirected_degrees(relationships: DataFrame) -> DataFrame:
    """name, degree over distinct unordered pairs; a loop counts twice. Rows with a null end count for nothing."""
    pairs = relationships.where("source IS NOT NULL AND target IS NOT NULL").select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()
    return pairs.select(F.explode(F.array("lo", "hi")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def number_rows(df: DataFrame, order: list[str], name: str = "human_readable_id") -> DataFrame:
    """Row numbers from 0 in a total order, without a single-task window: sorted ranges are numbered each for itself and shifted."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # one row per task
    shift, at = [], 0
    for p in sorted(counts):
        shift.append((p, at))
        at += counts[p]
    if not shift:
        return parts.drop("_part").withColumn(name, F.lit(0).cast("long"))
    shifts = df.sparkSession.createDataFrame(shift, "_part int, _shift long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_local", local).join(F.broadcast(shifts), "_part").withColumn(name, F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the first by all columns as JSON, so that the choice doesn't depend on the order of rows."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_r")).select("_r.*")


FINAL_RELATIONSHIPS = ["source", "target", "combined_degree", "human_readable_id", "id"]
FINAL_ENTITIES = ["title", "degree", "human_readable_id", "id"]


def finalize_relationships(relationships: DataFrame, ord_column: str | None = None) -> DataFrame:
    """First row per (source, target), combined degree, consecutive ids; other columns pass through behind these.

    "First" and the ids follow ``ord_column``, or source and target where there is none. ``id`` is a hash of the pair.
    """
    d = undirected_degrees(relationships)
    order = [ord_column] if ord_column else ["source", "target"]
    if ord_column:
        first = F.row_number().over(Window.partitionBy("source", "target").orderBy(ord_column))
        one = relationships.withColumn("_first", first).where("_first = 1").drop("_first")
    else:
        one = first_rows(relationships, ["source", "target"])
    out = one.join(d.select(F.col("name").alias("source"), F.col("degree").alias("_a")), "source", "left").join(d.select(F.col("name").alias("target"), F.col("degree").alias("_b")), "target", "left")
    out = out.withColumn("combined_degree", F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).drop("_a", "_b")
    out = number_rows(out, order).withColumn("id", F.sha1(F.concat_ws("\u0001", "source", "target")))
    return out.select(*FINAL_RELATIONSHIPS, *[c for c in out.columns if c not in FINAL_RELATIONSHIPS])


def finalize_entities(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """First row per title (by all columns), degree, consecutive ids by title."""
    d = undirected_degrees(relationships).withColumnRenamed("name", "title")
    out = first_rows(entities, ["title"]).drop("degree").join(d, "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    out = number_rows(out, ["title"]).withColumn("id", F.sha1("title"))
    return out.select(*[c for c in FINAL_ENTITIES if c in out.columns], *[c for c in out.columns if c not in FINAL_ENTITIES])


def export_nodes(entities: DataFrame, triplets: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Flat node attributes for exports."""
    e = entities.select(F.col("canonical_name").alias("name"), "type", "description", "confidence", F.size(F.coalesce("aliases", F.array())).alias("a"), F.size(F.coalesce("evidence_refs", F.array())).alias("r"), F.size(F.coalesce("source_document_ids", F.array())).alias("s"))
    e = first_rows(e, ["name"])
    n = nodes(entities, triplets, contradictions).join(e, "name", "left")
    return n.select(
        F.col("name").alias("node_id"), F.col("name").alias("label"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"), F.col("disputed").cast("string").alias("disputed"), F.coalesce("a", F.lit(0)).alias("alias_count"),
        F.coalesce("r", F.lit(0)).alias("evidence_ref_count"), F.coalesce("s", F.lit(0)).alias("source_document_count"),
    )


def export_edges(entities: DataFrame, triplets: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Flat edge attributes for exports; disputed if either end is."""
    bad = disputed_entities(entities, contradictions)
    e = edges(triplets).join(bad.select(F.col("name").alias("source"), F.lit(True).alias("x")), "source", "left").join(bad.select(F.col("name").alias("target"), F.lit(True).alias("y")), "target", "left")
    filled = lambda c: F.array_join(F.filter(c, lambda v: v != ""), ";")
    return e.select(
        "source", "target", F.array_join("predicates", " | ").alias("label"), F.array_join("predicates", ";").alias("predicates"), F.size("predicates").alias("predicate_count"),
        "weight", F.coalesce(F.col("x") | F.col("y"), F.col("x"), F.col("y"), F.lit(False)).cast("string").alias("disputed"), filled("triplet_ids").alias("triplet_ids"), filled("source_document_ids").alias("source_document_ids"),
    )


def layout(named_degrees: DataFrame, top: int = 200) -> DataFrame:
    """name, x, y of the ``top`` nodes by degree: the first in the middle, the rest on a circle around it."""
    best = named_degrees.select("name", "degree").orderBy(F.desc("degree"), F.lower("name"), "name").limit(top)
    ranked = best.withColumn("i", F.row_number().over(Window.orderBy(F.desc("degree"), F.lower("name"), "name")) - 1)  # at most ``top`` rows
    n = F.count("*").over(Window.partitionBy()) - 1
    ranked = ranked.withColumn("n", n)
    angle = -F.pi() / 2 + (F.col("i") - 1) * 2 * F.pi() / F.col("n")
    radius = F.when(F.col("n") <= 6, 220.0).otherwise(260.0)
    x = F.when(F.col("i") == 0, 480.0).otherwise(480.0 + radius * F.cos(angle))
    y = F.when(F.col("i") == 0, 320.0).otherwise(320.0 + radius * F.sin(angle))
    return ranked.select("name", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def components(pairs: DataFrame) -> DataFrame:
    """name, component (its smallest name) of the undirected graph of (source, target); stops when no label changes.

    Labels move along edges and then to the label of the label, so rounds grow with the logarithm of the longest path.
    """
    both = pairs.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    arcs = cut(both.unionByName(both.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "arcs")
    labels = cut(arcs.select(F.col("source").alias("name")).distinct().withColumn("component", F.col("name")), "labels")
    while True:
        offered = arcs.join(labels.select(F.col("name").alias("source"), "component"), "source").groupBy(F.col("target").alias("name")).agg(F.min("component").alias("offer"))
        near = labels.join(offered, "name").select("name", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("name").alias("component"), F.col("component").alias("up"))
        new = cut(near.join(jump, "component").select("name", "old", F.least("component", "up").alias("component")), "labels", done=(labels,))
        labels = new
        if not new.where("old <> component").limit(1).count():
            return new.select("name", "component")


def communities(pairs: DataFrame, levels: int = 3, rounds: int = 5) -> DataFrame:
    """name, level, community: hierarchical label propagation. Level 0 is the coarsest (connected components); each deeper
    level propagates labels within the communities above it, ``rounds`` times, ties to the smallest label.

    The reference leaves detection to an external index; this is a documented algorithm of our own.
    """
    base = pairs.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("w"))
    arcs = cut(base.select(F.col("a").alias("source"), F.col("b").alias("target"), "w").unionByName(base.select(F.col("b").alias("source"), F.col("a").alias("target"), "w")), "arcs")
    current = components(arcs.select("source", "target")).select("name", F.col("component").alias("community"))
    out = current.select("name", F.lit(0).alias("level"), "community")
    for level in range(1, levels):
        parent = current.withColumnRenamed("community", "parent")
        inside = arcs.join(parent.select(F.col("name").alias("source"), F.col("parent").alias("p")), "source").join(parent.select(F.col("name").alias("target"), F.col("parent").alias("q")), "target").where("p = q").select("source", "target", "w")
        inside = cut(inside, "inside")
        labels = current.select("name", F.col("name").alias("community"))
        for _ in range(rounds):
            votes = inside.join(labels.select(F.col("name").alias("source"), "community"), "source").groupBy(F.col("target").alias("name"), "community").agg(F.sum("w").alias("w"))
            best = votes.groupBy("name").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("best"))
            labels = cut(labels.join(best, "name", "left").select("name", F.coalesce("best", "community").alias("community")), "votes")
        current = labels
        out = out.unionByName(current.select("name", F.lit(level).alias("level"), "community"))
    return out


def k_hop(pairs: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """name, hops: what is reached from ``starts`` (name) over at most ``k`` directed edges, with the fewest hops."""
    arcs = pairs.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    seen = starts.select("name").distinct().withColumn("hops", F.lit(0))
    front = seen
    for i in range(1, k + 1):
        step = front.select(F.col("name").alias("source")).join(arcs, "source").select(F.col("target").alias("name")).distinct().join(seen, "name", "left_anti")
        front = cut(step.withColumn("hops", F.lit(i)), "front")
        seen = seen.unionByName(front)
    return seen
