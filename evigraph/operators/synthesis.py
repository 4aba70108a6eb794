"""Ranked, bounded and source-traced selections for reports. All top-k are limits of a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.text import statement
from evigraph.operators import graph
from evigraph.runtime import cut

STATUS = {"open": 0, "investigating": 1, "accepted_uncertainty": 2, "resolved": 3}
SEVERITY = {"high": 0, "low": 1}
PRIORITY = {"high": 0, "medium": 1, "low": 2}
GAP_STATUS = {"open": 0, "investigating": 1, "resolved": 2}


def rank_of(column: str, order: dict[str, int]):
    out = F.lit(99)
    for value, i in order.items():
        out = F.when(F.col(column) == value, i).otherwise(out)
    return out


def top_entities(entities: DataFrame, triplets: DataFrame, contradictions: DataFrame, k: int = 8, nodes: DataFrame | None = None) -> DataFrame:
    """Registry entities: disputed first, then degree, centrality, confidence (null as 0), source documents, name.

    ``nodes``: the graph's nodes where they are made already.
    """
    sources = F.size(F.coalesce("source_document_ids", F.array()))
    e = entities.where("canonical_name IS NOT NULL").groupBy("canonical_name").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.max(sources).alias("source_count"))
    n = (nodes if nodes is not None else graph.nodes(entities, triplets, contradictions)).where("registered").withColumnRenamed("name", "canonical_name")
    ranked = e.join(n, "canonical_name").orderBy(F.desc("disputed"), F.desc("degree"), F.desc("centrality"), F.desc("confidence"), F.desc("source_count"), F.lower("canonical_name"), "canonical_name")
    return ranked.select("canonical_name", "disputed", "degree", "centrality", "confidence", "source_count").limit(k)


def representative_triplets(entities: DataFrame, triplets: DataFrame, contradictions: DataFrame, k: int = 12, top: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Triplets with ends among the top entities, confident, well connected, recent; ties by triplet_id and all columns.

    Nodes are made once, written, and read for the top entities and for both ends.
    """
    nodes = nodes if nodes is not None else cut(graph.nodes(entities, triplets, contradictions), "nodes")
    top = top if top is not None else top_entities(entities, triplets, contradictions, nodes=nodes)
    names = F.broadcast(top.select(F.col("canonical_name").alias("name"), F.lit(1).alias("top")))  # k rows
    n = nodes.select("name", "degree", "centrality")
    t = triplets
    for end in ("subject", "object"):
        t = t.join(n.select(F.col("name").alias(end), F.col("degree").alias(f"{end}_degree"), F.col("centrality").alias(f"{end}_c")), end, "left")
        t = t.join(names.select(F.col("name").alias(end), F.col("top").alias(f"{end}_top")), end, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = t.select(
        "triplet_id", "subject", "predicate", "object", statement(F.col("subject"), F.col("predicate"), F.col("object")).alias("statement"), "evidence", "source_document_id", "source_url",
        "confidence", zero("extraction_iteration").alias("extraction_iteration"), zero("subject_degree").alias("subject_degree"), zero("object_degree").alias("object_degree"),
        zero("subject_top").alias("subject_top"), zero("object_top").alias("object_top"), (zero("subject_c") + zero("object_c")).alias("c"),
    )
    order = [
        F.desc("subject_top"), F.desc("object_top"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc(F.col("subject_degree") + F.col("object_degree")),
        F.desc(F.round("c", 4)), F.desc("extraction_iteration"), "triplet_id", "subject", "object", "predicate",
    ]
    return t.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("c")


def select_contradictions(contradictions: DataFrame, k: int = 5) -> DataFrame:
    return contradictions.orderBy(rank_of("status", STATUS), rank_of("severity", SEVERITY), F.lower(F.coalesce("topic", F.lit(""))), "contradiction_id").limit(k)


def select_gaps(gaps: DataFrame, k: int = 5) -> DataFrame:
    return gaps.orderBy(rank_of("status", GAP_STATUS), rank_of("priority", PRIORITY), F.coalesce("created_iteration", F.lit(0)), "gap_id").limit(k)


def pillars(representative: DataFrame, top: DataFrame, max_pillars: int = 4, per_pillar: int = 4) -> DataFrame:
    """Greedy: each top entity in turn takes its first triplets not taken yet; if none does, one pillar of the first triplets.

    A fold over two bounded arrays in one row: pillar, anchor_entity, title_hint, predicate_hints, triplet_ids.
    """
    t = representative.agg(F.array_sort(F.collect_list(F.struct("rank", "triplet_id", "subject", "object", "predicate"))).alias("ts"))
    order = [F.desc("disputed"), F.desc("degree"), F.desc("centrality"), F.desc("confidence"), F.desc("source_count"), F.lower("canonical_name"), F.col("canonical_name")]
    e = top.withColumn("i", F.row_number().over(Window.orderBy(*order))).agg(F.array_sort(F.collect_list(F.struct("i", "canonical_name"))).alias("es"))
    pillar = "struct<anchor:string,title:string,hints:string,ids:array<string>>"
    fold = f"""
        aggregate(es, named_struct('used', cast(array() AS array<string>), 'out', cast(array() AS array<{pillar}>)), (acc, e) ->
          named_struct(
            'used', CASE WHEN size(acc.out) < {max_pillars} THEN concat(acc.used, transform(slice(filter(ts, t -> (t.subject = e.canonical_name OR t.object = e.canonical_name) AND NOT array_contains(acc.used, t.triplet_id)), 1, {per_pillar}), t -> t.triplet_id)) ELSE acc.used END,
            'out', CASE WHEN size(acc.out) < {max_pillars} AND exists(ts, t -> (t.subject = e.canonical_name OR t.object = e.canonical_name) AND NOT array_contains(acc.used, t.triplet_id))
              THEN concat(acc.out, array(named_struct('anchor', e.canonical_name,
                'title', concat(e.canonical_name, ' - ', array_join(slice(array_distinct(transform(slice(filter(ts, t -> (t.subject = e.canonical_name OR t.object = e.canonical_name) AND NOT array_contains(acc.used, t.triplet_id)), 1, {per_pillar}), t -> t.predicate)), 1, 2), ', ')),
                'hints', array_join(slice(array_distinct(transform(slice(filter(ts, t -> (t.subject = e.canonical_name OR t.object = e.canonical_name) AND NOT array_contains(acc.used, t.triplet_id)), 1, {per_pillar}), t -> t.predicate)), 1, 3), ', '),
                'ids', transform(slice(filter(ts, t -> (t.subject = e.canonical_name OR t.object = e.canonical_name) AND NOT array_contains(acc.used, t.triplet_id)), 1, {per_pillar}), t -> t.triplet_id))))
              ELSE acc.out END), acc -> acc.out)"""
    folded = t.crossJoin(e).select("ts", F.expr(fold).alias("p"))
    only = f"""CASE WHEN size(p) = 0 AND size(ts) > 0 THEN array(named_struct('anchor', ts[0].subject, 'title', 'Primary graph relationships',
        'hints', array_join(slice(array_distinct(transform(slice(ts, 1, {per_pillar}), t -> t.predicate)), 1, 3), ', '), 'ids', transform(slice(ts, 1, {per_pillar}), t -> t.triplet_id))) ELSE p END"""
    return folded.select(F.posexplode(F.expr(only)).alias("i", "x")).select((F.col("i") + 1).alias("pillar"), F.col("x.anchor").alias("anchor_entity"), F.col("x.title").alias("title_hint"), F.col("x.hints").alias("predicate_hints"), F.array_join("x.ids", ";").alias("triplet_ids"))


def document_index(documents: DataFrame, representative: DataFrame, contradictions: DataFrame, k: int = 10) -> DataFrame:
    """Documents that the selections refer to, or all if they refer to none; the first ``k`` by retrieved_at and id."""
    refs = representative.select(F.col("source_document_id").alias("document_id"))
    for c in ("source_document_id_a", "source_document_id_b"):
        refs = refs.unionByName(contradictions.select(F.col(c).alias("document_id")))
    refs = refs.where("document_id <> ''").distinct()
    any_ref = refs.agg((F.count("*") > 0).alias("any"))
    d = documents.groupBy("document_id").agg(F.min_by(F.struct("title", "url", "query", "acquisition_method", "retrieved_at"), F.struct(F.coalesce("retrieved_at", F.lit("9999-01-01").cast("timestamp")), F.coalesce("url", F.lit("")))).alias("d")).select("document_id", "d.*")
    marked = d.join(F.broadcast(refs.withColumn("hit", F.lit(True))), "document_id", "left").crossJoin(F.broadcast(any_ref)).where("hit OR NOT any")  # refs: at most the selections' rows
    return marked.orderBy(F.asc_nulls_last("retrieved_at"), "document_id").limit(k).select("document_id", "title", "url", "query", "acquisition_method")


def writer_context(documents: DataFrame, entities: DataFrame, triplets: DataFrame, contradictions: DataFrame, gaps: DataFrame, query: str = "") -> DataFrame:
    """One row of bounded JSON arrays: what a report is written from. No document text enters it."""
    nodes = cut(graph.nodes(entities, triplets, contradictions), "nodes")
    top = cut(top_entities(entities, triplets, contradictions, nodes=nodes), "top")
    rep = cut(representative_triplets(entities, triplets, contradictions, top=top, nodes=nodes), "representative")
    cons, gap = select_contradictions(contradictions), select_gaps(gaps)
    parts = {"top_entities": top, "representative_triplets": rep, "candidate_pillars": pillars(rep, top), "contradictions": cons, "research_gaps": gap, "document_index": document_index(documents, rep, cons)}
    out = graph.graph_counts(entities, triplets).select(F.lit(query).alias("query"), F.to_json(F.struct("node_count", "edge_count", "density")).alias("metrics"))
    for name, df in parts.items():
        out = out.crossJoin(df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias(name)))  # one row each
    return out
