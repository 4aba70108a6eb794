"""Queries of the reference's own operators over whole tables, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import ids, text as T
from evigraph.operators import acquire, critic, graph, ingest, registry, synthesis, usage
from evigraph.plans import index, jobs, routing
from evigraph.runtime import cut, table
from evigraph.search import search
from evigraph.schemas import conform
from evigraph.sources import parsing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def ect(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.entity_records, self.triplet_records, self.contradiction_records


# --- SQL parts -----------------------------------------------------------------------------------------------------------
NODES = """
arcs AS (SELECT DISTINCT subject, object FROM triplet_records WHERE subject IS NOT NULL AND object IS NOT NULL),
deg AS (SELECT name, count(*) AS degree FROM (SELECT subject AS name FROM arcs UNION ALL SELECT object FROM arcs) GROUP BY name),
names AS (SELECT name, bool_or(reg) AS registered FROM (SELECT canonical_name AS name, true AS reg FROM entity_records WHERE canonical_name IS NOT NULL
  UNION ALL SELECT subject, false FROM arcs UNION ALL SELECT object, false FROM arcs) GROUP BY name),
claims AS (SELECT DISTINCT lower(x) AS x FROM (SELECT topic AS x FROM contradiction_records UNION ALL SELECT claim_a FROM contradiction_records UNION ALL SELECT claim_b FROM contradiction_records) WHERE x IS NOT NULL),
bad AS (SELECT DISTINCT canonical_name AS name FROM entity_records WHERE canonical_name <> '' AND EXISTS (SELECT 1 FROM claims WHERE instr(claims.x, lower(canonical_name)) > 0)),
nodes AS (SELECT n.name, n.registered, b.name IS NOT NULL AS disputed, coalesce(d.degree, 0) AS degree,
  CASE WHEN (SELECT count(*) FROM names) > 1 THEN round(coalesce(d.degree, 0) / ((SELECT count(*) FROM names) - 1.0), 4) ELSE 0.0 END AS centrality
  FROM names n LEFT JOIN deg d ON d.name = n.name LEFT JOIN bad b ON b.name = n.name)"""
TOP = NODES + """,
ents AS (SELECT canonical_name, max(coalesce(confidence, 0.0)) AS confidence, max(coalesce(len(source_document_ids), 0)) AS source_count FROM entity_records WHERE canonical_name IS NOT NULL GROUP BY canonical_name),
top AS (SELECT e.canonical_name, n.disputed, n.degree, n.centrality, e.confidence, e.source_count FROM ents e JOIN nodes n ON n.name = e.canonical_name AND n.registered
  ORDER BY n.disputed DESC, n.degree DESC, n.centrality DESC, e.confidence DESC, e.source_count DESC, lower(e.canonical_name), e.canonical_name LIMIT 8)"""
REP = TOP + """,
rep AS (SELECT t.triplet_id, t.subject, t.predicate, t.object, concat_ws(' ', nullif(trim(t.subject), ''), nullif(trim(t.predicate), ''), nullif(trim(t.object), '')) AS statement,
  t.source_document_id, t.confidence, coalesce(t.extraction_iteration, 0) AS extraction_iteration, coalesce(a.degree, 0) AS subject_degree, coalesce(b.degree, 0) AS object_degree,
  (p.canonical_name IS NOT NULL)::INT AS subject_top, (q.canonical_name IS NOT NULL)::INT AS object_top,
  row_number() OVER (ORDER BY (p.canonical_name IS NOT NULL)::INT DESC, (q.canonical_name IS NOT NULL)::INT DESC, coalesce(t.confidence, 0.0) DESC, coalesce(a.degree, 0) + coalesce(b.degree, 0) DESC,
    round(coalesce(a.centrality, 0) + coalesce(b.centrality, 0), 4) DESC, coalesce(t.extraction_iteration, 0) DESC, t.triplet_id, t.subject, t.object, t.predicate) AS rank
  FROM triplet_records t LEFT JOIN nodes a ON a.name = t.subject LEFT JOIN nodes b ON b.name = t.object LEFT JOIN top p ON p.canonical_name = t.subject LEFT JOIN top q ON q.canonical_name = t.object
  QUALIFY rank <= 12)"""


# --- Graph ---------------------------------------------------------------------------------------------------------------
@query(f"WITH {TOP} SELECT canonical_name, disputed, degree, centrality, confidence, source_count FROM top")
def top_entities(spark, sf_dir):
    return synthesis.top_entities(*Tables(spark, sf_dir).ect())


@query(f"WITH {NODES} SELECT name, registered, disputed, degree, centrality FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph.nodes(*Tables(spark, sf_dir).ect())


@query("""SELECT subject AS source, object AS target, count(*) AS weight, coalesce(string_agg(DISTINCT predicate, ';' ORDER BY predicate), '') AS predicates,
  coalesce(string_agg(triplet_id, ';' ORDER BY triplet_id), '') AS triplet_ids FROM triplet_records WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY subject, object""")
def edge_aggregate(spark, sf_dir):
    e = graph.edges(Tables(spark, sf_dir).triplet_records)
    return e.select("source", "target", "weight", F.array_join("predicates", ";").alias("predicates"), F.array_join("triplet_ids", ";").alias("triplet_ids"))


@query(f"WITH {NODES} SELECT (SELECT count(*) FROM names) AS node_count, (SELECT count(*) FROM arcs) AS edge_count, round((SELECT count(*) FROM arcs) / ((SELECT count(*) FROM names) * ((SELECT count(*) FROM names) - 1.0)), 4) AS density")
def graph_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.graph_counts(t.entity_records, t.triplet_records)


@query(f"WITH {NODES} SELECT name, degree FROM nodes WHERE NOT registered")
def implicit_nodes(spark, sf_dir):
    return graph.nodes(*Tables(spark, sf_dir).ect()).where("NOT registered").select("name", "degree")


@query(f"WITH {NODES} SELECT name FROM bad")
def disputed_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.disputed_entities(t.entity_records, t.contradiction_records)


UNDIRECTED = """rel AS (SELECT DISTINCT subject AS source, object AS target FROM triplet_records WHERE subject IS NOT NULL AND object IS NOT NULL),
und AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM rel),
deg AS (SELECT name, count(*) AS degree FROM (SELECT lo AS name FROM und UNION ALL SELECT hi FROM und) GROUP BY name)"""


def _relationships(t: Tables) -> DataFrame:
    return t.triplet_records.where("subject IS NOT NULL AND object IS NOT NULL").select(F.col("subject").alias("source"), F.col("object").alias("target"))


@query(f"WITH {UNDIRECTED} SELECT source, target, a.degree + b.degree AS combined_degree, row_number() OVER (ORDER BY source, target) - 1 AS human_readable_id, sha1(source || chr(1) || target) AS id FROM rel JOIN deg a ON a.name = source JOIN deg b ON b.name = target")
def finalize_relationships(spark, sf_dir):
    return graph.finalize_relationships(_relationships(Tables(spark, sf_dir)))


@query(f"""WITH {UNDIRECTED}, titles AS (SELECT DISTINCT canonical_name AS title FROM entity_records WHERE canonical_name IS NOT NULL)
SELECT title, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY title) - 1 AS human_readable_id, sha1(title) AS id FROM titles LEFT JOIN deg ON name = title""")
def finalize_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.finalize_entities(t.entity_records.where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("title")), _relationships(t))


@query(f"""WITH {NODES}, e AS (SELECT canonical_name, max(coalesce(len(aliases), 0)) AS a, max(coalesce(len(evidence_refs), 0)) AS r, max(coalesce(len(source_document_ids), 0)) AS s, max(round(coalesce(confidence, 0.0), 4)) AS c FROM entity_records GROUP BY canonical_name)
SELECT name AS node_id, name AS label, disputed::VARCHAR AS disputed, coalesce(a, 0) AS alias_count, coalesce(r, 0) AS evidence_ref_count, coalesce(s, 0) AS source_document_count, coalesce(c, 0.0) AS confidence FROM nodes LEFT JOIN e ON e.canonical_name = name""")
def export_nodes(spark, sf_dir):
    return graph.export_nodes(*Tables(spark, sf_dir).ect()).select("node_id", "label", "disputed", "alias_count", "evidence_ref_count", "source_document_count", "confidence")


@query(f"""WITH {NODES} SELECT subject AS source, object AS target, coalesce(string_agg(DISTINCT predicate, ' | ' ORDER BY predicate), '') AS label, count(DISTINCT predicate) AS predicate_count, count(*) AS weight,
  (bool_or(subject IN (SELECT name FROM bad)) OR bool_or(object IN (SELECT name FROM bad)))::VARCHAR AS disputed,
  coalesce(string_agg(DISTINCT predicate, ';' ORDER BY predicate), '') AS predicates, coalesce(string_agg(triplet_id, ';' ORDER BY triplet_id) FILTER (triplet_id <> ''), '') AS triplet_ids,
  coalesce(string_agg(source_document_id, ';' ORDER BY source_document_id) FILTER (source_document_id <> ''), '') AS source_document_ids
FROM triplet_records WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY subject, object""")
def export_edges(spark, sf_dir):
    return graph.export_edges(*Tables(spark, sf_dir).ect()).select("source", "target", "label", "predicates", "predicate_count", "weight", "disputed", "triplet_ids", "source_document_ids")


@query(f"""WITH {NODES}, best AS (SELECT name, degree FROM nodes ORDER BY degree DESC, lower(name), name LIMIT 200),
r AS (SELECT name, row_number() OVER (ORDER BY degree DESC, lower(name), name) - 1 AS i, count(*) OVER () - 1 AS n FROM best)
SELECT name, round(CASE WHEN i = 0 THEN 480.0 ELSE 480.0 + CASE WHEN n <= 6 THEN 220.0 ELSE 260.0 END * cos(-pi() / 2 + (i - 1) * 2 * pi() / n) END, 4) AS x,
  round(CASE WHEN i = 0 THEN 320.0 ELSE 320.0 + CASE WHEN n <= 6 THEN 220.0 ELSE 260.0 END * sin(-pi() / 2 + (i - 1) * 2 * pi() / n) END, 4) AS y FROM r""")
def layout(spark, sf_dir):
    return graph.layout(graph.nodes(*Tables(spark, sf_dir).ect()))


@query(f"""WITH RECURSIVE {UNDIRECTED}, both_ways AS (SELECT lo AS a, hi AS b FROM und UNION SELECT hi, lo FROM und),
reach(name, hops) AS (SELECT name, 0 FROM (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 1) UNION SELECT b, hops + 1 FROM reach JOIN both_ways ON a = name WHERE hops < 2)
SELECT name, min(hops) AS hops FROM reach GROUP BY name""")
def two_hops(spark, sf_dir):
    rel = _relationships(Tables(spark, sf_dir))
    start = graph.undirected_degrees(rel).orderBy(F.desc("degree"), "name").limit(1).select("name")
    both = rel.unionByName(rel.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return graph.k_hop(both, start, 2)


def _components_sql() -> str:
    """Least name reached, by a recursion that keeps one row a node."""
    return """cc(name, component) USING KEY (name) AS (SELECT a, least(a, min(b)) FROM both_ways GROUP BY a
  UNION SELECT w.b, min(c.component) FROM cc c JOIN both_ways w ON w.a = c.name JOIN recurring.cc k ON k.name = w.b WHERE c.component < k.component GROUP BY w.b)"""


BOTH_WAYS = "both_ways AS (SELECT lo AS a, hi AS b FROM und UNION SELECT hi, lo FROM und)"


def _communities_sql(levels: int = 3, rounds: int = 5) -> str:
    """Components, then the rounds of label propagation written out."""
    parts = [UNDIRECTED, BOTH_WAYS, _components_sql(), """w AS (SELECT least(subject, object) AS a, greatest(subject, object) AS b, count(*) AS n FROM triplet_records WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object GROUP BY ALL),
arcs AS (SELECT a AS source, b AS target, n FROM w UNION ALL SELECT b, a, n FROM w), l0 AS (SELECT name, component AS community FROM cc WHERE name IN (SELECT source FROM arcs))"""]
    for level in range(1, levels):
        parts.append(f"i{level} AS MATERIALIZED (SELECT source, target, n FROM arcs JOIN l{level - 1} p ON p.name = source JOIN l{level - 1} q ON q.name = target WHERE p.community = q.community), v{level}_0 AS (SELECT name, name AS community FROM l{level - 1})")
        for r in range(1, rounds + 1):
            parts.append(f"""v{level}_{r} AS MATERIALIZED (SELECT name, coalesce(best, community) AS community FROM v{level}_{r - 1} LEFT JOIN (SELECT target AS name, arg_min(community, (-n, community)) AS best FROM (
  SELECT target, community, sum(n) AS n FROM i{level} JOIN v{level}_{r - 1} ON name = source GROUP BY ALL) GROUP BY target) USING (name))""")
        parts.append(f"l{level} AS (SELECT * FROM v{level}_{rounds})")
    return "WITH RECURSIVE " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT name, {level}::INT AS level, community FROM l{level}" for level in range(levels))


@query(_communities_sql())
def communities(spark, sf_dir):
    return graph.communities(_relationships(Tables(spark, sf_dir)))


@query(f"WITH RECURSIVE {UNDIRECTED}, {BOTH_WAYS}, {_components_sql()} SELECT name, component FROM cc")
def connected_components(spark, sf_dir):
    return graph.components(_relationships(Tables(spark, sf_dir)))


# --- Synthesis -----------------------------------------------------------------------------------------------------------
@query(f"WITH {REP} SELECT triplet_id, subject, predicate, object, statement, source_document_id, confidence, extraction_iteration, subject_degree, object_degree, subject_top, object_top, rank FROM rep")
def representative_triplets(spark, sf_dir):
    return synthesis.representative_triplets(*Tables(spark, sf_dir).ect()).drop("evidence", "source_url")


PILLARS = REP + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY disputed DESC, degree DESC, centrality DESC, confidence DESC, source_count DESC, lower(canonical_name), canonical_name) AS i FROM top),
ts AS (SELECT list({'rank': rank, 'id': triplet_id, 's': subject, 'o': object, 'p': predicate} ORDER BY rank) AS ts FROM rep),
walk(i, used, n, anchor, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], 0, NULL::VARCHAR, NULL::STRUCT(id VARCHAR, p VARCHAR)[] UNION ALL
  SELECT r.i, CASE WHEN w.n < 4 THEN list_concat(w.used, list_transform(t, lambda x: x.id)) ELSE w.used END, w.n + (w.n < 4 AND len(t) > 0)::INT, CASE WHEN w.n < 4 AND len(t) > 0 THEN r.canonical_name END, t
  FROM walk w JOIN ranked r ON r.i = w.i + 1, LATERAL (SELECT list_transform(list_filter(ts, lambda x: (x.s = r.canonical_name OR x.o = r.canonical_name) AND NOT list_contains(w.used, x.id))[1:4], lambda x: {'id': x.id, 'p': x.p}) AS t FROM ts)),
made AS (SELECT n AS pillar, anchor AS anchor_entity, i, taken FROM walk WHERE anchor IS NOT NULL)"""


def _firsts(column: str, k: int) -> str:
    """The first k distinct values of a list, in its order."""
    return f"array_to_string(list_filter({column}, lambda x, j: list_position({column}, x) = j)[1:{k}], ', ')"


@query(f"""WITH RECURSIVE {PILLARS} SELECT pillar, anchor_entity, anchor_entity || ' - ' || {_firsts("ps", 2)} AS title_hint, {_firsts("ps", 3)} AS predicate_hints, array_to_string(list_transform(taken, lambda x: x.id), ';') AS triplet_ids
FROM (SELECT *, list_transform(taken, lambda x: x.p) AS ps FROM made)
UNION ALL SELECT 1, ts[1].s, 'Primary graph relationships', {_firsts("list_transform(ts[1:4], lambda x: x.p)", 3)}, array_to_string(list_transform(ts[1:4], lambda x: x.id), ';') FROM ts WHERE len(ts) > 0 AND NOT EXISTS (SELECT 1 FROM made)""")
def candidate_pillars(spark, sf_dir):
    e, t, c = Tables(spark, sf_dir).ect()
    nodes = cut(graph.nodes(e, t, c), "nodes")
    top = cut(synthesis.top_entities(e, t, c, nodes=nodes), "top")
    return synthesis.pillars(synthesis.representative_triplets(e, t, c, top=top, nodes=nodes), top)


@query("""SELECT contradiction_id, topic, severity, status FROM contradiction_records ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'investigating' THEN 1 WHEN 'accepted_uncertainty' THEN 2 WHEN 'resolved' THEN 3 ELSE 99 END,
CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 99 END, lower(coalesce(topic, '')), contradiction_id LIMIT 5""")
def top_contradictions(spark, sf_dir):
    return synthesis.select_contradictions(Tables(spark, sf_dir).contradiction_records).select("contradiction_id", "topic", "severity", "status")


@query("""SELECT gap_id, question, priority, status FROM research_gaps ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'investigating' THEN 1 WHEN 'resolved' THEN 2 ELSE 99 END,
CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END, coalesce(created_iteration, 0), gap_id LIMIT 5""")
def top_gaps(spark, sf_dir):
    return synthesis.select_gaps(Tables(spark, sf_dir).research_gaps).select("gap_id", "question", "priority", "status")


@query(f"""WITH {REP}, cons AS (SELECT * FROM contradiction_records ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'investigating' THEN 1 WHEN 'accepted_uncertainty' THEN 2 WHEN 'resolved' THEN 3 ELSE 99 END,
CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 99 END, lower(coalesce(topic, '')), contradiction_id LIMIT 5),
refs AS (SELECT DISTINCT id FROM (SELECT source_document_id AS id FROM rep UNION ALL SELECT source_document_id_a FROM cons UNION ALL SELECT source_document_id_b FROM cons) WHERE id <> ''),
d AS (SELECT document_id, title, url, query, acquisition_method, retrieved_at FROM source_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY coalesce(retrieved_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), coalesce(url, '')) = 1)
SELECT document_id, title, url, query, acquisition_method FROM d WHERE document_id IN (SELECT id FROM refs) OR (SELECT count(*) FROM refs) = 0 ORDER BY retrieved_at NULLS LAST, document_id LIMIT 10""")
def document_index(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return synthesis.document_index(t.source_documents, synthesis.representative_triplets(*t.ect()), synthesis.select_contradictions(t.contradiction_records))


@query()
def writer_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return synthesis.writer_context(t.source_documents, *t.ect(), t.research_gaps)


# --- Registry and critic -------------------------------------------------------------------------------------------------
def _mentions(t: Tables) -> DataFrame:
    e = t.entity_records.select(F.col("canonical_name").alias("name"), "type", "aliases", "description", F.explode_outer("source_document_ids").alias("document_id"), F.lit(0).alias("kind"))
    s = t.triplet_records.select(F.col("subject").alias("name"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("description"), F.col("source_document_id").alias("document_id"), F.lit(1).alias("kind"))
    return e.unionByName(s).withColumn("key", F.sha1(F.concat_ws("\u0001", "name", "document_id", "description", F.array_join("aliases", "\u0001"), F.coalesce("type", F.lit("")))))


@query("""WITH m AS (SELECT canonical_name AS name, type, aliases, description, unnest(CASE WHEN coalesce(len(source_document_ids), 0) = 0 THEN [NULL] ELSE source_document_ids END) AS doc, 0 AS kind FROM entity_records
  UNION ALL SELECT subject, NULL, [], '', source_document_id, 1 FROM triplet_records),
k AS (SELECT trim(name, ' ') AS name, type, coalesce(aliases, []) AS aliases, description, doc, kind, sha1(concat_ws(chr(1), name, doc, description, array_to_string(aliases, chr(1)), coalesce(type, ''))) AS key FROM m WHERE trim(name, ' ') <> ''),
g AS (SELECT name, first(type ORDER BY kind, key) AS type, first(description ORDER BY kind, key) FILTER (description <> '') AS d, first(description ORDER BY kind, key) AS d0, first(aliases ORDER BY kind, key) AS a0, count(*) AS n,
  count(DISTINCT doc) FILTER (doc <> '') AS documents FROM k GROUP BY name)
SELECT name AS canonical_name, type, coalesce(d, d0) AS description, documents FROM g""")
def entity_upsert(spark, sf_dir):
    u = registry.upsert_entities(_mentions(Tables(spark, sf_dir)), ["kind", "key"])
    return u.select("canonical_name", "type", "description", F.size("source_document_ids").cast("long").alias("documents"))


@query("""SELECT subject, arg_max(predicate, (coalesce(extraction_iteration, -1), triplet_id, predicate, object)) AS predicate, arg_max(object, (coalesce(extraction_iteration, -1), triplet_id, predicate, object)) AS object FROM triplet_records WHERE subject IS NOT NULL GROUP BY subject""")
def replace_by_key(spark, sf_dir):
    t = Tables(spark, sf_dir).triplet_records.select("subject", "predicate", "object", "triplet_id", F.coalesce("extraction_iteration", F.lit(-1)).alias("it"))
    return registry.replace_entities(t, "subject", ["it", "triplet_id", "predicate", "object"]).select("subject", "predicate", "object")


@query("""SELECT document_id, source_type FROM source_documents d WHERE document_id <> '' AND NOT EXISTS (SELECT 1 FROM triplet_records t WHERE t.source_document_id = d.document_id)""")
def unanalysed_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return registry.unanalysed(t.source_documents, t.triplet_records).select("document_id", "source_type")


LAST = "(SELECT max(extraction_iteration) FROM triplet_records)"


STATEMENTS = f"""fresh AS (SELECT DISTINCT subject, predicate, object AS claim_b FROM triplet_records WHERE extraction_iteration = {LAST} AND subject <> '' AND predicate <> '' AND object <> ''),
old AS (SELECT DISTINCT subject, predicate, object AS claim_a FROM triplet_records WHERE extraction_iteration IS DISTINCT FROM {LAST} AND subject <> '' AND predicate <> '' AND object <> '')"""


def _new_and_existing(t: Tables) -> tuple[DataFrame, DataFrame]:
    last = t.triplet_records.agg(F.max("extraction_iteration")).first()[0]
    return critic.split_iteration(t.triplet_records, last)


@query(f"""WITH {STATEMENTS} SELECT 'con_' || left(sha1(subject || '::' || claim_a || '::' || claim_b), 16) AS contradiction_id, subject, predicate, claim_a, claim_b FROM fresh JOIN old USING (subject, predicate) WHERE claim_a <> claim_b""")
def candidate_contradictions(spark, sf_dir):
    return critic.candidate_contradictions(*_new_and_existing(Tables(spark, sf_dir)))


@query(f"""WITH {STATEMENTS}, a AS (SELECT subject, predicate, count(*) AS new_objects FROM fresh GROUP BY ALL), b AS (SELECT subject, predicate, count(*) AS existing_objects FROM old GROUP BY ALL)
SELECT subject, predicate, new_objects, existing_objects, pairs FROM (SELECT subject, predicate, count(*) AS pairs FROM fresh JOIN old USING (subject, predicate) WHERE claim_a <> claim_b GROUP BY ALL) JOIN a USING (subject, predicate) JOIN b USING (subject, predicate)""")
def contradiction_groups(spark, sf_dir):
    return critic.contradiction_groups(*_new_and_existing(Tables(spark, sf_dir)))


@query("""WITH ends AS (SELECT DISTINCT trim(name, ' ') AS name FROM (SELECT subject AS name FROM triplet_records UNION ALL SELECT object FROM triplet_records) WHERE trim(name, ' ') <> '')
SELECT 'gap_' || left(sha1('What is known about ' || name || '?'), 16) AS gap_id, 'What is known about ' || name || '?' AS question FROM ends WHERE name NOT IN (SELECT trim(canonical_name, ' ') FROM entity_records WHERE canonical_name IS NOT NULL)""")
def candidate_gaps(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return critic.candidate_gaps(t.triplet_records, t.entity_records)


@query("""WITH g AS (SELECT 'gap_' || left(sha1(question), 16) AS gap_id, question, priority FROM research_gaps)
SELECT gap_id, min(question) AS question FROM g WHERE gap_id NOT IN (SELECT gap_id FROM research_gaps WHERE status = 'resolved') GROUP BY gap_id""")
def new_gap_rows(spark, sf_dir):
    g = Tables(spark, sf_dir).research_gaps
    c = g.select(ids.gap_id(F.col("question")).alias("gap_id"), "question")
    return registry.new_rows(c, g.where("status = 'resolved'"), "gap_id", ["question"])


@query("""SELECT triplet_id, 'trip_' || left(sha1(subject || '::' || predicate || '::' || object || '::' || coalesce(source_document_id, '')), 16) AS made_id FROM triplet_records""")
def triplet_ids(spark, sf_dir):
    t = Tables(spark, sf_dir).triplet_records
    return t.select("triplet_id", ids.triplet_id(F.col("subject"), F.col("predicate"), F.col("object"), F.coalesce("source_document_id", F.lit(""))).alias("made_id"))


@query(r"""SELECT document_id, 'doc_' || left(sha1(query || '::' || url), 16) AS web_id, 'graphrag-' || left(sha1('graphrag:' || acquisition_method || ':' || query), 16) AS answer_id,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', ''), ''), 'research-run') AS slug FROM source_documents""")
def document_ids(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents
    return d.select("document_id", ids.web_document_id(F.col("query"), F.col("url")).alias("web_id"), ids.answer_document_id(F.col("acquisition_method"), F.col("query")).alias("answer_id"), ids.slug(F.col("title")).alias("slug"))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, sha256(trim(text, ' ')) AS h FROM documents WHERE trim(text, ' ') <> '')
SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h""")
def content_hash_diff(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    old = d.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.where("trim(text) <> ''").select("doc_id", F.sha2(F.trim("text"), 256).alias("h"))
    return registry.hash_diff(old, new, "doc_id", "h")


@query("""SELECT sha256(content) AS content_hash, min(document_id) AS first_id, count(DISTINCT document_id) AS copies FROM source_documents WHERE content <> '' GROUP BY 1 HAVING count(DISTINCT document_id) > 1""")
def exact_duplicates(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents.where("content <> ''").select(F.sha2("content", 256).alias("content_hash"), "document_id").distinct()
    return d.groupBy("content_hash").agg(F.min("document_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


# --- Runs ----------------------------------------------------------------------------------------------------------------
@query("""SELECT (SELECT count(*) FROM triplet_records) AS triplet_count, (SELECT count(*) FROM entity_records) AS entity_count, (SELECT count(*) FROM contradiction_records WHERE status <> 'resolved') AS open_contradiction_count,
(SELECT count(*) FROM contradiction_records WHERE status <> 'resolved' AND severity = 'high') AS high_severity_contradiction_count, (SELECT count(*) FROM research_gaps WHERE status <> 'resolved') AS open_gap_count,
(SELECT count(*) FROM triplet_records) AS new_triplets_last_iteration, 1.0 AS graph_growth_ratio""")
def run_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return routing.run_metrics(*t.ect(), t.research_gaps)


@query("""WITH p AS (SELECT coalesce(extraction_iteration, 0) AS extraction_iteration, count(*) AS new_triplets FROM triplet_records GROUP BY 1),
w AS (SELECT *, sum(new_triplets) OVER (ORDER BY extraction_iteration) AS total FROM p)
SELECT extraction_iteration, new_triplets, total::BIGINT AS triplet_count, CASE WHEN total > new_triplets THEN round(new_triplets / (total - new_triplets), 6) ELSE 1.0 END AS growth_ratio,
CASE WHEN total > new_triplets THEN round(new_triplets / (total - new_triplets), 6) ELSE 1.0 END <= 0.1 AS stable FROM w""")
def growth_by_iteration(spark, sf_dir):
    return routing.growth_by_iteration(Tables(spark, sf_dir).triplet_records)


@query("""WITH c AS (SELECT contradiction_id, 'Verify conflicting claims about ' || trim(topic, ' ') || ': ' || trim(claim_a, ' ') || ' vs ' || trim(claim_b, ' ') AS q FROM contradiction_records WHERE status <> 'resolved' AND severity = 'high' ORDER BY contradiction_id LIMIT 1),
g AS (SELECT gap_id, trim(question, ' ') AS q FROM research_gaps WHERE status <> 'resolved' ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END, gap_id LIMIT 1),
o AS (SELECT (SELECT contradiction_id FROM c) AS con, (SELECT q FROM c) AS conq, (SELECT gap_id FROM g) AS gap, (SELECT q FROM g) AS gapq)
SELECT CASE WHEN con IS NOT NULL THEN 'resolve_conflict' WHEN gap IS NOT NULL THEN 'resolve_gap' ELSE 'continue_research' END AS route, coalesce(conq, gapq, 'all') AS target_query, con AS contradiction_id, CASE WHEN con IS NULL THEN gap END AS gap_id FROM o""")
def route_decision(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = routing.run_metrics(*t.ect(), t.research_gaps)
    return routing.should_continue(m, t.contradiction_records, t.research_gaps, 1, 6, "all").drop("reason")


@query("""WITH per AS (SELECT query, document_id, max(coalesce(retrieved_at, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS seen_at FROM source_documents GROUP BY ALL)
SELECT query, document_id FROM per QUALIFY row_number() OVER (PARTITION BY query ORDER BY seen_at DESC, document_id DESC) <= 5""")
def latest_per_query(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents
    per = d.groupBy("query", "document_id").agg(F.max(F.coalesce("retrieved_at", F.lit("1970-01-01").cast("timestamp"))).alias("at"))
    return usage.tail(per, "query", ["at", "document_id"], 5).select("query", "document_id")


@query("""WITH r AS (SELECT o_custkey, max((o_orderdate, o_orderkey)) AS m FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT o_custkey AS run_group, m[2] AS latest_run FROM r""".replace("m[2]", "struct_extract_at(m, 2)"))
def latest_open_run(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.where("o_orderstatus <> 'F'")
    return o.groupBy(F.col("o_custkey").alias("run_group")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_run"))


@query("""WITH b AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents, coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events)
SELECT event_id, user_id, used::BIGINT AS used_before, used < 50000 AS allowed, (used + coalesce(cents, 0) >= 40000 AND used < 40000) AS warned FROM b""")
def budget_ledger(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return usage.ledger(e, "user_id", ["ts", "event_id"], "cents", 50000).select("event_id", "user_id", "used_before", "allowed", "warned")


@query("""SELECT user_id, event_id, CAST(event_id AS BIGINT) - lag(CAST(event_id AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events""")
def usage_deltas(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    h = e.select(F.col("user_id").alias("key_tail"), F.col("ts").alias("timestamp"), F.col("event_id").alias("ord"), F.col("event_id").alias("key_usage"), F.lit(None).cast("long").alias("credits_used"))
    return usage.usage_deltas(h).select(F.col("key_tail").alias("user_id"), F.col("ord").alias("event_id"), "delta")


@query("""SELECT user_id, count(*) AS queries, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS credits, CASE WHEN count(*) < 60 THEN 'green' WHEN count(*) < 85 THEN 'yellow' ELSE 'red' END AS light FROM events GROUP BY user_id""")
def budget_totals(spark, sf_dir):
    e = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count("*").alias("queries"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("credits"))
    return e.select("user_id", "queries", "credits", T.traffic_light(F.col("queries")).alias("light"))


@query("""SELECT acquisition_method, source_type, count(*) AS rows, count(*) FILTER (trim(content, ' ') <> '') AS converted, count(*) FILTER (coalesce(trim(content, ' '), '') = '') AS skipped FROM source_documents GROUP BY ALL""")
def conversion_counts(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents
    filled = F.trim("content") != ""
    return d.groupBy("acquisition_method", "source_type").agg(F.count("*").alias("rows"), F.count_if(filled).alias("converted"), F.count_if(~F.coalesce(filled, F.lit(False))).alias("skipped"))


# --- Projections, ingest, text -------------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT DISTINCT url, title, content AS body, CASE WHEN acquisition_method = 'tavily_raw_content' THEN content END AS raw FROM source_documents WHERE url <> ''),
e AS (SELECT url, arg_max(content, sha1(content)) AS c FROM source_documents WHERE acquisition_method = 'tavily_extract' AND url <> '' AND content <> '' GROUP BY url),
s AS (SELECT url, arg_max(content, sha1(content)) AS c FROM source_documents WHERE acquisition_method = 'playwright' AND url <> '' AND content <> '' GROUP BY url),
x AS (SELECT r.*, e.c AS extract, s.c AS scrape, coalesce(length(raw) >= 500, false) AS rich, nullif(trim(body, ' '), '') AS snippet FROM r LEFT JOIN e USING (url) LEFT JOIN s USING (url))
SELECT 'doc_' || left(sha1('all::' || url), 16) AS document_id, coalesce(nullif(trim(title, ' '), ''), url) AS title, CASE WHEN rich THEN 'tavily_raw_content' WHEN extract IS NOT NULL THEN 'tavily_extract' WHEN scrape IS NOT NULL THEN 'playwright' ELSE 'tavily_snippet' END AS acquisition_method,
  sha1(CASE WHEN rich THEN raw ELSE coalesce(extract, scrape, snippet) END) AS content_hash, CASE WHEN rich THEN 0 ELSE 1 END AS tier FROM x WHERE CASE WHEN rich THEN raw ELSE coalesce(extract, scrape, snippet) END IS NOT NULL""")
def tiered_acquisition(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents
    by = lambda m: d.where(F.col("acquisition_method") == m).select("url", "content")
    results = d.where("url <> ''").select("url", "title", F.col("content").alias("body"), F.when(F.col("acquisition_method") == "tavily_raw_content", F.col("content")).alias("raw_content")).distinct().withColumn("ord", F.lit(0))
    return acquire.tiered(results, by("tavily_extract"), by("playwright"), "all").select("document_id", "title", "acquisition_method", F.sha1("content").alias("content_hash"), "tier")


@query("""WITH l AS (SELECT DISTINCT document_id FROM source_documents WHERE source_type = 'local_resource'), x AS (SELECT trim(canonical_name, ' ') AS name, unnest(source_document_ids) AS document_id FROM entity_records)
SELECT DISTINCT name FROM x JOIN l USING (document_id) WHERE name <> '' ORDER BY lower(name), name LIMIT 5""")
def entity_hints(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return acquire.entity_hints(t.entity_records, t.source_documents)


@query("""WITH d AS (SELECT document_id, min(coalesce(url, '')) AS url FROM source_documents WHERE source_type = 'local_resource' GROUP BY 1), x AS (SELECT DISTINCT canonical_name, unnest(source_document_ids) AS document_id FROM entity_records),
e AS (SELECT document_id, string_agg(DISTINCT canonical_name, ';' ORDER BY canonical_name) AS entities FROM x GROUP BY 1),
t AS (SELECT source_document_id AS document_id, count(*) AS triplets, string_agg(DISTINCT trim(predicate, ' '), ';' ORDER BY trim(predicate, ' ')) AS predicates FROM triplet_records GROUP BY 1)
SELECT document_id, coalesce(entities, '') AS entities, coalesce(triplets, 0) AS triplets, coalesce(predicates, '') AS predicates FROM d LEFT JOIN e USING (document_id) LEFT JOIN t USING (document_id)""")
def local_resources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.source_documents.where("source_type = 'local_resource'").select("document_id").distinct()
    e = t.entity_records.select("canonical_name", F.explode("source_document_ids").alias("document_id")).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("canonical_name")), ";").alias("entities"))
    p = t.triplet_records.groupBy(F.col("source_document_id").alias("document_id")).agg(F.count("*").alias("triplets"), F.array_join(F.array_sort(F.collect_set(F.trim("predicate"))), ";").alias("predicates"))
    return d.join(e, "document_id", "left").join(p, "document_id", "left").select("document_id", F.coalesce("entities", F.lit("")).alias("entities"), F.coalesce("triplets", F.lit(0)).alias("triplets"), F.coalesce("predicates", F.lit("")).alias("predicates"))


@query("""WITH x AS (SELECT subject AS name, triplet_id FROM triplet_records UNION ALL SELECT object, triplet_id FROM triplet_records WHERE object IS DISTINCT FROM subject)
SELECT name, count(*) AS mentions, count(DISTINCT triplet_id) AS triplets FROM x WHERE name IS NOT NULL GROUP BY name""")
def triplets_by_entity(spark, sf_dir):
    t = Tables(spark, sf_dir).triplet_records.select("triplet_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("name")).where("name IS NOT NULL")
    return t.groupBy("name").agg(F.count("*").alias("mentions"), F.count_distinct("triplet_id").alias("triplets"))


@query(r"""SELECT document_id, nullif(trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), '') AS stripped FROM source_documents WHERE content IS NOT NULL""")
def html_strip(spark, sf_dir):
    return Tables(spark, sf_dir).source_documents.where("content IS NOT NULL").select("document_id", T.strip_html(F.col("content")).alias("stripped"))


@query(r"""SELECT document_id, left(array_to_string(list_filter(list_transform(regexp_split_to_array(content, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: x <> ''), chr(10)), 20000) AS cleaned FROM source_documents WHERE content IS NOT NULL""")
def clean_lines(spark, sf_dir):
    return Tables(spark, sf_dir).source_documents.where("content IS NOT NULL").select("document_id", T.clean_lines(F.col("content")).alias("cleaned"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 0 AND length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]', '', 'g')) / greatest(length(text), 1) > 0.30 THEN 'zh' ELSE 'en' END AS language FROM documents""")
def detect_language(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(r"""SELECT doc_id, coalesce(length(text) > 0 AND length(regexp_replace(left(text, 1024), '[^\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]', '', 'g')) / greatest(length(left(text, 1024)), 1) > 0.3, false) AS is_binary,
  coalesce(length(regexp_replace(text, '[ \t\n\r\f\v''".,;:!?\-–—()\[\]{}|/]', '', 'g')), 0) < greatest(500, (strlen(text) // 50000) * 500) AS is_sparse FROM documents""")
def text_quality_flags(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", T.looks_binary(F.col("text")).alias("is_binary"), T.pdf_text_is_sparse(F.col("text"), F.octet_length("text")).alias("is_sparse"))


@query("""SELECT doc_id, (i + 1)::INT AS part, substr(text, i * 1000 + 1, 1000) AS shard FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT) - 1, 0))) AS i FROM documents WHERE text IS NOT NULL)""")
def shard_text(spark, sf_dir):
    return ingest.shard_rows(Tables(spark, sf_dir).documents, "doc_id", "text", 1000).select("doc_id", "part", "shard")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 20, 1), 100)) AS s FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s))::INT AS chunk, sha1(array_to_string(list_slice(ws, s, s + 119), ' ')) AS chunk_hash FROM c""")
def token_chunks(spark, sf_dir):
    return ingest.chunk_rows(Tables(spark, sf_dir).documents, "doc_id", "text", 120, 20).select("doc_id", "chunk", F.sha1("chunk_text").alias("chunk_hash"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i < len(string_split(text, chr(10))) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
f(doc_id, ls, i, part, cur) AS (SELECT doc_id, ls, 1, 1, ls[1] FROM l WHERE len(ls) > 0 UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN length(cur) + length(ls[i + 1]) <= 2000 THEN part ELSE part + 1 END, CASE WHEN length(cur) + length(ls[i + 1]) <= 2000 THEN cur || ls[i + 1] ELSE ls[i + 1] END FROM f WHERE i < len(ls))
SELECT doc_id, part, length(p)::INT AS n, sha1(p) AS part_hash FROM (SELECT doc_id, part, arg_max(cur, i) AS p FROM f GROUP BY ALL)""")
def line_parts(spark, sf_dir):
    return ingest.line_parts(Tables(spark, sf_dir).documents, "doc_id", "text", 2000).select("doc_id", "part", F.length("part_text").alias("n"), F.sha1("part_text").alias("part_hash"))


def _sql_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(rf"""WITH p AS (SELECT document_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM source_documents WHERE url IS NOT NULL),
e AS (SELECT document_id, path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)) AS ext FROM p)
SELECT document_id, ext, CASE WHEN ext = '.mobi' THEN 'mobi' WHEN ext IN {_sql_list(ingest.EXCEL)} THEN 'excel' WHEN ext = '.zip' THEN 'zip' WHEN ext = '.rar' THEN 'rar' WHEN ext IN {_sql_list(ingest.SLIDES)} THEN 'slides'
 WHEN ext IN {_sql_list(ingest.LEGACY_OFFICE)} THEN 'legacy_office' WHEN ext IN {_sql_list(ingest.PLAINTEXT)} THEN 'plain' WHEN ext IN {_sql_list(ingest.RICH)} THEN 'rich' WHEN ext IN {_sql_list(ingest.CODE)} THEN 'plain'
 WHEN ext IN {_sql_list(ingest.SKIP + ingest.IMAGES + ingest.MEDIA)} THEN 'skip' ELSE 'fallback' END AS class FROM e""")
def route_files(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents.where("url IS NOT NULL")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return d.select("document_id", path.alias("path")).select("document_id", ingest.extension(F.col("path")).alias("ext"), ingest.route(F.col("path")).alias("class"))


@query(r"""SELECT DISTINCT url, len(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: regexp_matches(p, '^(news|[^/]*\.html)'))) > 0 AS ignored FROM source_documents WHERE url IS NOT NULL""")
def ignored_paths(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents.where("url IS NOT NULL").select("url").distinct()
    return d.select("url", ingest.ignored(F.regexp_replace("url", "^[a-z]+://", ""), ["news", "*.html"]).alias("ignored"))


@query(r"""SELECT gap_id, concat_ws(' ', nullif(trim(question, ' '), ''), nullif(trim(trigger, ' '), '')) AS statement, replace('Find out: ${question} (${other})', '${question}', coalesce(question, '')) AS prompt,
 replace(replace(replace(replace(replace(question, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM research_gaps""")
def text_rendering(spark, sf_dir):
    g = Tables(spark, sf_dir).research_gaps
    return g.select("gap_id", T.statement(F.col("question"), F.col("trigger"), F.lit(None).cast("string")).alias("statement"), T.substitute(F.lit("Find out: ${question} (${other})"), {"question": F.col("question")}).alias("prompt"), T.escape_html(F.col("question")).alias("html"))


@query("""SELECT source_type, acquisition_method, map_contains(metadata, 'ingested_at') AS dated, count(*) AS rows FROM (SELECT CASE WHEN source_type = '' THEN 'web' ELSE coalesce(source_type, 'web') END AS source_type, coalesce(acquisition_method, 'unknown') AS acquisition_method, coalesce(metadata, MAP {}) AS metadata FROM source_documents) GROUP BY ALL""")
def default_filled_documents(spark, sf_dir):
    d = conform(Tables(spark, sf_dir).source_documents.withColumn("source_type", F.nullif("source_type", F.lit(""))), "documents")
    return d.groupBy("source_type", "acquisition_method", F.map_contains_key("metadata", "ingested_at").alias("dated")).agg(F.count("*").alias("rows"))


@query("""SELECT CASE WHEN severity IN ('low', 'high') THEN severity ELSE 'low' END AS severity, coalesce(status, 'open') AS status, count(*) AS rows FROM contradiction_records GROUP BY ALL""")
def enum_normalised(spark, sf_dir):
    return conform(Tables(spark, sf_dir).contradiction_records, "contradictions").groupBy("severity", "status").agg(F.count("*").alias("rows"))


@query(r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '(?s)(\{.*\})', 1) AS span FROM documents WHERE doc_kind = 'payload'),
j AS (SELECT doc_id, CASE WHEN json_valid(text) AND starts_with(trim(text, ' '), '{') THEN text::JSON WHEN json_valid(span) AND span <> '' THEN span::JSON END AS j FROM d),
p AS (SELECT doc_id, j, coalesce(json_extract(j, '$.entities[*]'), []) AS e, coalesce(json_extract(j, '$.triplets[*]'), []) AS t FROM j),
v AS (SELECT *, j IS NOT NULL AND len(list_filter(e, lambda x: json_extract_string(x, '$.canonical_name') IS NULL)) = 0
  AND len(list_filter(t, lambda x: json_extract_string(x, '$.subject') IS NULL OR json_extract_string(x, '$.predicate') IS NULL OR json_extract_string(x, '$.object') IS NULL OR json_extract_string(x, '$.evidence') IS NULL)) = 0 AS ok FROM p)
SELECT doc_id, ok AS valid, CASE WHEN ok THEN len(e) ELSE NULL END::INT AS entities, CASE WHEN ok THEN len(t) ELSE NULL END::INT AS triplets FROM v""")
def payload_parse(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.where("doc_kind = 'payload'")
    return parsing.parse_extraction(d, "doc_id", "text").select("doc_id", "valid", F.when(F.col("valid"), F.size("entities")).alias("entities"), F.when(F.col("valid"), F.size("triplets")).alias("triplets"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT document_id, CASE WHEN regexp_matches(lower(title), '404|403|401|invalid url|net::err_name_not_resolved|net::err_aborted') THEN 'permanent'
 WHEN regexp_matches(lower(title), 'timeout|timed out|connection reset|connection refused|dns|network|eof occurred|broken pipe|temporarily unavailable|429|503') THEN 'transient' ELSE 'other' END AS class,
 coalesce(regexp_matches(lower(title), 'quota|rate.?limit|daily.?limit|limit.?exceeded|too.?many.?request|429'), false) AS quota FROM source_documents""")
def error_classes(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents
    return d.select("document_id", T.error_class(F.col("title")).alias("class"), T.quota_error(F.col("title")).alias("quota"))


@query("""WITH c AS (SELECT coalesce(acquisition_method, '') AS method, coalesce(source_type, '') AS kind, count(*) FILTER (query IS NULL) AS processes, count(*) FILTER (content <> '' AND title IS NOT NULL) AS outputs, count(*) FILTER (title IS NOT NULL) AS inputs, count(*) FILTER (url <> '') AS settings FROM source_documents GROUP BY ALL),
x AS (SELECT * FROM c UNION ALL SELECT 'busy', '', 1, outputs, inputs, settings FROM c UNION ALL SELECT 'waiting', '', 0, 0, inputs, settings FROM c UNION ALL SELECT 'configured', '', 0, 0, 0, settings FROM c UNION ALL SELECT 'new', '', 0, 0, 0, 0 FROM c)
SELECT method, processes, outputs, inputs, settings, CASE WHEN processes > 0 THEN 'RUNNING' WHEN outputs > 0 THEN 'IDLE_WITH_OUTPUT' WHEN inputs > 0 THEN 'READY_TO_INDEX' WHEN settings > 0 THEN 'INITIALIZED' ELSE 'NOT_INITIALIZED' END AS status FROM x""")
def job_status(spark, sf_dir):
    """Groups of documents as jobs, and each of them again with what it has taken away step by step: all five states occur."""
    d = Tables(spark, sf_dir).source_documents
    c = d.groupBy(F.coalesce("acquisition_method", F.lit("")).alias("method"), F.coalesce("source_type", F.lit("")).alias("kind")).agg(
        F.count_if(F.col("query").isNull()).alias("processes"), F.count_if((F.col("content") != "") & F.col("title").isNotNull()).alias("outputs"),
        F.count_if(F.col("title").isNotNull()).alias("inputs"), F.count_if(F.col("url") != "").alias("settings"),
    )
    zero = F.lit(0).cast("long")
    step = lambda name, **kept: c.select(F.lit(name).alias("method"), "kind", *[kept.get(x, F.col(x)).alias(x) for x in ("processes", "outputs", "inputs", "settings")])
    rows = [step("busy", processes=F.lit(1).cast("long")), step("waiting", processes=zero, outputs=zero), step("configured", processes=zero, outputs=zero, inputs=zero), step("new", processes=zero, outputs=zero, inputs=zero, settings=zero)]
    for r in rows:
        c = c.unionByName(r)
    return jobs.job_status(c).select("method", "processes", "outputs", "inputs", "settings", "status")


@query("""WITH o AS (SELECT (SELECT min(contradiction_id) FROM contradiction_records WHERE status <> 'resolved' AND severity = 'high') AS con, (SELECT gap_id FROM research_gaps WHERE status <> 'resolved' ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END, gap_id LIMIT 1) AS gap)
SELECT 'capped' AS scenario, 'finalize' AS route, NULL AS contradiction_id, NULL AS gap_id UNION ALL SELECT 'conflict', CASE WHEN con IS NOT NULL THEN 'resolve_conflict' WHEN gap IS NOT NULL THEN 'resolve_gap' ELSE 'continue_research' END, con, CASE WHEN con IS NULL THEN gap END FROM o
UNION ALL SELECT 'no conflict', CASE WHEN gap IS NOT NULL THEN 'resolve_gap' ELSE 'continue_research' END, NULL, gap FROM o UNION ALL SELECT 'saturated', 'finalize', NULL, NULL UNION ALL SELECT 'growing', 'continue_research', NULL, NULL""")
def route_branches(spark, sf_dir):
    """The decision in five situations: at the cap, with open conflicts, without them, saturated without gaps, growing without gaps."""
    t = Tables(spark, sf_dir)
    c, g, total = t.contradiction_records, t.research_gaps, t.triplet_records.count()
    def case(name: str, cons: DataFrame, gaps: DataFrame, iteration: int, previous: int = 0) -> DataFrame:
        m = routing.run_metrics(t.entity_records, t.triplet_records, cons, gaps, previous)
        return routing.should_continue(m, cons, gaps, iteration, 6, "all").select(F.lit(name).alias("scenario"), "route", "contradiction_id", "gap_id")
    none, closed = c.where("severity <> 'high' OR severity IS NULL"), g.where("status = 'resolved'")
    cases = [case("capped", c, g, 6), case("conflict", c, g, 1), case("no conflict", none, g, 1), case("saturated", none, closed, 1, max(1, total - total // 20)), case("growing", none, closed, 1)]
    out = cases[0]
    for x in cases[1:]:
        out = out.unionByName(x)
    return out


@query("""SELECT extraction_iteration, count(*) AS triplets, count(*) FILTER (subject <> '' AND predicate <> '' AND object <> '') AS complete, count(*) FILTER (source_document_id IS NULL) AS unsourced FROM triplet_records GROUP BY 1""")
def triplet_completeness(spark, sf_dir):
    t = Tables(spark, sf_dir).triplet_records
    full = (F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != "")
    return t.groupBy("extraction_iteration").agg(F.count("*").alias("triplets"), F.count_if(full).alias("complete"), F.count_if(F.col("source_document_id").isNull()).alias("unsourced"))


# --- Index build and runs of it --------------------------------------------------------------------------------------------
UNITS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 100, 1), 1100)) AS s FROM w),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk, array_to_string(list_slice(ws, s, s + 1199), ' ') AS text FROM c),
m AS (SELECT doc_id, chunk, generate_subscripts(ms, 1) AS pos, unnest(ms) AS title FROM (SELECT doc_id, chunk, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS ms FROM units))"""


@query(f"WITH {UNITS} SELECT sha1(doc_id || chr(1) || chunk) AS id, doc_id::VARCHAR AS document_id, chunk::INT AS chunk, sha1(text) AS text_hash FROM units")
def index_text_units(spark, sf_dir):
    return index.text_units(Tables(spark, sf_dir).documents, "doc_id", "text").select("id", "document_id", "chunk", F.sha1("text").alias("text_hash"))


@query(f"WITH {UNITS} SELECT title, count(*) AS frequency, count(DISTINCT (doc_id, chunk)) AS units FROM m GROUP BY title")
def index_entities(spark, sf_dir):
    return index.index_entities(index.text_units(Tables(spark, sf_dir).documents, "doc_id", "text"))


@query(f"WITH {UNITS}, n AS (SELECT title, lead(title) OVER (PARTITION BY doc_id, chunk ORDER BY pos) AS nx FROM m) SELECT least(title, nx) AS source, greatest(title, nx) AS target, count(*) AS weight FROM n WHERE nx <> title GROUP BY ALL")
def index_relationships(spark, sf_dir):
    return index.index_relationships(index.text_units(Tables(spark, sf_dir).documents, "doc_id", "text"))


@query("""SELECT count(*) FILTER (content <> '') AS completed, count(*) FILTER (content IS NULL OR content = '') AS failed, coalesce(string_agg(document_id || ': no content', '; ' ORDER BY document_id) FILTER (content IS NULL OR content = ''), '') AS errors FROM (SELECT DISTINCT document_id, content FROM source_documents WHERE document_id IS NOT NULL)""")
def index_outcome(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents.where("document_id IS NOT NULL").select("document_id", "content").distinct()
    return index.outcome(d.select(F.col("document_id").alias("step"), F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.lit("no content")).alias("error")))


@query("""SELECT document_id AS pid, '/data/' || acquisition_method AS root, nullif(split_part(query, ' ', 1), '') AS method FROM source_documents WHERE acquisition_method <> '' AND NOT contains(query, '"')""")
def command_arguments(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents.where("acquisition_method <> '' AND NOT contains(query, '\"')")
    p = d.select(F.col("document_id").alias("pid"), F.concat(F.lit('python -m tool index --root "/data/'), "acquisition_method", F.lit('" --method '), "query", F.lit(" --verbose")).alias("command"))
    return index.command_arguments(p).select("pid", "root", "method")


@query("""SELECT source AS path, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY source""".replace("AS text FROM", "AS text FROM"))
def grouped_parts(spark, sf_dir):
    return index.group_parts(Tables(spark, sf_dir).documents.select(F.col("source").alias("path"), F.col("doc_id").alias("part"), "text"))


@query("""WITH h AS (SELECT document_id, content, CASE WHEN length(content) > 3000 THEN ceil(length(content) / 3000.0)::INT ELSE 1 END AS parts FROM (SELECT DISTINCT document_id, content FROM source_documents WHERE content IS NOT NULL AND document_id IS NOT NULL)),
p AS (SELECT *, unnest(generate_series(1, parts)) AS part FROM h)
SELECT document_id, part::INT AS part, sha1('Source: ' || document_id || '.txt' || chr(10) || 'Path: in/' || document_id || '.txt' || chr(10) || 'Format: txt' || chr(10) || '---' || chr(10) || chr(10) || substr(content, (part - 1) * 3000 + 1, 3000)) AS text_hash FROM p""")
def part_files(spark, sf_dir):
    d = Tables(spark, sf_dir).source_documents.where("content IS NOT NULL AND document_id IS NOT NULL").select("document_id", "content").distinct()
    files = index.part_files(d.select(F.concat(F.lit("in/"), "document_id", F.lit(".txt")).alias("path"), F.col("content").alias("text")), 3000)
    return files.select(F.regexp_extract("text", "^Source: (.*)\\.txt\n", 1).alias("document_id"), F.coalesce(F.regexp_extract("name", r"_part(\d+)\.txt$", 1).try_cast("int"), F.lit(1)).alias("part"), F.sha1("text").alias("text_hash"))


# --- Search --------------------------------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query_id, v.vec_id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM q JOIN embeddings v ON true)
SELECT query_id, vec_id, rank::INT AS rank FROM s WHERE rank <= 10""")
def vector_top_k(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return search.vector_top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)


def _score_sql(column: str, question: str) -> str:
    """Share of the question's words (over two letters) among the distinct words of a text."""
    terms = search.terms(question)
    return rf"round(len(list_intersect(list_distinct(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+')), {terms!r})) / {len(terms)}.0, 6)"


ASKED = "interest rate in Valagrad"


@query(f"""WITH u AS (SELECT document_id AS id, max({_score_sql("content", ASKED)}) AS score FROM source_documents WHERE content <> '' GROUP BY document_id)
SELECT id, score FROM u WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def basic_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    units = t.source_documents.where("content <> ''").select(F.col("document_id").alias("id"), F.col("content").alias("text")).dropDuplicates(["id"])
    return search.basic(units, ASKED)


NEAR = "Kelisibamet Motors Partners and its suppliers"


@query(f"""WITH e AS (SELECT canonical_name AS entity, max({_score_sql("concat_ws(' ', canonical_name, array_to_string(coalesce(aliases, []), ' '), description)", NEAR)}) AS score FROM entity_records WHERE canonical_name IS NOT NULL GROUP BY 1),
near AS (SELECT * FROM e WHERE score > 0 ORDER BY score DESC, entity LIMIT 8),
ends AS (SELECT triplet_id, subject, predicate, object, source_document_id, coalesce(confidence, 0.0) AS confidence, unnest(list_distinct([subject, object])) AS entity FROM triplet_records),
best AS (SELECT DISTINCT ON (triplet_id) * FROM ends JOIN near USING (entity) ORDER BY triplet_id, score DESC, confidence DESC, entity DESC, subject DESC, object DESC),
top AS (SELECT * FROM best ORDER BY score DESC, confidence DESC, triplet_id LIMIT 20), d AS (SELECT document_id, min(title) AS title FROM source_documents GROUP BY 1)
SELECT entity, triplet_id, concat_ws(' ', subject, predicate, object) AS statement, source_document_id AS document_id, title, score FROM top LEFT JOIN d ON d.document_id = top.source_document_id""")
def local_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.local(t.entity_records, t.triplet_records, t.source_documents, NEAR)


@query()
def global_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.global_search(search.community_reports(graph.communities(_relationships(t)), t.triplet_records), "who competes with Kelisibamet Motors", 2)


# --- Beyond the reference: windows over events ------------------------------------------------------------------------------
@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events),
h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM h GROUP BY user_id, session""")
def session_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_items(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
