"""The research loop: Scout, Analyst, Critic, Router, until the router ends it; then the Writer.

The state is a set of Parquet relations. Each round appends a partition and cuts the lineage by writing; the driver reads one
row of the router. Search and extraction are callables, so all of it runs offline.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.exports.graph_files import dot, dumps, graph_json, graphml, html_viewer, report_from_context, write_lines
from evigraph.operators import critic, graph, registry, synthesis
from evigraph.plans import routing
from evigraph.runtime import cut
from evigraph.schemas import conform, empty
from evigraph.sources.fs import Files

RELATIONS = ("documents", "entities", "triplets", "contradictions", "research_gaps", "route_history")


@dataclass
class Config:
    """Limits of a run; environment variables EVIGRAPH_<NAME> override them."""

    max_iterations: int = 6
    saturation: float = routing.SATURATION
    conflicts: bool = True
    gap_resolution: bool = True
    mark_investigating: bool = False

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        out = cls()
        for name, kind in (("max_iterations", int), ("saturation", float), ("conflicts", bool), ("gap_resolution", bool), ("mark_investigating", bool)):
            raw = env.get(f"EVIGRAPH_{name.upper()}")
            if raw is None:
                continue
            try:
                setattr(out, name, raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw))
            except ValueError:
                pass  # an unreadable value leaves the default
        return out


@dataclass
class Budget:
    """Guard of calls on the driver: asked before a call, told after it."""

    max_queries: int = 0
    max_credits: float = 0
    warn: float = 0.8
    queries: int = 0
    credits: float = 0
    dry_run: bool = False
    quota_reached: bool = False
    warned: bool = False

    def can_query(self) -> bool:
        return not (self.dry_run or self.quota_reached or 0 < self.max_queries <= self.queries or 0 < self.max_credits <= self.credits)

    def record(self, credits: float = 1) -> bool:
        """Counts a call; true the one time that the share used reaches the warning."""
        self.queries, self.credits = self.queries + 1, self.credits + credits
        first = not self.warned and self.used_fraction() >= self.warn
        self.warned |= first
        return first

    def used_fraction(self) -> float:
        return max([0.0, *(u / m for u, m in ((self.queries, self.max_queries), (self.credits, self.max_credits)) if m > 0)])


@dataclass
class State:
    query: str
    relations: dict[str, DataFrame]
    iteration: int = 0
    previous_triplets: int = 0
    route: str = ""
    extra: dict = field(default_factory=dict)


def initial_state(spark: SparkSession, query: str, **relations: DataFrame) -> State:
    if not query.strip():
        raise ValueError("the query must not be empty")
    return State(query, {r: conform(relations[r], r) if r in relations else empty(spark, r) for r in RELATIONS})


def merge_state(state: State, **updates: DataFrame) -> State:
    """Appends to the append-only relations; entities are replaced by name, the update last."""
    out = dict(state.relations)
    for name, df in updates.items():
        new = conform(df, name)
        if name == "entities":
            both = out[name].withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
            out[name] = registry.replace_entities(both, "canonical_name", ["_o"]).drop("_o").select(*new.columns)
        else:
            out[name] = registry.append(out[name], new)
    return State(state.query, out, state.iteration, state.previous_triplets, state.route, state.extra)


class RunStore:
    """Folder of a run: a manifest, and a folder of relations per iteration."""

    def __init__(self, spark: SparkSession, base: str, run_id: str) -> None:
        self.spark, self.folder, self.run_id, self.files = spark, f"{base}/{run_id}", run_id, Files(spark)
        self.files.make(self.folder)

    @classmethod
    def latest_resumable(cls, spark: SparkSession, base: str, query: str) -> RunStore | None:
        """The last run by name of the same query that has not been completed."""
        files = Files(spark)
        for name in reversed(files.names(base)):
            path = f"{base}/{name}/manifest.json"
            if files.exists(path):
                m = json.loads(files.read(path))
                if m.get("query") == query and not m.get("completed_at"):
                    return cls(spark, base, name)
        return None

    def manifest(self) -> dict:
        path = f"{self.folder}/manifest.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {}

    def note(self, **values) -> None:
        now = datetime.now(timezone.utc).isoformat()
        text = dumps({"run_id": self.run_id, "started_at": now} | self.manifest() | values | {"updated_at": now})
        self.files.write(f"{self.folder}/manifest.json", text)

    def save(self, state: State) -> State:
        """Writes the relations of an iteration and reads them back."""
        name = f"iter-{state.iteration:03d}"
        while self.files.exists(f"{self.folder}/{name}"):  # a save may still be read by the state it came from
            name += "r"
        out = {}
        for r, df in state.relations.items():
            path = f"{self.folder}/{name}/{r}"
            df.write.mode("overwrite").parquet(path)
            out[r] = self.spark.read.schema(df.schema).parquet(path)
        files = self.manifest().get("checkpoint_files", [])
        self.note(checkpoint_files=[*files, *([name] if name not in files else [])], last_checkpoint_iteration=state.iteration, last_route=state.route, query=state.query if not state.extra.get("asked") else state.extra["asked"], previous_triplets=state.previous_triplets, current_query=state.query)
        return State(state.query, out, state.iteration, state.previous_triplets, state.route, state.extra)

    def resume(self) -> State | None:
        m = self.manifest()
        if not m.get("checkpoint_files"):
            return None
        last = m["checkpoint_files"][-1]
        self.note(resume_count=m.get("resume_count", 0) + 1, last_resumed_at=datetime.now(timezone.utc).isoformat())
        relations = {r: self.spark.read.parquet(f"{self.folder}/{last}/{r}") for r in RELATIONS}
        return State(m.get("current_query", m["query"]), relations, m["last_checkpoint_iteration"], m.get("previous_triplets", 0), m.get("last_route", ""), {"asked": m["query"]})


Acquire = Callable[[str, State], DataFrame]
Extract = Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


def final_artifacts(store: RunStore, state: State, report: str) -> list[str]:
    """Writes what a finished run leaves: its state, the report if not blank, the graph as JSON, GraphML and DOT, and a page to look at."""
    r, at = state.relations, f"{store.folder}/final"
    n, e = graph.export_nodes(r["entities"], r["triplets"], r["contradictions"]), graph.export_edges(r["entities"], r["triplets"], r["contradictions"])
    n, e = cut(n, "nodes"), cut(e, "edges")
    for name, df in r.items():
        df.write.mode("overwrite").parquet(f"{at}/state/{name}")
    for name, lines in (("graph.json", graph_json(n, e)), ("graph.graphml", graphml(n, e)), ("graph.dot", dot(n, e))):
        write_lines(lines, f"{at}/{name}")
    places = graph.layout(graph.nodes(r["entities"], r["triplets"], r["contradictions"]))
    store.files.write(f"{at}/graph.html", html_viewer(state.extra.get("asked", state.query), places, r["contradictions"], r["research_gaps"], r["documents"].where("source_type = 'local_resource'")))
    if report.strip():
        store.files.write(f"{store.folder}/report.md", report)
    return ["state", "graph.json", "graph.graphml", "graph.dot", "graph.html", *(["report.md"] if report.strip() else [])]


def step(state: State, acquire: Acquire, extract: Extract, config: Config, store: RunStore) -> State:
    """One round: documents, triplets and entities of what is new, candidate conflicts and gaps, and the route."""
    state.iteration += 1
    old_triplets = state.relations["triplets"]
    count = old_triplets.count()
    state = merge_state(state, documents=acquire(state.query, state))
    entities, triplets = extract(registry.unanalysed(state.relations["documents"], old_triplets), state.iteration)
    state = merge_state(state, entities=entities, triplets=triplets)
    new, _ = critic.split_iteration(state.relations["triplets"], state.iteration)
    found = critic.candidate_contradictions(new, old_triplets)
    rows = found.select("contradiction_id", F.concat_ws(" ", "subject", "predicate").alias("topic"), "claim_a", "claim_b")
    gaps = critic.candidate_gaps(new, state.relations["entities"]).withColumn("created_iteration", F.lit(state.iteration)).withColumn("trigger", F.lit("missing entity"))
    state = merge_state(
        state, contradictions=registry.new_rows(rows, state.relations["contradictions"], "contradiction_id", ["topic", "claim_a", "claim_b"]),
        research_gaps=registry.new_rows(gaps, state.relations["research_gaps"], "gap_id", ["question"]),
    )
    state.previous_triplets = count
    state = store.save(state)
    r = state.relations
    m = routing.run_metrics(r["entities"], r["triplets"], r["contradictions"], r["research_gaps"], count)
    d = routing.should_continue(m, r["contradictions"], r["research_gaps"], state.iteration, config.max_iterations, state.query, config.conflicts, config.gap_resolution, config.saturation).first()
    spark = r["triplets"].sparkSession
    state = merge_state(state, route_history=spark.createDataFrame([(state.iteration, d["route"], d["reason"], d["target_query"])], "iteration int, route string, reason string, target string"))
    if config.mark_investigating:
        for relation, key in (("contradictions", "contradiction_id"), ("research_gaps", "gap_id")):
            if d[key]:
                df = state.relations[relation]
                state.relations[relation] = df.withColumn("status", F.when((F.col(key) == d[key]) & (F.col("status") == "open"), "investigating").otherwise(F.col("status")))
    state.route = d["route"]
    state.extra.setdefault("asked", state.query)
    state.query = d["target_query"] or state.query
    return store.save(state)


def run(spark: SparkSession, query: str, acquire: Acquire, extract: Extract, base: str, run_id: str | None = None, config: Config | None = None) -> tuple[State, str]:
    """Runs, or resumes the last unfinished run of the query, to its end: the state and the report."""
    config = config or Config()
    store = RunStore.latest_resumable(spark, base, query)
    state = store.resume() if store else None
    if store is None:
        store = RunStore(spark, base, run_id or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ"))
        store.note(query=query, max_iterations=config.max_iterations)
    if state is None:
        state = initial_state(spark, query)
    while state.route != "finalize":
        state = step(state, acquire, extract, config, store)
    r = state.relations
    report = report_from_context(synthesis.writer_context(r["documents"], r["entities"], r["triplets"], r["contradictions"], r["research_gaps"], query))
    store.note(artifacts=final_artifacts(store, state, report), completed_at=datetime.now(timezone.utc).isoformat(), final_iteration=state.iteration)
    return state, report
