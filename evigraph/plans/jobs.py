"""Jobs around the engine: change-gated index builds with shrinking shards, steps done once, status, settings, prompts, progress."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evigraph.exports.graph_files import graphml, write_lines
from evigraph.operators import graph, ingest, registry
from evigraph.sources.files import TableProvider, file_hashes
from evigraph.sources.fs import Files

STATUS = ("RUNNING", "IDLE_WITH_OUTPUT", "READY_TO_INDEX", "INITIALIZED", "NOT_INITIALIZED")


def job_status(counts: DataFrame) -> DataFrame:
    """Adds status to rows of (processes, outputs, inputs, settings): the first of STATUS that holds."""
    c = F.when(F.col("processes") > 0, STATUS[0]).when(F.col("outputs") > 0, STATUS[1]).when(F.col("inputs") > 0, STATUS[2]).when(F.col("settings") > 0, STATUS[3]).otherwise(STATUS[4])
    return counts.withColumn("status", c)


def matching_processes(processes: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows (command) that hold one of a few given patterns."""
    test = F.lit(False)
    for p in patterns:
        test = test | F.contains("command", F.lit(p))
    return processes.where(test)


def folder_state(files: DataFrame) -> DataFrame:
    """One row: files, latest (path of the newest; ties by path)."""
    return files.agg(F.count("*").alias("files"), F.max_by("path", F.struct("modificationTime", "path")).alias("latest"))


def once(marker: str, step: Callable[[], None], spark: SparkSession | None = None) -> bool:
    """Runs a step unless its marker file is there; the marker is made when the step ends. True if it ran.

    With a session the marker may lie on any file system it can reach.
    """
    files = Files(spark) if spark else None
    if files.exists(marker) if files else os.path.exists(marker):
        return False
    step()
    if files:
        files.write(marker, str(time.time()))
        return True
    with open(marker, "w", encoding="utf-8") as f:
        f.write(str(time.time()))
    return True


def prompt(name: str, *folders: str | None) -> str:
    """The prompt file from the first folder that has it."""
    paths = [os.path.join(d, name) for d in folders if d]
    for p in paths:
        if os.path.isfile(p):
            with open(p, encoding="utf-8") as f:
                return f.read().strip()
    raise FileNotFoundError(f"no prompt {name!r} in {paths}")


@dataclass
class Settings:
    """What settings.yaml is written from."""

    provider: str = "ollama"
    model: str = "gemma4:e4b"
    api_base: str | None = None
    input_dir: str = "input"
    output_dir: str = "output"
    chunk_size: int = 1200
    chunk_overlap: int = 100
    entity_types: list[str] = field(default_factory=lambda: ["organization", "person", "technology", "concept", "event", "location"])
    max_gleanings: int = 1
    community_max_length: int = 2000
    export_graphml: bool = False
    api_key: str | None = None
    embedding_provider: str | None = None
    embedding_model: str | None = None
    embedding_base: str | None = None
    embedding_key: str | None = None

    def env(self) -> str:
        """.env: the keys that settings.yaml refers to; a provider on this machine needs none."""
        keys = {"GRAPHRAG_API_KEY": self.api_key, "GRAPHRAG_EMBEDDING_API_KEY": self.embedding_key or self.api_key}
        return "".join(f"{k}={v}\n" for k, v in keys.items() if v)

    def model_blocks(self) -> dict[str, dict[str, str | None]]:
        """The model that reads and the one that embeds; the second takes what it lacks from the first."""
        local = self.provider == "ollama"
        base = self.api_base or ("http://localhost:11434" if local else None)
        chat = {"provider": self.provider, "model": self.model, "api_base": base, "api_key": None if local else "${GRAPHRAG_API_KEY}"}
        other = self.embedding_provider or self.provider
        embed = {"provider": other, "model": self.embedding_model or self.model, "api_base": self.embedding_base or (base if other == self.provider else None), "api_key": None if other == "ollama" else "${GRAPHRAG_EMBEDDING_API_KEY}"}
        return {"completion": chat, "embedding": embed}

    def text(self) -> str:
        """YAML; JSON scalars and lists are YAML too."""
        d, dump = asdict(self), json.dumps
        groups = {"storage": ("input_dir", "output_dir"), "extraction": ("entity_types", "max_gleanings"), "community_reports": ("community_max_length",), "snapshots": ("export_graphml",)}
        lines = ["chunks:", f"  size: {self.chunk_size}", f"  overlap: {self.chunk_overlap}", "models:"]
        for name, block in self.model_blocks().items():
            lines += [f"  {name}:", *(f"    {k}: {dump(v)}" for k, v in block.items() if v is not None)]
        for name, keys in groups.items():
            lines += [f"{name}:", *(f"  {k}: {dump(d[k])}" for k in keys)]
        return "\n".join(lines) + "\n"

    def write(self, folder: str, force: bool = False) -> bool:
        """settings.yaml in a folder; an existing one stays unless forced. True if written."""
        path = os.path.join(folder, "settings.yaml")
        if os.path.exists(path) and not force:
            return False
        os.makedirs(folder, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.text())
        if self.env():
            with open(os.path.join(folder, ".env"), "w", encoding="utf-8") as f:
                f.write(self.env())
        return True


def index_job(spark: SparkSession, source: str, state: str, build: Callable[[int], str | None], chunk_size: int = 2000, tries: int = 3, force: bool = False, sleep=time.sleep) -> str:
    """Builds if the files of ``source`` changed since the last build: "unchanged", "built" or the last error.

    ``build(limit)`` makes the index from shards of at most ``limit`` characters and returns an error or None. Size errors halve
    the limit (800 at least), connection errors wait, others end it. Hashes are kept as a table in ``state``.
    """
    tables = TableProvider(spark, state)
    now = file_hashes(spark, source)
    if not force and tables.has("file_hashes") and not registry.needs_reindex(tables.read("file_hashes"), now, "path", "sha256"):
        return "unchanged"
    limit, error = max(2000, chunk_size * 4), None
    for n in range(tries):
        error = build(limit)
        if error is None:
            tables.write("file_hashes", now)
            return "built"
        low = error.lower()
        if any(w in low for w in ("exceed", "context length", "input length")):
            if ingest.next_limit(limit) >= limit:
                break
            limit = ingest.next_limit(limit)
        elif not any(w in low for w in ("refused", "10061", "timeout", "timed out", "connection reset")):
            break
        sleep(2**n)
    return error


def finalize_job(spark: SparkSession, folder: str, preview: int = 5, snapshot: bool = False) -> list[dict]:
    """Finalises the entities and relationships tables of a folder in place; a few rows of the result for a look.

    Both results are written beside the tables before either takes its place, by a move; a run that was stopped between the
    two moves is taken up by the next. With ``snapshot`` the relationships are also written as GraphML.
    """
    t, files = TableProvider(spark, folder), Files(spark)
    at = lambda name: f"{folder}/{name}.new.parquet"
    names = ("relationships", "entities")
    if not all(files.exists(f"{at(n)}/_SUCCESS") for n in names) and all(t.has(n) for n in names):
        r = graph.finalize_relationships(t.read("relationships").drop("combined_degree", "human_readable_id", "id"))
        e = graph.finalize_entities(t.read("entities").drop("degree", "human_readable_id", "id"), t.read("relationships"))
        for name, df in zip(names, (r, e)):
            df.write.mode("overwrite").parquet(at(name))
    for name in names:
        if files.exists(f"{at(name)}/_SUCCESS"):
            files.swap(at(name), t.path(name))
            spark.catalog.refreshByPath(t.path(name))
    r = t.read("relationships")
    if snapshot:
        nodes = t.read("entities").select(F.col("title").alias("node_id"), F.col("degree"))
        write_lines(graphml(nodes, r.select("source", "target", "combined_degree")), f"{folder}/graph.graphml")
    return [x.asDict() for x in r.orderBy("human_readable_id").limit(preview).collect()]


class Pacing:
    """Time between calls: a wait drawn from ``low`` to ``high`` seconds since the last one, less what has gone by."""

    def __init__(self, low: float = 2.0, high: float = 5.0, clock=time.monotonic, sleep=time.sleep, draw=random.uniform) -> None:
        self.low, self.high, self.clock, self.sleep, self.draw, self.last = low, high, clock, sleep, draw, None

    def wait(self) -> float:
        """Waits as long as is due before the next call: the seconds waited."""
        due = 0.0 if self.last is None else max(0.0, self.draw(self.low, self.high) - (self.clock() - self.last))
        if due:
            self.sleep(due)
        self.last = self.clock()
        return due


def append_usage(spark: SparkSession, path: str, key_tail: str, used: float, limit: float | None, source: str, key_usage: float | None = None) -> None:
    """Appends one row of usage to a folder of JSON lines, in the form ``sources.files.usage_history`` reads."""
    left = None if limit is None else limit - used
    row = spark.createDataFrame([(key_tail, float(used), limit, left, source, key_usage)], "key_tail string, credits_used double, credit_limit double, credits_remaining double, source string, key_usage double")
    row.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Counts rows as they pass, without another job: read the observation after the action."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
