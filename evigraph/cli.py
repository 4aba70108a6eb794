"""Command line: convert files, write settings, build a fast index, finalise its graph, search it, and show the state of a folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evigraph.plans import index, jobs
from evigraph.search import search
from evigraph.sources import files
from evigraph.sources.fs import Files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evigraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="files of a folder to a table of texts")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--include-code", action="store_true")
    s = sub.add_parser("settings", help="write settings.yaml")
    s.add_argument("target")
    s.add_argument("--force", action="store_true")
    q = sub.add_parser("query", help="ask the index tables of a folder")
    q.add_argument("folder")
    q.add_argument("question")
    q.add_argument("--method", default="local", choices=search.METHODS)
    q.add_argument("--community-level", type=int, default=2)
    i = sub.add_parser("index", help="fast index of a table of texts (document_id, content) into a folder")
    i.add_argument("documents")
    i.add_argument("folder")
    i.add_argument("--chunk-size", type=int, default=1200)
    i.add_argument("--chunk-overlap", type=int, default=100)
    w = sub.add_parser("status", help="state of a folder: tables, settings, documents")
    w.add_argument("folder")
    w.add_argument("--documents", default="")
    f = sub.add_parser("finalize", help="degrees and ids of the graph tables of a folder")
    f.add_argument("folder")
    f.add_argument("--graphml", action="store_true", help="also write the relationships as GraphML")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "settings":
        print("written" if jobs.Settings().write(a.target, a.force) else "kept")
        return 0
    spark = SparkSession.builder.appName("evigraph").getOrCreate()
    if a.command == "convert":
        df, seen = jobs.observed(files.converted_documents(spark, a.source, a.include_code))
        df.write.mode("overwrite").parquet(a.target)
        print(f"{seen.get['rows']} documents")
    elif a.command == "finalize":
        print(json.dumps(jobs.finalize_job(spark, a.folder, snapshot=a.graphml), indent=2, default=str))
    elif a.command == "index":
        steps = index.build(spark, spark.read.parquet(a.documents), files.output_folder(a.folder), size=a.chunk_size, overlap=a.chunk_overlap)
        done = index.outcome(spark.createDataFrame(steps, "step string, error string")).first()
        print(f"{done['completed']} steps done" + (f", failed: {done['errors']}" if done["failed"] else ""))
        return int(done["failed"] > 0)
    elif a.command == "status":
        fs, out = Files(spark), files.output_folder(a.folder)
        row = (0, len([x for x in fs.names(out) if x.endswith(".parquet")]), int(bool(a.documents) and fs.exists(a.documents)), int(fs.exists(f"{a.folder}/settings.yaml")))
        print(jobs.job_status(spark.createDataFrame([row], "processes int, outputs int, inputs int, settings int")).first()["status"])
    else:
        t = files.TableProvider(spark, files.output_folder(a.folder))
        tables = {n: t.read_or_empty(n) for n in ("entities", "triplets", "documents", "community_reports", "text_units")}
        print(search.answer(spark, a.method, a.question, tables, a.community_level).select(F.coalesce("content", F.lit(""))).first()[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
