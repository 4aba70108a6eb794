"""Graph and report artifacts: GraphML, DOT, HTML, JSON and Markdown, as lines of text tables or bounded strings."""

from __future__ import annotations

import html
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import escape_dot, escape_html
from evigraph.runtime import cut


def _lines(*parts: DataFrame) -> DataFrame:
    """Text lines in order: (part, key, line)."""
    return reduce(DataFrame.unionByName, parts)


def _fixed(df: DataFrame, part: int, line: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(part, "", line)], "part int, key string, line string")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file, to be written in order of part and key; every node and edge is one line."""
    def data(columns: list[str]):
        return F.concat(*[F.concat(F.lit(f'<data key="{c}">'), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for c in columns])

    n_columns = [c for c in nodes.columns if c != "node_id"]
    e_columns = [c for c in edges.columns if c not in ("source", "target")]
    keys = "".join(f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="string"/>' for kind, cs in (("node", n_columns), ("edge", e_columns)) for c in cs)
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("key"), F.concat(F.lit('<node id="'), escape_html(F.col("node_id")), F.lit('">'), data(n_columns), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\u0001", "source", "target").alias("key"), F.concat(F.lit('<edge source="'), escape_html(F.col("source")), F.lit('" target="'), escape_html(F.col("target")), F.lit('">'), data(e_columns), F.lit("</edge>")).alias("line"))
    return _lines(_fixed(nodes, 0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), n, e, _fixed(nodes, 3, "</graph></graphml>"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT file; disputed nodes are filled."""
    quoted = lambda c: F.concat(F.lit('"'), escape_dot(F.col(c)), F.lit('"'))
    fill = F.when(F.col("disputed") == "true", ', style="filled", fillcolor="#fde2e2"').otherwise("")
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("key"), F.concat(F.lit("  "), quoted("node_id"), F.lit(" [label="), quoted("label"), fill, F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\u0001", "source", "target").alias("key"), F.concat(F.lit("  "), quoted("source"), F.lit(" -> "), quoted("target"), F.lit(" [label="), quoted("label"), F.lit("];")).alias("line"))
    return _lines(_fixed(nodes, 0, "digraph knowledge {"), n, e, _fixed(nodes, 3, "}"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Writes lines as text parts in order: sorted ranges, one file each; reading the parts by name gives the file."""
    cut(lines, "lines").repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(folder)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of one JSON object: edge_count, node_count, nodes and edges, each a line of its own, for a graph of any size."""
    def rows(df: DataFrame, part: int, key) -> DataFrame:
        keyed = df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))
        first = keyed.agg(F.min("key").alias("_first"))  # one row
        return keyed.crossJoin(F.broadcast(first)).select(F.lit(part).alias("part"), "key", F.concat(F.when(F.col("key") == F.col("_first"), " ").otherwise(","), "json").alias("line"))

    n = rows(nodes, 1, F.col("node_id"))
    e = rows(edges, 3, F.concat_ws("\u0001", "source", "target"))
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))  # one row each
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit('{"edge_count": '), F.col("m").cast("string"), F.lit(', "node_count": '), F.col("n").cast("string"), F.lit(', "nodes": [')).alias("line"))
    return _lines(head, n, _fixed(nodes, 2, '], "edges": ['), e, _fixed(nodes, 4, "]}"))


def dumps(payload) -> str:
    """Artifact JSON: two spaces, sorted keys, ASCII."""
    return json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=True, default=str)


def html_viewer(title: str, positions: DataFrame, contradictions: DataFrame, gaps: DataFrame, resources: DataFrame) -> str:
    """A static page: nodes of a bounded layout, at most 8 contradictions, 8 gaps, 12 resources, all escaped."""
    esc = lambda x: html.escape("" if x is None else str(x))
    dots = "".join(f'<circle cx="{r["x"]}" cy="{r["y"]}" r="8"/><text x="{r["x"]}" y="{r["y"]}">{esc(r["name"])}</text>' for r in positions.collect())  # a bounded layout
    def items(df: DataFrame, n: int, *columns: str) -> str:
        rows = df.orderBy(*df.columns[:1]).limit(n).collect()
        return "".join("<li>" + " — ".join(esc(r[c]) for c in columns) + "</li>" for r in rows) or "<li>None</li>"
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1><svg viewBox='0 0 960 640'>{dots}</svg>"
        f"<h2>Contradictions</h2><ul>{items(contradictions, 8, 'topic', 'claim_a', 'claim_b')}</ul><h2>Gaps</h2><ul>{items(gaps, 8, 'question', 'priority')}</ul>"
        f"<h2>Resources</h2><ul>{items(resources, 12, 'title', 'url')}</ul></body></html>"
    )


def markdown_report(query: str, summary: str, knowledge: list[str], pillars: list[tuple[str, str]], disputed: list[str], gaps: list[str], evidence: list[tuple[str, list[str]]]) -> str:
    """Six sections; each says so when it is empty. Links are numbered by their place, blank ones are left out."""
    def section(name: str, lines: list[str], empty: str) -> list[str]:
        return [f"## {name}", "", *(lines or [empty]), ""]

    links = lambda urls: ", ".join(f"[Source {i}]({u})" for i, u in enumerate(urls, 1) if u and u.strip())
    return "\n".join([
        f"# {query}", "", *section("Executive summary", [summary] if summary else [], "No summary."), *section("Knowledge map", [f"- {x}" for x in knowledge], "No entities."),
        *section("Key pillars", [f"### {t}\n{b}" for t, b in pillars], "No pillars."), *section("Disputed facts", [f"- {x}" for x in disputed], "No disputed facts."),
        *section("Strategic gaps", [f"- {x}" for x in gaps], "No open gaps."), *section("Evidence trace", [f"- {s} {links(u)}".rstrip() for s, u in evidence], "No evidence."),
    ])


def report_from_context(context: DataFrame) -> str:
    """The deterministic report of a writer context (one row)."""
    row = context.first()
    load = lambda name: json.loads(row[name] or "[]")
    top, rep, pillars, cons, gaps = (load(n) for n in ("top_entities", "representative_triplets", "candidate_pillars", "contradictions", "research_gaps"))
    n = len(rep)
    summary = f"The graph holds {len(top)} leading entities and {n} representative relationship{'' if n == 1 else 's'}; {len(cons)} contradiction{'' if len(cons) == 1 else 's'} and {len(gaps)} gap{'' if len(gaps) == 1 else 's'} are listed."
    return markdown_report(
        row["query"], summary if top or rep else "", [f"{e['canonical_name']} (degree {e['degree']}{', disputed' if e['disputed'] else ''})" for e in top],
        [(p["title_hint"], p["triplet_ids"].replace(";", ", ")) for p in pillars], [f"{c.get('topic')}: {c.get('claim_a')} / {c.get('claim_b')}" for c in cons], [g.get("question", "") for g in gaps],
        [(t["statement"], [t.get("source_url") or ""]) for t in sorted(rep, key=lambda t: t["rank"])],
    )
