from evigraph.operators import graph, synthesis
from evigraph.schemas import conform, empty

import pytest


def triplets(spark, rows):
    return conform(spark.createDataFrame(rows, "triplet_id string, subject string, predicate string, object string, source_document_id string, confidence double, extraction_iteration int"), "triplets")


def entities(spark, names):
    return conform(spark.createDataFrame([(n,) for n in names], "canonical_name string"), "entities")


def contradictions(spark, rows):
    return conform(spark.createDataFrame(rows, "contradiction_id string, topic string, claim_a string, claim_b string, severity string, status string"), "contradictions")


def test_edges_collapse_parallel_triplets(spark):
    t = triplets(spark, [("t1", "Lithium", "delays", "EV", "d1", 0.9, 0), ("t2", "Lithium", "constrains", "EV", "d1", 0.8, 0), ("t3", "EV", "uses", "Lithium", None, None, 1), ("t4", None, "x", "EV", None, None, 1)])
    e = {(r["source"], r["target"]): r for r in graph.edges(t).collect()}
    assert len(e) == 2
    one = e["Lithium", "EV"]
    assert one["weight"] == 2 and one["predicates"] == ["constrains", "delays"] and one["triplet_ids"] == ["t1", "t2"]


def test_degrees_count_loops_twice(spark):
    t = triplets(spark, [("t1", "A", "p", "A", None, None, 0), ("t2", "A", "p", "B", None, None, 0), ("t3", "A", "q", "B", None, None, 0)])
    assert {r["name"]: r["degree"] for r in graph.degrees(t).collect()} == {"A": 3, "B": 1}


def test_disputed_is_a_substring_in_any_case_and_status(spark):
    c = contradictions(spark, [("c1", "GRID Batteries fail", "x", "y", "high", "resolved"), ("c2", None, None, "short", "low", "open")])
    found = graph.disputed_entities(entities(spark, ["Grid batteries", "EV", "or", "", "z"]), c)
    assert {r["name"] for r in found.collect()} == {"Grid batteries", "or"}


def test_disputed_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    names = sorted({word(rng.choice([1, 2, 3, 5, 8, 9, 12])) for _ in range(60)} - {""})
    texts = [word(rng.randint(1, 40)) for _ in range(12)]
    found = graph.disputed_entities(entities(spark, names), contradictions(spark, [(str(i), t, None, None, "low", "open") for i, t in enumerate(texts)]))
    assert {r["name"] for r in found.collect()} == {n for n in names if any(n in t for t in texts)}


def test_counts_of_small_graphs(spark):
    none = empty(spark, "triplets")
    assert graph.graph_counts(entities(spark, ["A"]), none).first().asDict() == {"node_count": 1, "edge_count": 0, "density": 0.0}
    two = graph.graph_counts(entities(spark, ["A", "B"]), triplets(spark, [("t", "A", "p", "B", None, None, 0)])).first()
    assert (two["node_count"], two["edge_count"], two["density"]) == (2, 1, 0.5)


def test_empty_tables(spark):
    e, t, c = (empty(spark, x) for x in ("entities", "triplets", "contradictions"))
    assert graph.nodes(e, t, c).count() == graph.edges(t).count() == synthesis.top_entities(e, t, c).count() == 0
    assert synthesis.pillars(synthesis.representative_triplets(e, t, c), synthesis.top_entities(e, t, c)).count() == 0
    assert graph.components(t.selectExpr("subject AS source", "object AS target")).count() == 0


def test_finalize_relationships(spark):
    rel = spark.createDataFrame([("B", "A", ["x"], 0), ("A", "B", ["y"], 1), ("B", "A", ["z"], 2), ("C", "C", [], 3), (None, "A", [], 4)], "source string, target string, tags array<string>, ord int")
    rows = {(r["source"], r["target"]): r for r in graph.finalize_relationships(rel, "ord").collect()}
    assert len(rows) == 4
    assert rows["B", "A"]["tags"] == ["x"] and rows["B", "A"]["combined_degree"] == 2 and rows["C", "C"]["combined_degree"] == 4
    assert sorted(r["human_readable_id"] for r in rows.values()) == [0, 1, 2, 3] and rows["B", "A"]["human_readable_id"] == 0


def test_finalize_does_not_depend_on_row_order(spark):
    rows = [(a, b) for a in "ABC" for b in "BCD"]
    one = graph.finalize_relationships(spark.createDataFrame(rows, "source string, target string")).collect()
    two = graph.finalize_relationships(spark.createDataFrame(rows[::-1], "source string, target string")).collect()
    assert sorted(one) == sorted(two)


def test_components_and_hops(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("z", "z")], "source string, target string")
    found = {r["name"]: r["component"] for r in graph.components(chain).collect()}
    assert {v for k, v in found.items() if k.startswith("n")} == {"n00"} and found["y"] == "x" and found["z"] == "z"
    hops = {r["name"]: r["hops"] for r in graph.k_hop(chain, spark.createDataFrame([("n03",)], "name string"), 2).collect()}
    assert hops == {"n03": 0, "n04": 1, "n05": 2}


def test_communities_nest(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    rows = graph.communities(spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0")] + clique("c"), "source string, target string")).collect()
    by = {level: {r["name"]: r["community"] for r in rows if r["level"] == level} for level in (0, 1, 2)}
    assert by[0]["a1"] == by[0]["b1"] != by[0]["c1"]
    for level in (1, 2):
        assert all(by[0][x] == by[0][y] for x in by[0] for y in by[0] if by[level][x] == by[level][y])


def writer_state(spark):
    e = conform(spark.createDataFrame([("Grid batteries", 0.9), ("Solar farms", 0.7), ("Utilities", None)], "canonical_name string, confidence double"), "entities")
    t = triplets(spark, [("t1", "Grid batteries", "stabilize", "Utilities", "d1", 0.8, 1), ("t2", "Solar farms", "feed", "Grid batteries", "d2", 0.7, 1)])
    c = contradictions(spark, [("c1", "Grid batteries lifetime", "10 years", "20 years", "high", "open")])
    return e, t, c


def test_top_entity_and_pillars(spark):
    e, t, c = writer_state(spark)
    top = synthesis.top_entities(e, t, c)
    rows = top.collect()
    assert rows[0]["canonical_name"] == "Grid batteries" and rows[0]["disputed"] and rows[0]["degree"] == 2
    p = synthesis.pillars(synthesis.representative_triplets(e, t, c, top=top), top).collect()
    assert [x["anchor_entity"] for x in p] == ["Grid batteries"]
    assert p[0]["title_hint"] == "Grid batteries - stabilize, feed" and p[0]["triplet_ids"] == "t1;t2"


def greedy(ts, es, k, per):
    used, out = set(), []
    for e in es:
        got = [t for t in ts if e in (t[1], t[2]) and t[0] not in used][:per]
        if got and len(out) < k:
            used |= {t[0] for t in got}
            out.append((e, [t[0] for t in got]))
    return out or ([(ts[0][1], [t[0] for t in ts[:per]])] if ts else [])


@pytest.mark.parametrize("seed", range(4))
def test_pillars_match_a_sequential_walk(spark, seed):
    import random

    rng = random.Random(seed)
    names = ["A", "B", "C", "D", "E"]
    ts = [(f"t{i:02d}", rng.choice(names), rng.choice([*names, "Z"]), f"p{rng.randint(0, 2)}", i + 1) for i in range(12)]
    rep = spark.createDataFrame(ts, "triplet_id string, subject string, object string, predicate string, rank int")
    es = names if seed else ["Q"]
    top = spark.createDataFrame([(n, False, 10 - i, 0.0, 0.0, 0) for i, n in enumerate(es)], "canonical_name string, disputed boolean, degree int, centrality double, confidence double, source_count int")
    got = [(r["anchor_entity"], r["triplet_ids"].split(";")) for r in synthesis.pillars(rep, top, 3, 3).orderBy("pillar").collect()]
    assert got == greedy(ts, es, 3, 3)


def test_writer_context_is_one_bounded_row(spark):
    e, t, c = writer_state(spark)
    from evigraph.exports.graph_files import report_from_context

    ctx = synthesis.writer_context(empty(spark, "documents"), e, t, c, empty(spark, "research_gaps"), "grid resilience")
    assert ctx.count() == 1 and "content" not in ctx.columns
    report = report_from_context(ctx)
    assert report.startswith("# grid resilience") and "No open gaps." in report and "Grid batteries stabilize Utilities" in report


def test_disputed_sends_no_exploded_rows_to_the_driver(spark):
    c = contradictions(spark, [("c1", "GRID Batteries fail", "x", "y", "high", "resolved")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph.disputed_entities(entities(spark, ["Grid batteries", "EV"]), c)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 4
