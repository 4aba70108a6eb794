from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evigraph.functions import ids, text as T
from evigraph.operators import acquire, critic, ingest, registry, usage
from evigraph.plans import routing
from evigraph.schemas import conform, empty, violations
from evigraph.search import search
from evigraph.sources import parsing


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_ids(spark):
    a = one(spark, ids.triplet_id(*map(F.col, "spod")), s="a", p="b", o="c", d="d")
    assert a.startswith("trip_") and len(a) == 21
    assert one(spark, ids.contradiction_id(F.col("s"), F.col("a"), F.col("b")), s="s", a="1", b="2") != one(spark, ids.contradiction_id(F.col("s"), F.col("a"), F.col("b")), s="s", a="2", b="1")
    assert one(spark, ids.slug(F.col("t")), t="电池") == "research-run" and one(spark, ids.slug(F.col("t")), t=" Grid -- Batteries! ") == "grid-batteries"
    assert one(spark, ids.stable_filename(F.col("p")), p="/a/b c.tar.gz").startswith("b_c.tar_")


def test_text_functions(spark):
    assert one(spark, T.strip_html(F.col("t")), t="<p>a <b>b</b>\n</p>") == "a b" and one(spark, T.strip_html(F.col("t")), t="<br>") is None
    assert one(spark, T.detect_language(F.col("t")), t="这是中文 text") == "zh" and one(spark, T.detect_language(F.col("t")), t="") == "en"
    assert one(spark, T.looks_binary(F.col("t")), t="\x00\x01" * 50 + "abc") is True and one(spark, T.looks_binary(F.col("t")), t="plain") is False
    assert one(spark, T.pdf_text_is_sparse(F.col("t"), F.lit(10)), t=None) is True and one(spark, T.pdf_text_is_sparse(F.col("t"), F.lit(10)), t="a" * 500) is False
    assert one(spark, T.compact_constraints(F.col("t")), t="- a\n* b \n\n") == "a b"
    assert one(spark, T.json_span(F.col("t")), t='Sure: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, T.source_links(F.array(F.lit("u1"), F.lit(" "), F.lit("u3"))), t="x") == "[Source 1](u1), [Source 3](u3)"
    assert one(spark, T.substitute(F.lit("${a} ${b}"), {"a": F.lit("1")}), t="x") == "1 ${b}"
    assert one(spark, T.error_class(F.col("t")), t="HTTP 404 timeout") == "permanent" and one(spark, T.error_class(F.col("t")), t="Timed out") == "transient"
    assert one(spark, T.index_error_class(F.col("t")), t="context length exceeded") == "size" and one(spark, T.provider(F.col("t")), t="SiliconFlow") == "openai"


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25])
def test_shards_restore_the_text(spark, n):
    text = ("héllo\n😀" * 10)[:n]
    got = [r["shard"] for r in ingest.shard_rows(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", 10).orderBy("part").collect()]
    assert "".join(got) == text and all(len(s) == 10 for s in got[:-1])


def test_line_parts_restore_the_text(spark):
    text = "a\nbb\n" + "c" * 30 + "\n\nd\n" * 3
    got = [r["part_text"] for r in ingest.line_parts(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", 8).orderBy("part").collect()]
    assert "".join(got) == text and all(len(p) <= 8 or p.count("\n") <= 1 for p in got)


def test_chunks_overlap(spark):
    text = " ".join(str(i) for i in range(25))
    got = [r["chunk_text"].split() for r in ingest.chunk_rows(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t", 10, 3).where("id = 1").orderBy("chunk").collect()]
    assert [g[0] for g in got] == ["0", "7", "14", "21"] and all(a[-3:] == b[:3] for a, b in zip(got, got[1:])) and got[-1][-1] == "24"


def test_routes(spark):
    cases = {"a/b.MOBI": "mobi", "x.xlsx": "excel", "x.zip": "zip", "x.rar": "rar", "x.ppsx": "slides", "x.doc": "legacy_office", "x.csv": "plain", "x.pdf": "rich", "x.py": "plain", "Makefile": "plain", "x.exe": "skip", "x.png": "skip", "x.mp3": "skip", "x.unknown": "fallback", "noext": "fallback"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["c"] for r in df.select("p", ingest.route(F.col("p")).alias("c")).collect()} == cases
    assert df.where("p = 'x.py'").select(ingest.route(F.col("p"), include_code=True)).first()[0] == "code"
    assert one(spark, ingest.ignored(F.col("p"), ["build", "*.tmp"]), p="src/builder.py") is True and one(spark, ingest.ignored(F.col("p"), ["build"]), p="src/main.py") is False


def test_stale(spark):
    src = spark.createDataFrame([("/a.txt", 2), ("/b.txt", 2), ("/c.txt", 2)], "path string, modified int")
    out = src.withColumn("name", ids.stable_filename(F.col("path"))).select("name", F.when(F.col("path") == "/a.txt", 3).otherwise(1).alias("modified")).where("name NOT LIKE 'c%'")
    assert {r["path"] for r in ingest.stale(src, out).collect()} == {"/b.txt", "/c.txt"}


def reference_upsert(mentions):
    out = {}
    for _, name, kind, aliases, description, doc in sorted(mentions, key=lambda m: m[0]):
        name = name.strip()
        if not name:
            continue
        if name not in out:
            out[name] = [kind, list(aliases), description, [doc] if doc else []]
            continue
        e = out[name]
        e[2] = e[2] or description
        e[1] += [a for i, a in enumerate(aliases) if a and a not in e[1] and a not in aliases[:i]]
        if doc and doc not in e[3]:
            e[3].append(doc)
    return out


def test_upsert_matches_a_sequential_merge(spark):
    import random

    rng = random.Random(1)
    mentions = [(i, rng.choice(["A", " A ", "B", "C", " "]), rng.choice([None, "org"]), [rng.choice(["x", "y", "", "z"]) for _ in range(rng.randint(0, 3))], rng.choice(["", "d1", "d2"]), rng.choice(["", "doc1", "doc2"])) for i in range(120)]
    df = spark.createDataFrame(mentions, "ord int, name string, type string, aliases array<string>, description string, document_id string")
    got = {r["canonical_name"]: [r["type"], r["aliases"], r["description"], r["source_document_ids"]] for r in registry.upsert_entities(df, ["ord"]).collect()}
    assert got == reference_upsert(mentions)


def test_new_rows_and_replace(spark):
    c = spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k2", "c"), (None, "d")], "k string, v string")
    assert registry.new_rows(c, spark.createDataFrame([("k2",)], "k string"), "k", ["v"]).collect() == [("k1", "a")]
    assert {tuple(r) for r in registry.replace_entities(c, "k", ["v"]).collect()} == {("k1", "b"), ("k2", "c")}


def test_hash_diff(spark):
    a, b = (spark.createDataFrame(x, "p string, h string") for x in ([("a", "1"), ("b", "1"), ("d", None)], [("b", "2"), ("c", "1"), ("d", None)]))
    assert {tuple(r) for r in registry.hash_diff(a, b, "p", "h").collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}
    assert registry.needs_reindex(a, b, "p", "h") and not registry.needs_reindex(a, a, "p", "h")


def test_unanalysed_keeps_documents_without_triplets(spark):
    d = spark.createDataFrame([("d1", 1), ("d2", 2), ("", 3), (None, 4)], "document_id string, extra int")
    t = spark.createDataFrame([("d1",), (None,)], "source_document_id string")
    assert [r["document_id"] for r in registry.unanalysed(d, t).collect()] == ["d2"]


def test_every_pair_of_differing_objects_is_a_candidate(spark):
    s = "subject string, predicate string, object string"
    old = spark.createDataFrame([("S", "is", "A"), ("S", "is", "B"), ("S", "is", ""), ("T", "is", "A")], s)
    new = spark.createDataFrame([("S", "is", "A"), ("S", "is", "B"), ("S", "is", "C"), ("S", "is", "A"), ("T", "is", "A"), ("U", "is", "A")], s)
    got = [(r["subject"], r["claim_a"], r["claim_b"]) for r in critic.candidate_contradictions(new, old).collect()]
    assert sorted(got) == [("S", "A", "B"), ("S", "A", "C"), ("S", "B", "A"), ("S", "B", "C")]
    groups = [tuple(r) for r in critic.contradiction_groups(new, old).collect()]
    assert groups == [("S", "is", 3, 2, 4)]


def test_critic(spark):
    s = "triplet_id string, subject string, predicate string, object string, extraction_iteration int"
    t = spark.createDataFrame([("1", "A", "is", "x", 0), ("2", "A", "is", "y", 1), ("3", "A", "is", "x", 1), ("4", "B", "is", "q", None)], s)
    new, old = critic.split_iteration(t, 1)
    assert new.count() == 2 and old.count() == 2
    assert [(r["claim_a"], r["claim_b"]) for r in critic.candidate_contradictions(new, old).collect()] == [("x", "y")]
    gaps = critic.candidate_gaps(t, spark.createDataFrame([(" A ",), ("x",)], "canonical_name string"))
    assert {r["question"] for r in gaps.collect()} == {f"What is known about {n}?" for n in ("y", "B", "q")}


def test_tiers(spark):
    rows = [(0, " ", "u1", "snip", "r" * 500), (1, "T2", "u2", "snip", "short"), (2, "T3", "u3", "snip", None), (3, "T4", "u4", " snip ", ""), (4, "T5", "u5", " ", None), (5, "T6", "", "x", None)]
    r = spark.createDataFrame(rows, "ord int, title string, url string, body string, raw_content string")
    made = acquire.tiered(r, spark.createDataFrame([("u2", "ext"), ("u2", "ext"), ("u4", "")], "url string, content string"), spark.createDataFrame([("u2", "scr"), ("u3", "scr")], "url string, content string"), "q")
    got = {x["url"]: (x["acquisition_method"], x["content"][:5], x["title"]) for x in made.collect()}
    assert got == {"u1": ("tavily_raw_content", "rrrrr", "u1"), "u2": ("tavily_extract", "ext", "T2"), "u3": ("playwright", "scr", "T3"), "u4": ("tavily_snippet", "snip", "T4")}


def test_answers(spark):
    a = spark.createDataFrame([("local", "q?", "text", {"method": "x", "k": "v"}), ("global", "q", "Error: no", None), ("local", "q", " ", None)], "method string, question string, content string, metadata map<string,string>")
    rows = acquire.answers_to_documents(a).collect()
    assert len(rows) == 1 and rows[0]["metadata"] == {"method": "local", "question": "q?", "k": "v"}


def test_ledger_and_deltas(spark):
    c = spark.createDataFrame([("k", i, 3) for i in range(5)], "k string, i int, c int")
    rows = usage.ledger(c, "k", ["i"], "c", 10, 0.8).orderBy("i").collect()
    assert [r["allowed"] for r in rows] == [True, True, True, True, False] and [r["warned"] for r in rows] == [False, False, True, False, False]
    h = spark.createDataFrame([("k", "1", 0, 5, 9), ("k", "2", 1, None, 8), ("k", "3", 2, 9, None)], "key_tail string, timestamp string, ord int, key_usage int, credits_used int")
    assert [r["delta"] for r in usage.usage_deltas(h).orderBy("ord").collect()] == [None, 3, None]


def metrics(spark, ratio):
    return spark.createDataFrame([(ratio,)], "graph_growth_ratio double")


def test_route_order(spark):
    con = conform(spark.createDataFrame([("c2", "T", "a", "b", "high", "open"), ("c1", "T", "a", "b", "high", "resolved")], "contradiction_id string, topic string, claim_a string, claim_b string, severity string, status string"), "contradictions")
    gap = conform(spark.createDataFrame([("g1", "low?", "low", "open"), ("g2", "high?", "high", "open"), ("g3", "x", "high", "resolved")], "gap_id string, question string, priority string, status string"), "research_gaps")
    no_c, no_g = empty(spark, "contradictions"), empty(spark, "research_gaps")
    go = lambda *a, **k: routing.should_continue(*a, **k).first()
    assert go(metrics(spark, 1.0), con, gap, 3, 3, "q")["route"] == "finalize"
    r = go(metrics(spark, 1.0), con, gap, 1, 3, "q")
    assert (r["route"], r["contradiction_id"], r["target_query"]) == ("resolve_conflict", "c2", "Verify conflicting claims about T: a vs b")
    assert go(metrics(spark, 1.0), no_c, gap, 1, 3, "q")["gap_id"] == "g2" and go(metrics(spark, 1.0), con, gap, 1, 3, "q", conflicts=False)["route"] == "resolve_gap"
    assert go(metrics(spark, 0.05), no_c, no_g, 1, 3, "q")["route"] == "finalize"
    r = go(metrics(spark, 0.5), no_c, no_g, 1, 3, "q")
    assert (r["route"], r["target_query"]) == ("continue_research", "q")


def test_metrics(spark):
    e, t, c, g = (empty(spark, x) for x in ("entities", "triplets", "contradictions", "research_gaps"))
    m = routing.run_metrics(e, t, c, g).first()
    assert m["triplet_count"] == 0 and m["graph_growth_ratio"] == 0.0
    t1 = conform(spark.createDataFrame([("t",)], "triplet_id string"), "triplets")
    assert routing.run_metrics(e, t1, c, g).first()["graph_growth_ratio"] == 1.0 and routing.run_metrics(e, t1, c, g, 1).first()["new_triplets_last_iteration"] == 0


def test_conform(spark):
    df = spark.createDataFrame([("c", "weird", None)], "contradiction_id string, severity string, status string")
    r = conform(df, "contradictions").first()
    assert (r["severity"], r["status"]) == ("low", "open")
    with pytest.raises(ValueError):
        conform(df.withColumn("extra", F.lit(1)), "contradictions")
    assert "extra" not in conform(df.withColumn("extra", F.lit(1)), "contradictions", closed=False).columns
    assert violations(spark.createDataFrame([("c", "weird", "open")], "contradiction_id string, severity string, status string"), "contradictions").count() == 1
    assert conform(spark.createDataFrame([("d",)], "document_id string"), "documents").first()["metadata"] == {}


def test_payloads(spark):
    good = '{"entities": [{"canonical_name": "A", "odd": 1}], "triplets": [{"subject": "A", "predicate": "p", "object": "B", "evidence": "e"}]}'
    rows = [(1, good), (2, "Here it is:\n" + good + "\nbye"), (3, "garbage"), (4, '{"entities": [{"type": "x"}]}'), (5, None), (6, "{}"), (7, "[1]")]
    p = parsing.parse_extraction(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    assert {r["id"]: r["valid"] for r in p.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert parsing.triplet_rows(p, "id", 2).count() == 2
    c = parsing.parse_critic(spark.createDataFrame([(1, '{"contradictions": [{"claim_a": "x"}]}'), (2, '{"research_gaps": [{"question": "q"}]}')], "id int, t string"), "id", "t")
    assert {r["id"]: r["valid"] for r in c.collect()} == {1: False, 2: True}


def test_requirements(spark):
    texts = {"a": "## Topic\nGrid\n## Research Focus\nCost\n## Constraints\n- EU\n", "b": "intro\n## Background\nold\n", "c": "# Only heading\nbody", "d": "just text"}
    got = {r["k"]: (r["query"], r["user_prompt"], r["constraints"]) for r in parsing.requirements(spark.createDataFrame(list(texts.items()), "k string, t string"), "k", "t").collect()}
    assert got == {"a": ("Grid", "Cost", "- EU"), "b": ("intro\n\nold", None, None), "c": ("Only heading", texts["c"], None), "d": ("just text", None, None)}
    t = parsing.thresholds(spark.createDataFrame([("k", "chunks:\n  size: 1200\n  size: 9\n")], "k string, t string"), "k", "t").first()
    assert (t["chunk_size"], t["overlap"], t["batch_size"], t["batch_max_tokens"]) == (1200, 150, 8, 2000)


def test_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "id long, v array<float>")
    got = search.vector_top_k(v.where("id = 1"), v, "id", "v", 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 6, 2]
    units = spark.createDataFrame([("a", "grid storage costs"), ("b", "grid"), ("c", None)], "id string, text string")
    assert [r["id"] for r in search.basic(units, "Grid storage?").collect()] == ["a", "b"] and search.basic(units, "").count() == 0
    assert search.answer(spark, "nope", "q", {}).first()["content"].startswith("Error:") and search.answer(spark, "local", "q", {"entities": empty(spark, "entities")}).first()["content"].startswith("Error:")


def test_local_global_drift(spark):
    from evigraph.operators import graph

    e = conform(spark.createDataFrame([("Grid batteries", ["BESS"]), ("Utilities", [])], "canonical_name string, aliases array<string>"), "entities")
    t = conform(spark.createDataFrame([("t1", "Grid batteries", "stabilize", "Utilities", "d1", 0.9), ("t2", "X", "is", "Y", None, None)], "triplet_id string, subject string, predicate string, object string, source_document_id string, confidence double"), "triplets")
    d = conform(spark.createDataFrame([("d1", "Report", datetime(2025, 1, 1))], "document_id string, title string, retrieved_at timestamp"), "documents")
    r = search.local(e, t, d, "what do batteries do").collect()
    assert [(x["triplet_id"], x["title"]) for x in r] == [("t1", "Report")]
    reports = search.community_reports(graph.communities(t.selectExpr("subject AS source", "object AS target"), 2), t)
    assert search.global_search(reports, "batteries", 1).count() >= 1
    assert search.drift(reports, e, t, d, "batteries").count() == 1
    tables = {"entities": e, "triplets": t, "documents": d, "community_reports": reports, "text_units": d.selectExpr("document_id AS id", "title AS text")}
    for method in search.METHODS:
        assert not search.answer(spark, method, "batteries report", tables).first()["content"].startswith("Error:")
