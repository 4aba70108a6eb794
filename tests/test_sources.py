import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evigraph.exports import graph_files
from evigraph.operators import graph
from evigraph.plans import loop
from evigraph.schemas import conform, empty
from evigraph.sources import code, connectors, files
from evigraph.streaming import streams


def xlsx(sheets):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns='x'><sheets>" + "".join(f"<sheet name='{n}'/>" for n in sheets) + "</sheets></workbook>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(f"<c r='{chr(65 + j)}{k}' t='inlineStr'><is><t>{v}</t></is></c>" for j, v in enumerate(r) if v is not None) + "</row>" for k, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet xmlns='x'><sheetData>{body}</sheetData></worksheet>")
    return b.getvalue()


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return b.getvalue()


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "sub" / "b.md").write_bytes(b"# B\xff")
    (tmp_path / "sub" / "x.unknown").write_text("as text")
    (tmp_path / "sub" / "y.unknown").write_bytes(b"\x00\x01\x02" * 200)
    (tmp_path / "s.xlsx").write_bytes(xlsx({"One": [["Name", "Score"], ["Alice", None, "90"]], "Empty": []}))
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    (tmp_path / "z.zip").write_bytes(zipped({"readme.txt": "inner", "deep/notes.md": "notes", "n.zip": zipped({"c.txt": "nested"}), ".h": "x"}))
    (tmp_path / "bad.zip").write_bytes(b"nope")
    (tmp_path / "p.exe").write_bytes(b"MZ")
    return tmp_path


def test_convert(spark, corpus):
    rows = {r["title"]: r for r in files.converted_documents(spark, str(corpus)).collect()}
    assert set(rows) == {"a.txt", "b.md", "x.unknown", "s.xlsx", "readme.txt", "notes.md", "c.txt"}
    assert rows["s.xlsx"]["format"] == "excel" and rows["s.xlsx"]["text"].endswith("## Sheet: One\nName\tScore\nAlice\t\t90")
    assert rows["b.md"]["text"].endswith("# B�") and rows["x.unknown"]["format"] == "txt" and rows["a.txt"]["char_count"] == 5


def test_zip_guard():
    assert list(files.expand_zip(zipped({"a": "x" * 100}), limit=50)) == [] and list(files.expand_zip(b"bad")) == []


def test_resources_and_hashes(spark, corpus):
    r = {x["title"]: x for x in files.load_resources(spark, str(corpus), cap=3).collect()}
    assert set(r) == {"a", "b"} and r["a"]["content"] == "hel" and r["a"]["metadata"]["original_path"].endswith("/a.txt")
    h = {x["path"] for x in files.file_hashes(spark, str(corpus)).collect()}
    assert "sub/b.md" in h and ".hidden" not in h


def test_slides():
    body = "<p:sld xmlns:p='p' xmlns:a='a'><p:txBody><a:p><a:t>Hi</a:t></a:p></p:txBody><p:txBody><a:p><a:t> </a:t></a:p></p:txBody></p:sld>"
    assert files.read_slides(zipped({"ppt/slides/slide1.xml": body})) == "## Slide 1\nHi"


def test_provider(spark, tmp_path):
    p = files.TableProvider(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        p.read("entities")
    assert p.read_or_empty("entities").count() == 0 and p.list() == []
    p.write("none", spark.createDataFrame([], "id int"), truncate=False)
    assert not p.has("none")
    p.write("x", spark.createDataFrame([(1, ["a"])], "id int, tags array<string>"))
    p.write("x", spark.createDataFrame([(2,)], "id int"), truncate=False)
    assert p.count("x") == 2 and p.has_row("x", "id", 2) and not p.has_row("x", "id", 3) and p.list() == ["x"]
    assert p.rows("x", lambda d: d.withColumn("y", F.col("id") * 2)).agg(F.sum("y")).first()[0] == 6


def test_usage_history(spark, tmp_path):
    f = tmp_path / "h.jsonl"
    f.write_text("\n".join(json.dumps({"timestamp": f"2025-01-{i:02d}", "key_tail": "k", "key_usage": i}) for i in range(1, 26)) + "\n\nbroken\n" + json.dumps({"timestamp": "x", "key_tail": "other"}))
    rows = files.usage_history(spark, str(f), "k").collect()
    assert len(rows) == 20 and min(r["key_usage"] for r in rows) == 6


def test_small_files(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nA=2\nB='x'\n")
    assert files.dotenv(str(tmp_path / ".env")) == {"A": "1", "B": "x"}
    (tmp_path / "solar-power").mkdir()
    assert files.topic_folder(str(tmp_path / "solar-power"))["query"] == "solar power"
    (tmp_path / "solar-power" / "topic.md").write_text("x")
    assert files.topic_folder(str(tmp_path / "solar-power"))["requirements"].endswith("topic.md")
    assert files.output_folder(str(tmp_path)).endswith("/output")


def test_code_items(spark):
    src = '"""Doc."""\nimport os\nfrom a import b\n@deco\nclass C(Base):\n    "Cls."\n    def m(self, x, *a, k=1): return os.path(x)\ndef greet(name: str) -> str:\n    return fmt(name)\n'
    f = spark.createDataFrame([("a.py", src), ("bad.py", "def ("), ("x.go", "// note\nfunc Main() {\n}\n"), ("n.py", None)], "path string, text string")
    rows = {(r["path"], r["kind"], r["name"]): r for r in code.code_items(spark, f).collect()}
    assert rows["a.py", "method", "C.m"]["signature"] == "(self, x, *a, k=1)" and rows["a.py", "class", "C"]["signature"] == "Base" and rows["a.py", "function", "greet"]["signature"] == "(name: str) -> str"
    assert ("a.py", "import", "a.b") in rows and ("a.py", "call", "fmt") in rows and rows["a.py", "decorator", "C"]["signature"] == "deco"
    assert rows["bad.py", "error", "syntax error"]["doc"] == "def (" and ("x.go", "func", "Main") in rows


def test_connectors(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text(json.dumps({"query": "q", "title": "t", "url": "u", "body": "b"}) + "\n" + json.dumps({"query": "z", "url": "v"}))
    connectors.register(spark)
    assert spark.read.format("search").option("query", "q").option("fixture", str(f)).load().collect() == [("t", "u", "b", None)]
    rows = connectors.fetch_rows(spark.createDataFrame([("q",), ("q",), (None,)], "query string"), "query", lambda q: [(q + "1",)], "url string").collect()
    assert rows == [("q", "q1")]
    tries = []

    def failing(arg):
        tries.append(arg)
        raise OSError("Timed out" if len(tries) < 2 else "HTTP 404")

    assert connectors.retrying(failing, sleep=lambda s: None)("x") == [] and len(tries) == 2
    p = spark.createDataFrame([("a",), ("b",)], "prompt string")
    cache = p.where("prompt = 'a'").select(F.sha2("prompt", 256).alias("prompt_hash"), F.lit("cached").alias("response"))
    assert {r["prompt"]: r["response"] for r in connectors.generated(p, "prompt", lambda x: x.upper(), cache).collect()} == {"a": "cached", "b": "B"}
    u = connectors.usage_from_payload(spark.createDataFrame([('{"key": {"usage": 5}, "account": {"plan_limit": 9}}',)], "t string"), "t").first()
    assert (u["key_usage"], u["credits_used"], u["credits_limit"]) == (5, None, 9)


def small_graph(spark):
    e = conform(spark.createDataFrame([('A "x" <b>',), ("B",)], "canonical_name string"), "entities")
    t = conform(spark.createDataFrame([("t1", 'A "x" <b>', "p", "B")], "triplet_id string, subject string, predicate string, object string"), "triplets")
    c = conform(spark.createDataFrame([("c1", "about b", "x", "y")], "contradiction_id string, topic string, claim_a string, claim_b string"), "contradictions")
    return e, t, c


def test_exports(spark, tmp_path):
    import xml.etree.ElementTree as ET

    e, t, c = small_graph(spark)
    n, ed = graph.export_nodes(e, t, c), graph.export_edges(e, t, c)
    lines = [r["line"] for r in graph_files.graphml(n, ed).orderBy("part", "key").collect()]
    root = ET.fromstring("\n".join(lines))
    assert len([x for x in root.iter() if x.tag.endswith("}node")]) == 2 and len([x for x in root.iter() if x.tag.endswith("}edge")]) == 1
    dot = [r["line"] for r in graph_files.dot(n, ed).orderBy("part", "key").collect()]
    assert any('\\"x\\"' in x for x in dot) and sum("fillcolor" in x for x in dot) == 1
    graph_files.write_lines(graph_files.dot(n, ed), str(tmp_path / "dot"))
    parts = sorted((tmp_path / "dot").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == dot
    assert json.loads("".join(r["line"] for r in graph_files.graph_json(n, ed).orderBy("part", "key").collect()))["edge_count"] == 1
    page = graph_files.html_viewer("T<", graph.layout(graph.nodes(e, t, c)), c, empty(spark, "research_gaps"), empty(spark, "documents"))
    assert "T&lt;" in page and "<b>" not in page and "None" in page


def test_loop_runs_and_resumes(spark, tmp_path):
    calls = []

    def acquire(query, state):
        calls.append(query)
        return spark.createDataFrame([(f"d{len(calls)}", query)], "document_id string, content string")

    def extract(docs, iteration):
        ids = [r["document_id"] for r in docs.orderBy("document_id").collect()]
        t = spark.createDataFrame([(f"t{i}", "Grid", "uses", "Cells", i, iteration) for i in ids], "triplet_id string, subject string, predicate string, object string, source_document_id string, extraction_iteration int")
        return spark.createDataFrame([("Grid",), ("Cells",)], "canonical_name string"), t

    state, report = loop.run(spark, "grid", acquire, extract, str(tmp_path), "r1", loop.Config(max_iterations=3))
    assert state.route == "finalize" and state.iteration == 3 and state.relations["triplets"].count() == 3 and "Grid uses Cells" in report
    assert loop.RunStore.latest_resumable(spark, str(tmp_path), "grid") is None
    store = loop.RunStore(spark, str(tmp_path), "r2")
    store.note(query="grid", max_iterations=3)
    loop.step(loop.initial_state(spark, "grid"), acquire, extract, loop.Config(max_iterations=3), store)
    again = loop.RunStore.latest_resumable(spark, str(tmp_path), "grid")
    assert again.run_id == "r2" and again.resume().iteration == 1
    state, _ = loop.run(spark, "grid", acquire, extract, str(tmp_path), None, loop.Config(max_iterations=2))
    assert state.iteration == 2 and again.manifest()["resume_count"] == 2
    with pytest.raises(ValueError):
        loop.initial_state(spark, " ")


def test_budget_and_config():
    b = loop.Budget(max_queries=2)
    assert b.can_query() and not b.record() and b.record() and not b.can_query()
    assert not loop.Budget(dry_run=True).can_query()
    c = loop.Config.from_env({"EVIGRAPH_MAX_ITERATIONS": "9", "EVIGRAPH_CONFLICTS": "off", "EVIGRAPH_SATURATION": "x"})
    assert (c.max_iterations, c.conflicts, c.saturation) == (9, False, 0.10)


def test_streams(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.bin").write_bytes(b"x")
    streams.append_to(streams.watch_resources(spark, str(src)), out, ck).awaitTermination()
    (src / "c.md").write_text("two")
    streams.append_to(streams.watch_resources(spark, str(src)), out, ck).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(out).collect()) == ["one", "two"]


def run_stream(df, spark, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_stateful_streams(spark, tmp_path):
    folder = str(tmp_path / "ev")
    spark.createDataFrame([("g1", 1.0, "2025-01-01 00:00:00"), ("g1", 2.0, "2025-01-01 00:20:00"), ("g2", 3.0, "2025-01-01 02:00:00")], "id string, c double, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(folder)
    read = lambda: spark.readStream.schema("id string, c double, ts timestamp").parquet(folder)
    assert run_stream(streams.once_per_id(read(), "id"), spark, "s1").count() == 2
    assert run_stream(streams.once_per_id(read(), "id", "ts"), spark, "s2").count() == 2
    got = {r["id"]: (r["used"], r["exceeded"]) for r in run_stream(streams.running_budget(read(), "id", "c", 3.0), spark, "s3", "update").collect()}
    assert got == {"g1": (3.0, True), "g2": (3.0, True)}
    assert run_stream(streams.windowed_counts(read(), "ts", "1 hour"), spark, "s4", "update").agg(F.sum("n")).first()[0] == 3


def test_upsert_stream(spark, tmp_path):
    folder = str(tmp_path / "m")
    schema = "name string, type string, aliases array<string>, description string, document_id string, ord int"
    ck = str(tmp_path / "ck")
    out = str(tmp_path / "reg")
    for n, row in enumerate([("A", "org", ["x"], "", "d1", 1), (" A", None, ["y"], "text", "d2", 2)]):
        spark.createDataFrame([row], schema).write.mode("append").parquet(folder)
        streams.upsert_stream(spark.readStream.schema(schema).parquet(folder), out, ck, ["ord"]).awaitTermination()
    r = spark.read.parquet(f"{out}/version=1").collect()
    assert len(r) == 1 and r[0]["aliases"] == ["x", "y"] and r[0]["description"] == "text" and r[0]["source_document_ids"] == ["d1", "d2"]
