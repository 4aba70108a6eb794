import ast
import io
import json
import zipfile
from datetime import datetime

from evigraph import cli
from evigraph.exports import graph_files
from evigraph.operators import graph
from evigraph.plans import index, jobs
from evigraph.sources import code, files
from evigraph.sources.fs import Files

TEXT = "Anna Berg met Carl Dorn in Old Town. Later Anna Berg wrote to Carl Dorn about Old Town."


def docs(spark):
    return spark.createDataFrame([("d1", TEXT, 1), ("d2", "Carl Dorn left.", 2), ("d3", None, 3), ("d4", "", 4)], "document_id string, content string, id int")


def test_fast_index(spark, tmp_path):
    units = index.text_units(docs(spark), "document_id", "content", 5, 1)
    assert {r["document_id"] for r in units.collect()} == {"d1", "d2", "d4"} and len({r["id"] for r in units.collect()}) == units.count()
    whole = index.text_units(docs(spark), "document_id", "content")
    assert {r["title"]: (r["frequency"], r["units"]) for r in index.index_entities(whole).collect()} == {"Anna Berg": (1, 1), "Later Anna Berg": (1, 1), "Carl Dorn": (3, 2), "Old Town": (2, 1)}
    assert {(r["source"], r["target"]): r["weight"] for r in index.index_relationships(whole).collect()} == {("Anna Berg", "Carl Dorn"): 1, ("Carl Dorn", "Old Town"): 2, ("Carl Dorn", "Later Anna Berg"): 1, ("Later Anna Berg", "Old Town"): 1}
    steps = index.build(spark, docs(spark), str(tmp_path / "idx"))
    assert steps == [(n, None) for n in ("text_units", "relationships", "entities", "communities", "community_reports")]
    empty = index.build(spark, docs(spark).limit(0), str(tmp_path / "none"))
    assert all(e is None for _, e in empty)
    broken = index.build(spark, docs(spark), str(tmp_path / "x"), key="missing")
    assert len(broken) == 1 and broken[0][1]
    o = index.outcome(spark.createDataFrame([("b", "no"), ("a", "bad"), ("c", None)], "step string, error string")).first()
    assert (o["completed"], o["failed"], o["errors"]) == (1, 2, "a: bad; b: no")


def test_cli_index_status_and_snapshot(spark, tmp_path, capsys):
    docs(spark).write.parquet(str(tmp_path / "docs.parquet"))
    folder = str(tmp_path / "job")
    assert cli.main(["status", folder]) == 0 and capsys.readouterr().out.strip() == "NOT_INITIALIZED"
    assert cli.main(["settings", folder]) == 0 and cli.main(["status", folder]) == 0 and capsys.readouterr().out.strip().endswith("INITIALIZED")
    assert cli.main(["status", folder, "--documents", str(tmp_path / "docs.parquet")]) == 0 and capsys.readouterr().out.strip() == "READY_TO_INDEX"
    assert cli.main(["index", str(tmp_path / "docs.parquet"), folder]) == 0 and "5 steps" in capsys.readouterr().out
    assert cli.main(["status", folder]) == 0 and capsys.readouterr().out.strip() == "IDLE_WITH_OUTPUT"
    assert cli.main(["finalize", f"{folder}/output", "--graphml"]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "job" / "output" / "graph.graphml").glob("part-*")))
    assert text.count("<edge ") == 4 and text.strip().endswith("</graphml>")


def test_finalize_goes_on_after_a_stop_between_the_moves(spark, tmp_path):
    t = files.TableProvider(spark, str(tmp_path))
    t.write("entities", spark.createDataFrame([("A", 9), ("B", 9)], "title string, degree int"))
    spark.createDataFrame([("A", "B", 2, 0, "x")], "source string, target string, combined_degree int, human_readable_id long, id string").write.parquet(f"{tmp_path}/relationships.new.parquet")
    spark.createDataFrame([("A", 1, 0, "y"), ("B", 1, 1, "z")], "title string, degree int, human_readable_id long, id string").write.parquet(f"{tmp_path}/entities.new.parquet")
    assert [r["id"] for r in jobs.finalize_job(spark, str(tmp_path))] == ["x"] and {r["degree"] for r in t.read("entities").collect()} == {1}


def test_files(spark, tmp_path):
    f, path = Files(spark), f"{tmp_path}/a/note.txt"
    assert not f.exists(path) and f.names(f"{tmp_path}/a") == []
    f.make(f"{tmp_path}/a")
    f.write(path, "grün")
    f.write(path, "grün 2")
    assert f.read(path) == "grün 2" and f.names(f"{tmp_path}/a") == ["note.txt"]
    ran = []
    assert jobs.once(f"{tmp_path}/m", lambda: ran.append(1), spark) and not jobs.once(f"{tmp_path}/m", lambda: ran.append(1), spark) and ran == [1]


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


def palm(records, kind, length):
    head = kind.to_bytes(2, "big") + b"\0\0" + length.to_bytes(4, "big") + len(records).to_bytes(2, "big") + (4096).to_bytes(2, "big") + b"\0\0\0\0"
    all_, at, table = [head, *records], 78 + 8 * (len(records) + 1) + 2, b""
    for r in all_:
        table += at.to_bytes(4, "big") + b"\0\0\0\0"
        at += len(r)
    return b"book".ljust(60, b"\0") + b"TEXtREAd" + b"\0" * 8 + len(all_).to_bytes(2, "big") + table + b"\0\0" + b"".join(all_)


def test_mobi():
    assert files.read_mobi(palm([b"<p>Hello &amp; good", b" day</p>"], 1, 24)) == "Hello & good day"
    # literals, a run of two literals, "space + x", and a back reference of three letters five letters back
    packed = b"<p>" + b"abc" + b"\x02\xc3\xa9" + bytes((ord("x") ^ 0x80,)) + bytes((0x80 | (7 << 3 | 0) >> 8, (7 << 3 | 0) & 0xFF))
    assert files.read_mobi(palm([packed], 2, 10)) == "abcÃ© xabc"
    assert files.read_mobi(b"not a book") is None and files.read_mobi(palm([b"x"], 17480, 1)) is None


def test_readers(tmp_path):
    epub = zipped({"OEBPS/c.opf": '<package><manifest><item id="a" href="z.xhtml"/><item id="b" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "OEBPS/a.xhtml": "<p>second</p>", "OEBPS/z.xhtml": "<style>p{}</style><p>first</p>"})
    assert files.read_epub(epub) == "first\n\nsecond"
    mbox = b"From a@x Mon\nSubject: Hi\nFrom: a@x\n\nBody one\n\nFrom b@x Tue\nSubject: Re\nContent-Type: text/html\n\n<b>Body</b> two\n"
    assert files.read_mbox(mbox) == "Subject: Hi\nFrom: a@x\nBody one\n\nSubject: Re\nBody two"
    ods = zipped({"content.xml": '<d xmlns:t="t"><spreadsheet><t:table t:name="S"><t:table-row><t:table-cell>1</t:table-cell><t:table-cell>2</t:table-cell></t:table-row></t:table></spreadsheet></d>'})
    assert files.read_open_document(ods) == "## Sheet: S\n1\t2" and files.read_open_document(zipped({"content.xml": "<d><h>T</h><p>x</p></d>"})) == "T\nx"
    cell = lambda v: f'<worksheet><row><c r="A1"><v>{v}</v></c></row></worksheet>'
    r = 'xmlns:r="rel"'
    xlsx = zipped({"xl/workbook.xml": f'<workbook {r}><sheets><sheet name="First" r:id="r2"/><sheet name="Second" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>', "xl/worksheets/sheet1.xml": cell(1), "xl/worksheets/sheet2.xml": cell(2)})
    assert files.read_xlsx(xlsx) == "## Sheet: First\n2\n\n## Sheet: Second\n1"


def test_code_keeps_dots_annotations_and_returns():
    src = 'import os.path\nclass A(base.B):\n    """Doc."""\n    def m(self, x: int = 3, *a, **k) -> str:\n        return os.path.join(f(x)(1), self.g())\n@app.route("/")\nasync def top(): ...\n'
    rows = list(code.python_items(src))
    assert ("class", "A", "base.B", "Doc.") in rows and ("method", "A.m", "(self, x: int=3, *a, **k) -> str", None) in rows and ("decorator", "top", "app.route", None) in rows
    assert [r[1] for r in rows if r[0] == "call"] == ["app.route", "f", "os.path.join", "self.g"] and ast.parse(src)


def test_pacing_usage_and_settings(spark, tmp_path):
    now, slept = [100.0], []
    p = jobs.Pacing(2, 5, clock=lambda: now[0], sleep=slept.append, draw=lambda a, b: 3.0)
    assert p.wait() == 0.0
    now[0] += 1
    assert p.wait() == 2.0 and slept == [2.0]
    now[0] += 10
    assert p.wait() == 0.0
    for used in (1.0, 2.0):
        jobs.append_usage(spark, f"{tmp_path}/usage", "k1", used, 10.0, "test")
    got = spark.read.json(f"{tmp_path}/usage").orderBy("credits_used").collect()
    assert [(r["key_tail"], r["credits_remaining"]) for r in got] == [("k1", 9.0), ("k1", 8.0)] and datetime.fromisoformat(got[0]["timestamp"].replace("Z", "+00:00"))
    s = jobs.Settings(provider="openai", model="m", api_key="secret", embedding_provider="ollama", embedding_model="e")
    assert s.write(str(tmp_path / "s")) and (tmp_path / "s" / ".env").read_text() == "GRAPHRAG_API_KEY=secret\nGRAPHRAG_EMBEDDING_API_KEY=secret\n"
    assert "secret" not in s.text() and '${GRAPHRAG_API_KEY}' in s.text() and '    provider: "ollama"' in s.text()
    assert jobs.Settings().env() == "" and "http://localhost:11434" in jobs.Settings().text()


def test_graph_json_is_one_object(spark):
    n = spark.createDataFrame([("b",), ("a",)], "node_id string")
    e = spark.createDataFrame([("a", "b", 2), ("b", "a", 1)], "source string, target string, weight int")
    text = lambda n, e: "".join(r["line"] for r in graph_files.graph_json(n, e).orderBy("part", "key").collect())
    assert json.loads(text(n, e)) == {"node_count": 2, "edge_count": 2, "nodes": [{"node_id": "a"}, {"node_id": "b"}], "edges": [{"source": "a", "target": "b", "weight": 2}, {"source": "b", "target": "a", "weight": 1}]}
    assert json.loads(text(n.limit(0), e.limit(0))) == {"node_count": 0, "edge_count": 0, "nodes": [], "edges": []}


def test_names_parts_and_processes(spark):
    lines = spark.createDataFrame([("NAME  ID",), ("m1:7b  x",), ("m1:7b  y",), ("",), (None,)], "line string")
    assert [r["name"] for r in index.model_names(lines).collect()] == ["m1:7b"]
    p = spark.createDataFrame([(1, 'py index --root "a b" --method fast'), (2, "py index --root=/x"), (3, "bash"), (4, None)], "pid int, command string")
    assert {(r["pid"], r["root"], r["method"]) for r in index.command_arguments(p).collect()} == {(1, "a b", "fast"), (2, "/x", None)}
    d = spark.createDataFrame([("in/a.md", "x" * 25), ("in/b.md", ""), ("in/c.md", None)], "path string, text string")
    got = {r["name"]: r["text"] for r in index.part_files(d, 10).collect()}
    assert len(got) == 4 and all(t.startswith("Source: ") for t in got.values()) and sum("_part" in n for n in got) == 3
    assert [r["text"] for r in index.truncated_code(d, 5).orderBy("path").collect()] == ["xxxxx", ""]


def test_disputed_names_that_begin_alike(spark):
    e = spark.createDataFrame([(f"International House of {w}",) for w in ("Bread", "Stone", "Wool")] + [("Al",), ("",), (None,)], "canonical_name string")
    c = spark.createDataFrame([("the INTERNATIONAL HOUSE OF STONE", None, "al dente")], "topic string, claim_a string, claim_b string")
    assert {r["name"] for r in graph.disputed_entities(e, c).collect()} == {"International House of Stone", "Al"}
