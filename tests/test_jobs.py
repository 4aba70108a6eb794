import pytest

from evigraph import cli
from evigraph.plans import jobs
from evigraph.sources.files import TableProvider


def test_status(spark):
    rows = [(1, 0, 0, 0), (0, 2, 0, 0), (0, 0, 3, 1), (0, 0, 0, 1), (0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "processes int, outputs int, inputs int, settings int")
    assert sorted(r["status"] for r in jobs.job_status(df).collect()) == sorted(jobs.STATUS)
    p = spark.createDataFrame([("python index --root x",), ("bash",)], "command string")
    assert jobs.matching_processes(p, ["index --root"]).count() == 1 and jobs.matching_processes(p, []).count() == 0


def test_index_job(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("a")
    limits, errors = [], ["context length exceeded", "connection refused", None]

    def build(limit):
        limits.append(limit)
        return errors[len(limits) - 1] if len(limits) <= 3 else None

    run = lambda: jobs.index_job(spark, str(src), str(tmp_path / "state"), build, 1200, sleep=lambda s: None)
    assert run() == "built" and limits == [4800, 2400, 2400] and run() == "unchanged"
    (src / "b.txt").write_text("b")
    assert run() == "built"
    assert jobs.index_job(spark, str(src), str(tmp_path / "s2"), lambda n: "odd failure", sleep=lambda s: None) == "odd failure"


def test_once_prompt_settings(tmp_path):
    ran = []
    assert jobs.once(str(tmp_path / "m"), lambda: ran.append(1)) and not jobs.once(str(tmp_path / "m"), lambda: ran.append(1)) and ran == [1]
    (tmp_path / "p.md").write_text(" hi \n")
    assert jobs.prompt("p.md", None, str(tmp_path)) == "hi"
    with pytest.raises(FileNotFoundError):
        jobs.prompt("q.md", str(tmp_path))
    s = jobs.Settings()
    assert s.write(str(tmp_path / "t")) and not s.write(str(tmp_path / "t")) and s.write(str(tmp_path / "t"), force=True)
    assert "  size: 1200\n" in s.text() and cli.main(["settings", str(tmp_path / "t")]) == 0


def test_cli_convert_finalize_query(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    assert cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "out.parquet")]) == 0 and spark.read.parquet(str(tmp_path / "out.parquet")).count() == 1
    t = TableProvider(spark, str(tmp_path / "idx"))
    t.write("entities", spark.createDataFrame([("A", 9), ("B", 9)], "title string, degree int"))
    t.write("relationships", spark.createDataFrame([("A", "B"), ("B", "A")], "source string, target string"))
    assert cli.main(["finalize", str(tmp_path / "idx")]) == 0
    assert {r["title"]: r["degree"] for r in t.read("entities").collect()} == {"A": 1, "B": 1} and t.read("relationships").count() == 2
    assert cli.main(["query", str(tmp_path / "none"), "what?"]) == 0 and "Error:" in capsys.readouterr().out
