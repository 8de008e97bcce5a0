import pytest

from simloom import cli

SET = ["--set", "dim=4", "--set", "tables=4", "--set", "chain_length=2", "--set", "top_k=3"]


@pytest.fixture
def files(tmp_path):
    rows = [f"({k},4,[0,1,2,3],[{k % 3}.5,{k % 5}.0,{k % 2}.0,{1 + k / 10}])" for k in range(30)]
    (tmp_path / "v.txt").write_text("\n".join(rows))
    return tmp_path


def run(spark, *argv):
    return cli.run(spark, cli.parse([*argv, *SET]))


def test_modes(spark, files):
    v, out = str(files / "v.txt"), str(files / "out")
    assert run(spark, "generate", "--out", out + "f") == {"functions": 8}
    assert run(spark, "index", "--vectors", v, "--out", out + "i") == {"vectors": 30}
    assert spark.read.parquet(out + "i").count() == 120
    assert run(spark, "search", "--vectors", v, "--out", out + "s")["answers"] > 0
    got = run(spark, "accuracy", "--vectors", v, "--queries", "7", "--set", "normalize=true")
    assert 0 < got["recall"] <= 1 and got["mean_ratio"] >= 1 - 1e-9
    assert run(spark, "write", "--vectors", v)["vectors"] == run(spark, "read", "--vectors", v)["vectors"] == 30


def test_timing_modes(spark, files):
    v = str(files / "v.txt")
    assert run(spark, "latency", "--vectors", v, "--queries", "3")["queries"] == 3
    got = run(spark, "parallel", "--vectors", v, "--queries", "4", "--threads", "2")
    assert got["threads"] == 2 and got["min"] <= got["average"] <= got["max"] and got["per_second"] > 0
    assert run(spark, "storage", "--vectors", v, "--out", str(files / "stored"))["vectors"] == 30
    assert 0 < run(spark, "accuracy", "--vectors", v, "--queries", "7", "--unindexed", "--set", "normalize=true")["recall"] <= 1


def test_stream_mode(spark, files):
    rows = spark.range(6).selectExpr("id AS vector_id", "array(1D, 2D, 0.5D, cast(id AS double)) AS values")
    rows.coalesce(1).write.parquet(str(files / "in"))
    assert run(spark, "stream", "--vectors", str(files / "in"), "--out", str(files / "state"))["answers"] > 0


def test_wrong_arguments():
    for argv in (["search"], ["index", "--vectors", "x"], ["nothing"]):
        with pytest.raises(SystemExit):
            cli.parse(argv)
