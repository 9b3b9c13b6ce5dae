import json

import pytest
from pyspark.sql import functions as F

from evenkeel import cli, report

SF = "/root/testdata/sf0.001"


def test_list_and_wrong_usage(capsys):
    assert cli.main(["list"]) == 0
    listed = [json.loads(line)["query"] for line in capsys.readouterr().out.splitlines()]
    assert {"gates_v1", "replayed_chains", "revalidated_nominations", "chat_streams", "policy_widenings"} <= set(listed)
    assert cli.main(["nothing"]) == 2 and cli.main(["run", "no_such_query", SF]) == 2
    assert json.loads(capsys.readouterr().err.splitlines()[-1]) == {"error": "unknown-query"}


def test_run_prints_or_writes(spark, capsys, tmp_path):
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert cli.main(["run", "runtime_capabilities", SF]) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert len({r["capability"] for r in rows}) == 16 and sum(r["instances"] for r in rows) == 16 * suppliers
    out = str(tmp_path / "rows")
    assert cli.main(["run", "runtime_capabilities", SF, "--out", out]) == 0
    assert spark.read.parquet(out).count() == len(rows)


def test_digest_refuses_duplicate_keys(tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"b": 1, "a": [true, null]}')
    bad.write_text('{"a": "secret", "a": 2}')
    assert cli.main(["digest", "evenkeel/x/1", str(good)]) == 0
    assert json.loads(capsys.readouterr().out)["digest"].startswith("sha256:")
    assert cli.main(["digest", "evenkeel/x/1", str(bad)]) == 3
    assert "secret" not in capsys.readouterr().err


def test_report(spark, capsys):
    code = cli.main(["report", SF])
    text = capsys.readouterr().out
    assert code == (1 if "No policy passes" in text else 0)
    assert text.startswith("# Development report") and "| cascade-0.3-500 |" in text and "## Failed gates" in text


def test_table_escapes_and_refuses_many_rows(spark):
    got = report.table(spark.createDataFrame([("a|b\nc", None, 0.5)], "x string, y int, z double"), ["x"])
    assert got.splitlines()[-1] == "| a\\|b c | - | 0.5 |"
    with pytest.raises(ValueError):
        report.table(spark.range(1001).select(F.col("id")), ["id"])
