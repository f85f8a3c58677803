from sightline.__main__ import main


def test_list_and_unknown(capsys):
    assert main(["list"]) == 0
    assert "cooldown_log" in capsys.readouterr().out.split()
    assert main(["query", "nothing", "--data", "x", "--out", "y"]) == 2


def test_query(spark, tmp_path):
    out = str(tmp_path / "o")
    assert main(["query", "track_durations", "--data", "/root/testdata/sf0.001", "--out", out, "--format", "json"]) == 0
    assert spark.read.json(out).count() > 0
