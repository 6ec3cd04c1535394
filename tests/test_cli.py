from platewise.__main__ import main


def test_list_and_run(spark, data, tmp_path, capsys):
    assert main(["list"]) == 0 and "cleaning_waterfall" in capsys.readouterr().out
    assert main(["run", "prof_hist", data], spark) == 0 and "rating" in capsys.readouterr().out
    assert main(["run", "prof_hist", data, "--out", f"{tmp_path}/h.md", "--format", "markdown"], spark) == 0
    assert (tmp_path / "h.md").read_text().startswith("## prof_hist")
    assert main(["run", "prof_hist", data, "--out", f"{tmp_path}/h", "--format", "json"], spark) == 0
    assert spark.read.json(f"{tmp_path}/h").count() > 0
