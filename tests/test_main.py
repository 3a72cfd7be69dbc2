"""The command line."""

import subprocess

import pytest

from thermolith.__main__ import COMMANDS, main
from thermolith.operators.store import RunStore, git_commit


def test_usage(capsys, spark):
    for args in ([], ["single"], ["nothing", "folder"]):
        assert main(args) == 2
    said = capsys.readouterr().out
    assert all(c in said for c in COMMANDS)


def test_check_and_generate(spark, tmp_path, capsys):
    assert main(["check", "."]) == 0 and "sum 45" in capsys.readouterr().out
    assert main(["generate", f"{tmp_path}/day"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/day").count() == 96


def test_experiments_and_every_report(spark, tmp_path, capsys):
    folder = f"{tmp_path}/store"
    assert main(["single", folder]) == 0 and main(["robustness", folder, "ideal", "combined_nonideal"]) == 0
    assert "runs:" in capsys.readouterr().out
    store = RunStore(spark, folder).initialize()
    assert store.runs().where("status = 'completed'").count() == store.runs().count() == 9
    for command, words in {
        "compare": ("energy_cost", "PASS"), "report": ("Energy cost", "finite_horizon vs baseline cost: -3.66%"), "coordination": ("electricity_price", "finite_horizon"), "thermal": ("baseline", "longest_below_min_streak"),
        "events": ("maximum prediction error",), "degradation": ("combined_nonideal",), "inspect": ("single_center_robustness",),
    }.items():
        assert main([command, folder]) == 0
        said = capsys.readouterr().out
        assert all(w in said for w in words), (command, said[-800:])


def test_commit_of_a_repository(tmp_path):
    assert git_commit(str(tmp_path)) is None and git_commit(f"{tmp_path}/absent") is None
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True).stdout.strip()
    try:
        run("init", "-q")
        run("-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-q", "--allow-empty", "-m", "first")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git here")
    assert git_commit(str(tmp_path)) == run("rev-parse", "HEAD")
