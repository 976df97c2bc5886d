import json
import os

import pytest

from millrace.sinks.writers import StepFailed, with_retries
from millrace.streaming import intake
from millrace.streaming.intake import intake_to, new_files, read_intake, retire_taken, run_and_retire, run_available


def counts(spark, target):
    rows = read_intake(spark, target).groupBy("is_export").count().collect()
    return {r.is_export: r["count"] for r in rows}


def drop(folder, names, text):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_text(text)


def test_each_file_is_taken_once(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(source, ["a.json", "b.json"], json.dumps({"snaps": []}))
    drop(source, ["c.json"], "no export\nat all")
    run_available(new_files(spark, str(source)), intake_to(target), state)
    assert counts(spark, target) == {True: 2, False: 1}
    run_available(new_files(spark, str(source)), intake_to(target), state)
    assert counts(spark, target) == {True: 2, False: 1}
    drop(source, ["d.json"], "[]")
    run_available(new_files(spark, str(source)), intake_to(target), state)
    assert counts(spark, target) == {True: 2, False: 2}


def test_sources_are_retired_after_a_later_batch(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for name in ("a", "b", "c"):
        drop(source, [f"{name}.json"], "{}")
        stream = new_files(spark, str(source), retire="delete", max_files=1)
        run_available(stream, intake_to(target), state)
    assert counts(spark, target) == {False: 3}
    left = set(os.listdir(source))
    assert "a.json" not in left and "c.json" in left


def test_one_run_retires_all_its_batches(spark, tmp_path):
    source, target, state, ledger = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ledger")
    drop(source, ["a.json", "b c.json", "d%20é.json"], "{}")
    assert run_and_retire(new_files(spark, str(source), max_files=1), intake_to(target), state, ledger) == 3
    assert counts(spark, target) == {False: 3} and os.listdir(source) == []
    drop(source, ["e.json"], "{}")
    moved = str(tmp_path / "old")
    assert run_and_retire(new_files(spark, str(source)), intake_to(target), state, ledger, retired_to=moved) == 1
    assert counts(spark, target) == {False: 4} and os.listdir(source) == []
    assert os.listdir(moved + str(source)) == ["e.json"]
    assert retire_taken(spark, ledger) == 0


def test_absent_sources_are_an_error_once(spark, tmp_path, monkeypatch):
    source, target, state, ledger = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ledger")
    drop(source, ["a.json", "b.json"], "{}")

    def then_loses_one(*args):
        run_available(*args)
        os.remove(source / "a.json")

    monkeypatch.setattr(intake, "run_available", then_loses_one)
    with pytest.raises(StepFailed, match="a.json \\(absent\\)"):
        run_and_retire(new_files(spark, str(source)), intake_to(target), state, ledger)
    assert os.listdir(source) == []
    assert retire_taken(spark, ledger) == 2


def test_a_file_that_stays_is_tried_again(spark, tmp_path, monkeypatch):
    source, ledger, calls = tmp_path / "in", str(tmp_path / "ledger"), []
    drop(source, ["a.json"], "{}")
    blocked = tmp_path / "old"
    blocked.write_text("a file where a folder should be")

    def counted(action, retries, interval):
        return with_retries(lambda: (calls.append(1), action())[1], retries, interval)

    monkeypatch.setattr(intake, "with_retries", counted)
    with pytest.raises(StepFailed, match="a.json"):
        run_and_retire(
            new_files(spark, str(source)), intake_to(str(tmp_path / "out")), str(tmp_path / "state"), ledger, str(blocked), interval=0
        )
    assert len(calls) == 3 and os.listdir(source) == ["a.json"]
    assert retire_taken(spark, ledger) == 1 and os.listdir(source) == []
