"""Phases run once, go on after a stop, and make later ones stale."""

import pytest

from siltline.plans.phases import Progress, Scan, Stopped, recheck


def scan(path, log, partial=()):
    s = Scan(Progress(str(path / "progress.json")), stop_flag=str(path / "stop"))
    for name in ("history", "carve", "verify"):

        @s.phase(name)
        def work(_, name=name):
            log.append(name)
            return name not in partial

    return s


def test_phases(tmp_path):
    log = []
    assert scan(tmp_path, log).run() == ["history", "carve", "verify"]
    assert scan(tmp_path, log).run() == [] and len(log) == 3
    again = scan(tmp_path, log)
    assert again.run(["history"], again=True) == ["history"]
    assert again.progress.is_done("carve") and not again.progress.is_done("verify")
    assert scan(tmp_path, log).run() == ["verify"]
    with pytest.raises(ValueError):
        again.run(["nothing"])


def test_partial_phases_and_stops(tmp_path):
    log = []
    assert scan(tmp_path, log, partial=("carve",)).run(["history", "carve"]) == ["history", "carve"]
    (tmp_path / "stop").touch()
    with pytest.raises(Stopped):
        scan(tmp_path, log).run()
    (tmp_path / "stop").unlink()
    assert scan(tmp_path, log).run() == ["carve", "verify"]
    progress = Progress(str(tmp_path / "progress.json"))
    progress.mark("carve", "0-64")
    assert progress.remaining("carve", ["0-64", "64-128", "64-128"]) == ["64-128"]


def test_recheck_counts(spark):
    before = spark.createDataFrame([(1, 0, "ok"), (1, 1, "zeroed"), (1, 2, "cksum_mismatch"), (2, 0, "hole")], "volume int, blkid long, status string")
    found = recheck(before, before.where("blkid = 2").replace("cksum_mismatch", "ok_stale"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1, 1), (2, 0, 0, 0)]
