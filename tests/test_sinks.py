"""Versions with several writers, and windows of a stream by batch."""

from __future__ import annotations

from pathlib import Path

import pytest

from lodestone.sources import sinks
from lodestone.streaming import folds


def test_versions(spark, tmp_path):
    path, rows = str(tmp_path / "v"), spark.range(3)
    assert sinks.write_version(rows, path, 0) == 1
    with pytest.raises(ValueError, match="version 1 where 0"):
        sinks.write_version(rows, path, 0)
    Path(path, ".claim-2").touch()
    with pytest.raises(ValueError, match="written by someone else"):
        sinks.write_version(rows, path, 1)
    Path(path, ".claim-2").unlink()
    with pytest.raises(Exception, match="broken"):
        sinks.write_version(rows.selectExpr("raise_error('broken') AS id"), path, 1)
    assert sinks.write_version(spark.range(5), path, 1) == 2 == sinks.current_version(spark, path)
    assert not [p for p in Path(path).iterdir() if p.name.startswith((".claim", ".next"))]
    assert not sinks.write_if_changed(spark.range(5), path) and sinks.write_if_changed(spark.range(6), path)


def test_batches_that_were_cut_off_do_not_count(spark, tmp_path):
    for k, whole in ((9, True), (10, True), (11, False)):
        Path(tmp_path, str(k)).mkdir()
        if whole:
            Path(tmp_path, str(k), "_SUCCESS").touch()
    assert sorted(folds.whole_batches(spark, str(tmp_path))) == [9, 10]


def test_sink_deals_rows_before_it_sorts(spark, tmp_path, monkeypatch):
    """Rows of one file were sorted by the task that read it, however many they were."""
    rows, path = spark.range(1000).selectExpr("id % 400 AS k", "string(id) AS v").coalesce(1), str(tmp_path / "ledger")
    monkeypatch.setattr(sinks, "parts", lambda d: 8)
    sinks.append_events(rows, path, "k")
    assert len(list(Path(path).glob("part-*"))) == 8
    sinks.append_events(rows.unionByName(spark.range(500, 510).selectExpr("id AS k", "'x' AS v")), path, "k")
    assert sorted(x.k for x in spark.read.parquet(path).collect()) == [*range(400), *range(500, 510)]


def test_parts_of_a_stream_have_many_files(spark):
    """Each batch of a stream is one part of the rows, also if several tasks wrote it."""
    from lodestone.plans import flows

    seen, rows = [], spark.range(0, 90, 1, 4).selectExpr("id", "int(id % 3) AS batch")
    out = flows.folder(spark)

    def run(stream):
        folds.run(stream, f"{out}/checkpoint", lambda b, k: seen.append((k, b.select("batch").distinct().collect(), b.count(), len(b.inputFiles()))))
        return stream

    flows._streamed(spark, rows, rows.batch, run)
    assert [(k, [x.batch for x in b], n) for k, b, n, _ in seen] == [(k, [k], 30) for k in range(3)]
