"""Batches and state of the stream of running totals, where there are many files or rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.streaming import counts


@pytest.mark.parametrize("on_disk", [False, True])
def test_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch, on_disk):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.repartition(24).write.parquet(str(tmp_path / "lineitem.parquet"))
    places, start = [], counts.qc_stream
    monkeypatch.setattr(counts, "qc_stream", lambda *a, **b: places.append(a[2]) or start(*a, **b))
    if on_disk:
        monkeypatch.setattr(counts, "STATE_ROWS", 0)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "4m")
    try:
        got = {tuple(r) for r in __spark_entry__.queries()["streaming_qc"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(names[0], before[0])
    assert [spark.conf.get(n) for n in names] == before
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(c.execute(__spark_entry__.oracle_sql()["streaming_qc"]).fetchall()) and got
    check = Path(places[0].removeprefix("file:"))
    # Twenty files of four tasks, four a batch, and one without rows for each start.
    assert len(set(places)) == 1 and 2 <= len([p for p in (check / "offsets").iterdir() if p.name.isdigit()]) <= 7
    assert any((check / "state").rglob("*.changelog")) == on_disk
