"""Bursts of changes as one flush each, also over a restart."""

from __future__ import annotations

import time

from lodestone.streaming import debounce

SCHEMA = "key string, id string, urgent boolean"


def test_one_flush_a_burst(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def start():
        made = debounce.flushes(spark.readStream.schema(SCHEMA).parquet(src), 15_000, most=5)
        return made, made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="500 milliseconds").start()

    def rows(made):
        return sorted(tuple(x) for x in spark.read.schema(made.schema).parquet(f"{out}/rows").collect())

    def until(made, query, n):
        for _ in range(120):
            assert query.exception() is None
            if len(rows(made)) >= n:
                return rows(made)
            time.sleep(0.5)
        return rows(made)

    put(("a", "1", False), ("a", "2", None), ("b", "3", True), *(("c", str(k), False) for k in range(4, 9)))
    made, query = start()
    first = until(made, query, 2)
    query.stop()  # a's burst is open
    assert first == [("b", 1, "3", "3", "urgent"), ("c", 5, "4", "8", "full")]
    put(("a", "9", False))
    made, query = start()
    second = until(made, query, 3)
    query.stop()
    assert second == [("a", 3, "1", "9", "quiet"), *first]
    made, query = start()  # nothing is flushed again
    time.sleep(3)
    query.stop()
    assert rows(made) == second
