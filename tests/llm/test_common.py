"""Stored tables: only what was stored goes, each thread's at its own time."""

import os
import threading

from foldloom.llm import common


def test_discard_spares_tables_of_others(spark, tmp_path):
    path = str(tmp_path / "table-2024" / "documents.parquet")
    spark.range(5).write.parquet(path)
    (tmp_path / "table-2024" / "notes.txt").write_text("stays")
    common.discard(spark.read.parquet(path))
    flat = str(tmp_path / "table-0123456789abcdef0123456789abcdef")
    spark.range(5).write.parquet(flat)
    common.discard(spark.read.parquet(flat))
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(flat).count() == 5
    own = common.stored(spark.range(3))
    folder = os.path.dirname(own.inputFiles()[0].removeprefix("file://"))
    common.discard(own)
    assert not os.path.exists(folder)


def test_temporary_tables_of_two_threads(spark):
    first, second, found = threading.Event(), threading.Event(), {}

    def one():
        with common.temporary(spark) as kept:
            common.stored(spark.range(1))
            found["kept"] = kept(spark.range(7))
            first.set()
            second.wait(60)  # the other block opens and stores meanwhile, and ends later

    def two():
        first.wait(60)
        with common.temporary(spark):
            own = common.stored(spark.range(9))
            second.set()
            threads[0].join(60)
            found["own"] = own.count()

    threads = [threading.Thread(target=f) for f in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert found["own"] == 9 and found["kept"].count() == 7
    common.discard(found["kept"])
