"""Tables that are stored on the way, and what they leave on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from barquet.session import assume, discard, materialize


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for n in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(assume(spark))
    counts = materialize(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert sorted(r["count"] for r in counts.collect()) == [714] * 5 + [715] * 2
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) - before == set()


def test_a_frame_can_be_read_again_after_its_shuffle_is_gone(spark):
    counts = assume(spark).range(5000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(counts.collect()) == sorted(counts.collect()) and counts.count() == 7


def test_discard_deletes_stored_frames_only(spark):
    kept, gone = materialize(spark.range(3), "kept"), materialize(spark.range(4), "gone")
    folder = Path(gone.inputFiles()[0].removeprefix("file:")).parent
    assert folder.is_dir()
    discard(gone, spark.range(2), gone)
    assert not folder.exists() and kept.count() == 3
