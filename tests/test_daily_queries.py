"""Queries over delivered tables, as their callers store them."""

from verification import QUERIES

SF = "/root/testdata/sf0.001"


def test_daily_increment_can_be_stored(spark, tmp_path):
    df = QUERIES["daily_increment"](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == df.columns
    assert {"position_stage", "position_stage_1", "trailing_stop_price_1"} <= set(df.columns)
