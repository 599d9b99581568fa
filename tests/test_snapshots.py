"""Tables that change all at once: versions, copies on write, failures half-way."""

import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from barquet.operators import quality
from barquet.session import shared_folder
from barquet.sources.layout import Tiles
from barquet.sources.snapshots import Conflict, Snapshots

SCHEMA = "symbol string, trade_date int, x double"


@pytest.fixture
def store(spark):
    return Snapshots(spark, f"{shared_folder(spark)}/snap/{uuid.uuid4().hex}")


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()))


def panel(spark, symbols="ABCD", days=range(5)):
    return rows(spark, *[(s, d, float(d)) for s in symbols for d in days])


def test_rebuild_and_older_version(spark, store):
    with store.transaction() as t:
        t.rebuild(rows(spark, ("A", 1, 1.0)), "t")
    with store.transaction() as t:
        t.rebuild(rows(spark, ("B", 2, 2.0)), "t")
        t.append(rows(spark, ("C", 3, None)), "u")
    assert store.version() == 2 and store.tables() == ["t", "u"]
    assert content(store.read("t")) == [("B", 2, 2.0)]
    assert content(store.read("t", 1)) == [("A", 1, 1.0)]
    with pytest.raises(KeyError):
        store.read("u", 1)


def test_delete_leaves_other_files_alone(spark, store):
    with store.transaction() as t:
        t.rebuild(panel(spark), "t", ("symbol",), 4)
    before = store.files("t")
    with store.transaction() as t:
        assert t.delete("t", rows(spark, ("B", 3, 0.0)).select("symbol", "trade_date")) == 1
    after = store.files("t")
    assert len(before) == 4 and len(set(before) & set(after)) == 3
    assert content(store.read("t")) == content(panel(spark).filter("not (symbol = 'B' and trade_date = 3)"))
    with store.transaction() as t:
        assert t.delete("t", rows(spark, ("B", 3, 0.0)).select("symbol", "trade_date")) == 0
    assert store.files("t") == after


def test_failing_job_leaves_the_old_tables(spark, store):
    with store.transaction() as t:
        t.rebuild(panel(spark), "t")
        t.append(rows(spark, ("A", 1, 1.0)), "u")
    broken = panel(spark).withColumn("x", F.when(F.col("symbol") == "D", F.raise_error(F.lit("dies")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="dies"):
        with store.transaction() as t:
            t.append(rows(spark, ("Z", 1, 1.0)), "u")
            t.rebuild(broken, "t")
    assert store.version() == 1
    assert content(store.read("t")) == content(panel(spark)) and content(store.read("u")) == [("A", 1, 1.0)]


def test_second_writer_of_a_version_fails(spark, store):
    first, second = store.transaction(), store.transaction()
    first.append(rows(spark, ("A", 1, 1.0)), "t")
    second.append(rows(spark, ("B", 1, 1.0)), "t")
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert content(store.read("t")) == [("A", 1, 1.0)]


def test_insert_absent_twice(spark, store):
    new = rows(spark, ("A", 1, 1.0), ("A", 1, 1.0), ("B", 1, 2.0))
    for _ in range(2):
        with store.transaction() as t:
            t.insert_absent(new, "t", ("symbol", "trade_date"))
    assert content(store.read("t")) == [("A", 1, 1.0), ("B", 1, 2.0)]


def test_replacements(spark, store):
    with store.transaction() as t:
        t.rebuild(panel(spark, "AB", range(3)), "t", ("symbol",), 2)
    with store.transaction() as t:
        t.replace_dates(rows(spark, ("A", 1, 9.0), ("C", 7, float("nan"))), "t", ("symbol", "trade_date"))
        t.replace_keys_on_dates(rows(spark, ("B", 2, 8.0)), "t")
    assert content(store.read("t")) == [("A", 0, 0.0), ("A", 1, 9.0), ("A", 2, 2.0), ("B", 0, 0.0), ("B", 2, 8.0), ("C", 7, None)]
    with store.transaction() as t:
        t.compact("t", ("symbol",), 1)
    assert len(store.files("t")) == 1 and store.read("t").count() == 6


def test_transaction_reads_its_own_changes_and_empty_tables(spark, store):
    t = store.transaction()
    t.append(spark.createDataFrame([], SCHEMA), "t")
    assert t.read("t").count() == 0
    t.append(rows(spark, ("A", 1, 1.0)), "t")
    assert t.read("t").count() == 1 and store.version() == 0
    t.delete("t", rows(spark, ("A", 1, 1.0)).select("symbol"))
    t.commit()
    assert store.read("t").count() == 0


def test_stale_rows_leave_the_stored_panel(spark, store):
    data = [(s, date(2024, 1, d), 10.0, 10.0, 10.0, 10.0, 0 if s == "B" and d in (3, 4, 5) else 100)
            for s in "AB" for d in range(1, 9)]
    bars = spark.createDataFrame(
        data, "symbol string, trade_date date, open_price double, high_price double, low_price double, close_price double, volume long")
    with store.transaction() as t:
        t.rebuild(bars, "prices", ("symbol",), 2)
    before = store.files("prices")
    with store.transaction() as t:
        assert quality.delete_stale(t, "prices", date(2024, 1, 9)) == 2
    assert len(set(before) & set(store.files("prices"))) == 1
    log = store.read("quality_log").collect()
    assert [(r.symbol, r.rows_affected) for r in log] == [("B", 2)]
    assert store.read("prices").count() == 14
    with store.transaction() as t:
        assert quality.delete_stale(t, "prices", date(2024, 1, 9)) == 0
    assert store.read("quality_log").count() == 1


# ------------------------------------------------------------------ layout and dates
def plan_metrics(df):
    """(node name, output rows) of all operators of a query that was run."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(plan.executedPlan())
            return
        if name.endswith("QueryStageExec"):
            yield from walk(plan.plan())
            return
        if plan.metrics().contains("numOutputRows"):
            yield name, plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        for k in range(children.size()):
            yield from walk(children.apply(k))

    return list(walk(execution.executedPlan()))


def scanned_rows(df):
    """Rows that file scans of a query handed on."""
    return sum(n for name, n in plan_metrics(df) if name == "FileSourceScanExec")


def joined_rows(df):
    return sum(n for name, n in plan_metrics(df) if name.endswith("JoinExec"))


@pytest.fixture(scope="module")
def tiled(spark):
    days = spark.range(400).select(F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int")).alias("trade_date"))
    names = spark.range(250).select(F.format_string("S%03d", "id").alias("symbol"))
    panel = names.crossJoin(days).withColumn("x", F.rand(3))
    store = Snapshots(spark, f"{shared_folder(spark)}/snap/{uuid.uuid4().hex}")
    with store.transaction() as t:
        t.rebuild(panel, "panel", Tiles.of(panel, 256))
    return store


def test_tiles_serve_symbols_and_dates(tiled):
    panel = tiled.read("panel")
    assert len(tiled.files("panel")) == 256
    history = panel.filter("symbol = 'S077'")
    day = panel.filter(F.col("trade_date") == F.lit(date(2020, 7, 9)))
    assert history.count() == 400 and day.count() == 250
    for df in (history, day):
        assert scanned_rows(df.select("symbol", "trade_date", "x")) <= 0.1 * 100_000


@pytest.mark.parametrize("files", [1, 3, 7])
def test_any_number_of_files_keeps_all_rows(spark, files):
    rows = [(f"S{k % 5}", date(2024, 1, 1 + k % 9), float(k)) for k in range(90)] + [(None, None, 0.0)]
    panel = spark.createDataFrame(rows, "symbol string, trade_date date, x double")
    tiles = Tiles.of(panel, files)
    assert sorted(map(repr, tiles.apply(panel).collect())) == sorted(map(repr, panel.collect()))
    assert Tiles.of(panel.limit(0), files).apply(panel.limit(0)).count() == 0


def test_dates_come_from_the_manifest(spark, tiled):
    days = tiled.dates("panel")
    assert days.count() == 400 and not days.inputFiles()
    assert "Scan parquet" not in days._jdf.queryExecution().toString()


def test_dates_after_changes(spark, store):
    rows = [("A", date(2024, 1, d), 1.0) for d in range(1, 6)] + [("B", date(2024, 1, 9), 1.0)]
    with store.transaction() as t:
        t.rebuild(spark.createDataFrame(rows, "symbol string, trade_date date, x double"), "t", ("symbol",), 2)
        t.append(spark.createDataFrame([("C", date(2024, 2, 1), None)], "symbol string, trade_date date, x double"), "t")
    with store.transaction() as t:
        t.delete("t", spark.createDataFrame([("A", date(2024, 1, 3))], "symbol string, trade_date date"))
    got = sorted(r[0] for r in store.dates("t").collect())
    assert got == [date(2024, 1, d) for d in (1, 2, 4, 5, 9)] + [date(2024, 2, 1)]


def test_vacuum_keeps_what_the_newest_version_reads(spark, store):
    with store.transaction() as t:
        t.rebuild(panel(spark), "t", ("symbol",), 4)
        t.rebuild(rows(spark, ("A", 1, 1.0)), "u")
    with store.transaction() as t:
        t.delete("t", rows(spark, ("B", 3, 0.0)).select("symbol", "trade_date"))
        t.rebuild(rows(spark, ("C", 1, 1.0)), "u")
    running = store.transaction()
    running.append(rows(spark, ("Z", 1, 1.0)), "u")
    want = content(store.read("t"))
    assert store.vacuum(keep=2) == 0
    gone = store.vacuum()
    assert gone >= 2 and store.vacuum() == 0
    assert store.version() == 2 and content(store.read("t")) == want and len(want) == 19
    assert content(store.read("u")) == [("C", 1, 1.0)]
    with pytest.raises(Exception):
        store.read("u", 1)
    running.commit()
    assert content(store.read("u")) == [("C", 1, 1.0), ("Z", 1, 1.0)]
