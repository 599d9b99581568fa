"""Market-data views derived from the driver's tables.

Prices come from lineitem (one symbol per supplier, one bar per supplier and
ship date) in integer paise, so both engines get identical bars; dimensions
come from supplier, nation and region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquet import config
from barquet.schemas import MARKET_STATES

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(x: Column, y: int) -> Column:
    """Integer division truncating towards zero."""
    return F.call_function("div", x, F.lit(y)).cast("bigint")


def _session_date(i: Column) -> Column:
    """i-th weekday counted from Monday 2020-01-06."""
    return F.date_add(
        F.lit("2020-01-06").cast("date"), (_div(i, 5) * 7 + F.pmod(i, F.lit(5))).cast("int")
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("src_date"))
        .agg(
            F.sum(F.round(C("l_discount") * 100).cast("bigint") - 5).alias("di"),
            F.sum(F.round(C("l_tax") * 100).cast("bigint")).alias("ti"),
            F.sum("l_quantity").cast("bigint").alias("q"),
            F.count("*").alias("n"),
        )
    )
    w = Window.partitionBy("l_suppkey").orderBy("src_date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    walk = daily.withColumns(
        {"i": F.row_number().over(w) - 1, "cum": F.sum("di").over(upto)}
    ).withColumn(
        "cp",
        F.round(10000 * F.exp(0.006 * C("cum") + 0.0015 * (C("i") + 1))).cast("bigint"),
    )
    walk = walk.withColumn("pp", F.coalesce(F.lag("cp").over(w), F.lit(10000)))
    walk = walk.withColumn("op", C("pp") + _div(C("pp") * (C("ti") - 4 * C("n")), 1000))
    top, low = F.greatest("op", "cp"), F.least("op", "cp")
    rupees = lambda c: (c / F.lit(100.0)).cast("double")
    return walk.select(
        F.concat(F.lit("S"), C("l_suppkey").cast("string"), F.lit(".NS")).alias("symbol"),
        _session_date(C("i")).alias("trade_date"),
        C("src_date"), C("i").cast("int").alias("i"), C("di"),
        rupees(C("op")).alias("open_price"),
        rupees(top + _div(top * (1 + C("ti")), 2000)).alias("high_price"),
        rupees(low - _div(low * (1 + C("ti")), 2000)).alias("low_price"),
        rupees(C("cp")).alias("close_price"),
        (C("q") * 40000).alias("volume"),
    )


def index_bars(raw: DataFrame) -> DataFrame:
    """Index series over all symbols; one row per session, so its window is tiny."""
    daily = raw.groupBy("trade_date", "i").agg(
        (F.sum("di") / F.count("*")).alias("mean_di"), F.sum("volume").alias("volume")
    ).withColumn("index_code", F.lit("NIFTY50"))
    upto = (
        Window.partitionBy("index_code").orderBy("trade_date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    level = F.exp(0.02 * F.sum("mean_di").over(upto) + 0.0004 * (C("i") + 1))
    return daily.select(
        "index_code", "trade_date",
        (F.round(1000000 * level) / 100.0).alias("close"), "volume",
    )


def volatility_index(raw: DataFrame) -> DataFrame:
    down = F.avg((C("close_price") < C("open_price")).cast("double"))
    return raw.groupBy("trade_date").agg((10 + 30 * down).alias("close"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), C("s_nationkey") == C("n_nationkey"))
        .join(table(spark, sf_dir, "region"), C("n_regionkey") == C("r_regionkey"))
        .select(
            F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
            F.when(k % 29 != 28, C("s_name")).alias("company_name"),
            F.when(k % 23 != 22, C("r_name")).alias("sector"),
            F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0")).alias("isin"),
            (k % 20 != 19).alias("is_active"),
            F.date_add(F.lit("2020-01-06").cast("date"), (k % 30).cast("int")).alias("first_seen"),
            F.date_add(F.lit("2022-01-03").cast("date"), (k % 30).cast("int")).alias("last_seen"),
        )
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.when(k % 3 == 0, "NIFTY50").when(k % 3 == 1, "NIFTY500")
        .otherwise("MIDCAP150").alias("index_code"),
        (k % 7 != 0).alias("is_current_member"),
        F.lit("2020-01-06").cast("date").alias("first_added_date"),
        F.when(k % 7 == 0, F.lit("2021-06-30").cast("date")).alias("last_removed_date"),
    )


def supplier_number(symbol: Column) -> Column:
    return F.regexp_extract(symbol, "S([0-9]+)", 1).cast("bigint")


def earnings(raw: DataFrame) -> DataFrame:
    k = supplier_number(C("symbol"))
    return raw.filter((C("i") % 63 == 62) & (k % 11 != 10)).select(
        "symbol", C("trade_date").alias("earnings_date"),
        F.date_add("trade_date", (k % 12).cast("int")).alias("fetched_at"),
    )


def fundamental_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped-looking (section, label, period, text) facts per symbol."""
    k = C("s_suppkey")
    s = lambda c: c.cast("string")
    cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def fact(section: str, label: str, period: int, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(label).alias("label"),
            F.lit(period).alias("period"), text.alias("raw_value"),
        )

    facts = [
        fact("top-ratios", "roe", 1, F.when(k % 7 == 3, "--").otherwise(
            cat(s(5 + (k * 7) % 30), ".", s(k % 10), "%"))),
        fact("top-ratios", "roce", 1, F.when(k % 9 == 4, "N/A").otherwise(
            cat(s(4 + (k * 11) % 28), "%"))),
        fact("top-ratios", "stock p/e", 1, cat(s(8 + (k * 3) % 50), ".5")),
        fact("top-ratios", "market cap", 1, F.when(
            k % 3 == 0, cat("₹", s(1 + k % 9), ",", F.lpad(s((k * 37) % 1000), 3, "0"), " Cr")
        ).otherwise(cat(s(100 + (k * 53) % 900), " Cr"))),
        fact("profit-loss", "opm %", 1, cat(s(3 + (k * 5) % 25), "%")),
        fact("profit-loss", "eps in rs", 1, cat(s(2 + k % 40), ".75")),
        fact("balance-sheet", "borrowings+", 1, s((k * 31) % 500)),
        fact("balance-sheet", "equity capital", 1, s(50 + k % 40)),
        fact("balance-sheet", "reserves", 1, F.when(k % 19 == 2, "-900").otherwise(
            s((k * 17) % 800))),
        fact("shareholding", "promoter_holding", 1, cat(
            s(30 + (k * 3) % 45), ".", F.lpad(s(k % 100), 2, "0"), "%")),
        fact("shareholding", "promoter_pledge_pct", 1, cat(s((k % 6) * 7), "%")),
    ]
    for p in range(1, 6):
        facts.append(fact("profit-loss", "sales+", p, F.when(
            (k % 17 == 5) & F.lit(p == 2), "-50"
        ).otherwise(s(1000 + (k % 50) * 10 + p * (k % 13) * 20))))
        facts.append(fact("profit-loss", "net profit+", p, F.when(
            (k % 31 == 6) & F.lit(p == 4), "-"
        ).otherwise(s(100 + p * (k % 11) * 3))))
    for q in range(1, 10):
        facts.append(fact("quarters", "eps in rs", q, F.when(
            (k % 37 == 9) & F.lit(q >= 3), "n.m."
        ).otherwise(cat(s(F.lit(q * q) * (1 + k % 5) + (k * q) % 7), ".25"))))
    return (
        table(spark, sf_dir, "supplier").filter(k % 4 != 0)
        .select(
            F.concat(F.lit("S"), s(k)).alias("symbol"), F.explode(F.array(*facts)).alias("f")
        )
        .select("symbol", "f.*")
    )


def market_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(config.MARKET_STATES), MARKET_STATES)


def index_reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, n, True) for c, n in config.INDEX_LIST],
        "index_code string, index_name string, is_active boolean",
    )


def dirty_bars(raw: DataFrame) -> DataFrame:
    """Bars with planted defects: copies, gaps, broken candles, stale runs, spikes."""
    i = C("i")
    stale = (i % 120).between(30, 33)
    flat = lambda c: F.when(stale, 100.0).otherwise(c)
    rows = raw.select(
        "symbol", "trade_date", "i",
        flat(C("open_price")).alias("open_price"),
        flat(
            F.when(i % 83 == 11, C("low_price") - 1)
            .when(i % 107 == 17, C("open_price") * 6).otherwise(C("high_price"))
        ).alias("high_price"),
        flat(C("low_price")).alias("low_price"),
        flat(
            F.when(i % 89 == 7, F.lit(None).cast("double"))
            .when(i % 107 == 17, C("open_price") * 6).otherwise(C("close_price"))
        ).alias("close_price"),
        F.when(stale, 0).when(i % 101 == 13, C("volume") * 200)
        .otherwise(C("volume")).cast("bigint").alias("volume"),
    )
    return rows.unionByName(rows.filter(i % 97 == 5)).drop("i")
