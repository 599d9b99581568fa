"""Quality rules: text statistics, learned decision lists, verdicts as Spark expressions.

`statistics` measures every text with built-in functions. `learn` grows a decision
list from labelled statistics by sequential covering, `DecisionList.verdict` turns it
into one ordered conditional expression.

Learning works on counts, never on rows: each growing step is one aggregate of
labelled rows by (feature, bin), so the driver holds a few hundred numbers however
many rows are labelled. All labelled rows count.

1. Every feature gets up to `BINS` thresholds midway between neighbouring quantiles,
   with a few more in the tails.
2. A rule grows by the threshold test of the largest information gain on the growing
   rows (two of three) which no earlier rule covers.
3. It is cut back to the prefix with the best (p - n) / (p + n) on the pruning rows.
4. It joins the list if its precision on those is at least `PRECISION`; else the list
   ends. The default is to keep.

Defined cases: null or empty text has no words, so fails the base test; a label row
without document or with a null label is not used; repeated rows count again; without
any labelled rows of both kinds the list is empty. An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import BLANKS, checked_broadcast
from barquet.session import materialize

WINDOW = 5
BINS = 32
TAILS = (0.002, 0.005, 0.01, 0.02)
PRECISION = 0.9
MAX_RULES = 12
MAX_TESTS = 4
LEAST_ROWS = 3

SYMBOLS = "#*$%&|<>"
FEATURES = (
    "n_words", "mean_word", "symbol_share", "repeat_share", "dup_lines", "upper_share",
    "digit_share", "exclaim_share", "comma_share", "words_per_line",
)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns of every row, base counts and the learner's features."""
    text = docs.select(
        F.struct(*carry).alias("carried"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("trimmed", F.trim(F.col("text"), F.lit(BLANKS)))
    split = text.withColumn(
        "words", F.when(F.col("trimmed") != "", F.split("trimmed", r"[\x20\x09-\x0D]+"))
        .otherwise(F.array().cast("array<string>")),
    ).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    )
    hashed = split.select(
        "carried", "text",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # One hash for each run of WINDOW words.
    runs = hashed.withColumn(
        "runs",
        F.when(F.col("n_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
            lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))),
        )).otherwise(F.array().cast("array<bigint>")),
    ).drop("hashes")
    repeated = runs.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("runs")) < F.size("runs"),
               F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("runs")
    starts = repeated.withColumn(
        "starts",
        F.sort_array(F.transform(
            F.filter("sorted", lambda x, j: F.coalesce(x["h"] == F.get("sorted", j - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get("sorted", j + 1)["h"], F.lit(False))),
            lambda x: x["i"],
        )),
    ).drop("sorted")
    # A start covers its words up to the next start.
    covered = F.aggregate(
        F.transform("starts", lambda s, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - s, F.lit(WINDOW))
        )).cast("array<bigint>"),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    chars = F.length("text")
    counted = starts.select(
        "carried", "n_words", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        chars.cast("long").alias("n_chars"),
        (F.length(_without(F.col("text"), BLANKS))).cast("long").alias("word_chars"),
        (chars - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (chars - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_exclaim"),
        (chars - F.length(_without(F.col("text"), ","))).cast("long").alias("n_commas"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (chars - F.length(_without(F.col("text"), "0123456789"))).cast("long").alias("n_digits"),
    )
    w = F.greatest(F.col("n_words"), F.lit(1))
    c = F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        *(F.col("carried")[c].alias(c) for c in carry), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / w).alias("mean_word"),
        (F.col("n_symbols") / c).alias("symbol_share"),
        (F.col("n_repeat_words") / w).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_upper") / c).alias("upper_share"),
        (F.col("n_digits") / c).alias("digit_share"),
        (F.col("n_exclaim") / w).alias("exclaim_share"),
        (F.col("n_commas") / w).alias("comma_share"),
        (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """feature <= threshold, or feature > threshold."""

    feature: str
    below: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value <= self.threshold if self.below else value > self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.below else '>'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose tests all hold rejects, else the row is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def rule_number(self) -> Column:
        """1 for the first rule, and so on; null where none holds."""
        out = F.lit(None).cast("int")
        for n, rule in reversed([*enumerate(self.rules, 1)]):
            out = F.when(_all(rule), F.lit(n)).otherwise(out)
        return out

    def verdict(self) -> Column:
        return self.rule_number().isNull()

    def __str__(self) -> str:
        return "\n".join(f"{n}: reject if " + " and ".join(map(str, r))
                         for n, r in enumerate(self.rules, 1)) or "keep"


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    labelled: DataFrame,
    bad: str = "bad",
    features: tuple[str, ...] = FEATURES,
    bins: int = BINS,
    precision: float = PRECISION,
    max_rules: int = MAX_RULES,
    max_tests: int = MAX_TESTS,
) -> DecisionList:
    """A decision list for rows with `bad` true; `labelled` has doc_id, features, bad."""
    number = [F.col(f).cast("double").alias(f) for f in features]
    rows = materialize(
        labelled.filter(F.col(bad).isNotNull()).select(
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"),
            F.col(bad).cast("boolean").alias("bad"), *number,
        ), "labelled",
    )
    shares = sorted({k / bins for k in range(1, bins)} | {x for t in TAILS for x in (t, 1 - t)})
    found = rows.agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in features)).first()
    cuts = {}
    for f in features:
        values = sorted(set(found[f] or []))
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    levels = materialize(
        rows.select("*", F.array(*(
            sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)) for f in features
        )).alias("levels")), "levels",
    )
    count = [F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")]
    place = {f: k for k, f in enumerate(features)}

    def met(tests: list[Test]) -> Column:
        """The tests as one array value on the rows' levels: all plans of the search have one
        shape and share their generated code, whatever is tested."""
        return F.array(*(
            F.struct(F.lit(place[t.feature]).alias("f"), F.lit(t.below).alias("below"), F.lit(bisect_left(cuts[t.feature], t.threshold)).alias("cut"))
            for t in tests
        )).cast("array<struct<f:int,below:boolean,cut:int>>")

    def hold(tests: Column) -> Column:
        return F.forall(tests, lambda t: (F.get("levels", t["f"]) <= t["cut"]) == t["below"])

    def best(grow: DataFrame) -> tuple[float, Test | None, int, int]:
        got = grow.select("bad", F.posexplode("levels").alias("f", "level")).groupBy("f", "level").agg(*count)
        table = {(r["f"], r["level"]): (r["p"], r["n"]) for r in got.collect()}
        top = (0.0, None, 0, 0)
        for k, feature in enumerate(features):
            whole = [table.get((k, v), (0, 0)) for v in range(len(cuts[feature]) + 1)]
            p0, n0 = sum(x[0] for x in whole), sum(x[1] for x in whole)
            p = n = 0
            for v, threshold in enumerate(cuts[feature]):
                p, n = p + whole[v][0], n + whole[v][1]
                for below, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                    if a + b >= LEAST_ROWS and (g := _gain(a, b, p0, n0)) > top[0] + 1e-9:
                        top = (g, Test(feature, below, float(threshold)), a, b)
        return top

    rules: list[tuple[Test, ...]] = []
    while len(rules) < max_rules:
        known = F.array(*map(met, rules)).cast("array<array<struct<f:int,below:boolean,cut:int>>>")
        rest, tests = levels.filter(~F.exists(known, hold)), []
        while len(tests) < max_tests:
            _, test, p, n = best(rest.filter(F.col("grow") & hold(met(tests))))
            if test is None:
                break
            tests.append(test)
            if n == 0:
                break
        if not tests:
            break
        checked = rest.filter(~F.col("grow")).agg(*(
            F.sum(F.when(hold(met(tests[:k])) & (F.col("bad") == b), 1).otherwise(0)).alias(f"{name}{k}")
            for k in range(1, max_tests + 1) for name, b in (("p", True), ("n", False))
        )).first()
        worth = []
        for k in range(1, len(tests) + 1):
            p, n = checked[f"p{k}"] or 0, checked[f"n{k}"] or 0
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        _, k, p, n = max(worth)
        if p + n == 0 or p / (p + n) < precision:
            break
        rules.append(tuple(tests[:-k]))
    return DecisionList(tuple(rules))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """`stats` with base_failed, the rule that rejects (if any) and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "rule", rules.rule_number()
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def _marked(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").select(
        "doc_id", (F.col("quality") == 0).alias("bad")
    )


def apply(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Measure `docs`, learn from labelled ones that pass the base test (`quality` 0 is
    bad), judge all."""
    stats = materialize(statistics(docs), "statistics")
    open_rows = stats.filter(~base_failed()).join(_marked(labels), "doc_id")
    return judge(stats, learn(open_rows, **options))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, unchanged, that pass the base test and the learned rules.

    Labelled rows are measured first, to learn; then each row is judged by itself."""
    marked = materialize(_marked(labels), "marked")
    known = docs.select("doc_id", "text").join(checked_broadcast(marked), "doc_id").select("doc_id", "text", "bad")
    rules = learn(materialize(statistics(known, ("doc_id", "bad")), "statistics").filter(~base_failed()), **options)
    judged = judge(statistics(docs.select("text", F.struct(*docs.columns).alias("whole")), ("whole",)), rules)
    # The row number, never negative, keeps the optimizer from pushing the filter below the
    # measuring, where it would be repeated.
    numbered = judged.select("whole", "kept", F.monotonically_increasing_id().alias("row"))
    return numbered.filter("kept and row >= 0").select("whole.*")
