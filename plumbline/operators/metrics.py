"""Evaluation: classification reports, thresholds and ROUGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import rouge_tokens

RANGES = 1024


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """gold, pred, n for all label pairs, zeros included."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "gold string, pred string")
    return grid.join(rows.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")), ["gold", "pred"], "left").na.fill(0, ["n"])


def class_report(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label, from one pass."""
    sums = rows.agg(*[F.count(F.when(c, 1)).alias(f"{k}{i}") for i, x in enumerate(labels) for k, c in (("t", (F.col("gold") == x) & (F.col("pred") == x)), ("p", F.col("pred") == x), ("g", F.col("gold") == x))])
    listed = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"t{i}").alias("t"), F.col(f"p{i}").alias("p"), F.col(f"g{i}").alias("support")) for i, x in enumerate(labels)])).alias("x")
    d = sums.select(listed).select("x.*").withColumn("precision", ratio(F.col("t"), F.col("p"))).withColumn("recall", ratio(F.col("t"), F.col("support")))
    return d.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("t", "p")


def class_weights(rows: DataFrame, labels: list[str]) -> DataFrame:
    """total / (labels * count), counting at least one."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(x,) for x in labels], "label string")
    counts = grid.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").na.fill(0, ["n"])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("total") / (len(labels) * F.greatest("n", F.lit(1)))).alias("weight"))  # one row


def triage_metrics(counts: DataFrame) -> DataFrame:
    """Adds the rates to (n, true_total, false_total, pred_true, pred_false, tp_true, tp_false)."""
    c = F.col
    d = counts.withColumn("undecided", c("n") - c("pred_true") - c("pred_false"))
    d = d.withColumn("false_precision", ratio(c("tp_false"), c("pred_false"))).withColumn("false_recall", ratio(c("tp_false"), c("false_total")))
    d = d.withColumn("true_precision", ratio(c("tp_true"), c("pred_true"))).withColumn("true_recall", ratio(c("tp_true"), c("true_total")))
    d = d.withColumn("macro_f1", (f1(c("false_precision"), c("false_recall")) + f1(c("true_precision"), c("true_recall"))) / 2)
    decided = c("pred_true") + c("pred_false")
    return d.withColumn("coverage", ratio(decided, c("n"))).withColumn("decided_accuracy", ratio(c("tp_true") + c("tp_false"), decided))


def evaluate_triage(rows: DataFrame, low: float, high: float) -> DataFrame:
    """rows (gold, risk): true at or below low, false at or above high."""
    g, r = F.col("gold"), F.col("risk")
    t, f = r <= low, (r > low) & (r >= high)
    n = lambda c: F.count(F.when(c, 1))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), n(g == "true").alias("true_total"), n(g == "false").alias("false_total"), n(t).alias("pred_true"), n(f).alias("pred_false"), n(t & (g == "true")).alias("tp_true"), n(f & (g == "false")).alias("tp_false"))
    return triage_metrics(counts)


def _cumulative(rows: DataFrame, score: str, places: int | None) -> DataFrame:
    """Per candidate threshold (0, 1 and the rounded scores): rows at or below and below it, by gold. Raw scores decide."""
    spark = rows.sparkSession
    cut = F.round(score, places) if places else F.col(score)
    steps = rows.select(cut.alias("x"), F.col(score).alias("s"), "gold")
    found = steps.select("x").union(spark.createDataFrame([(0.0,), (1.0,)], "x double")).distinct()
    # scores are compared as they are, so a candidate that rounding moved off its score takes its own place in the order
    marks = found.select(F.col("x").alias("s"), F.lit(1).alias("mark"), F.lit(0).alias("t"), F.lit(0).alias("f"))
    sums = rows.groupBy(F.col(score).alias("s")).agg(F.count(F.when(F.col("gold") == "true", 1)).alias("t"), F.count(F.when(F.col("gold") == "false", 1)).alias("f")).withColumn("mark", F.lit(0))
    # one row for each distinct score; running sums go by range of scores, so that no task has them all
    per = marks.unionByName(sums).groupBy("s").agg(F.max("mark").alias("mark"), F.sum("t").alias("t"), F.sum("f").alias("f"))
    per = per.withColumn("k", F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("s") * RANGES))))
    d = running_sums(per, "k", ["s"], ["t", "f"])
    return d.where("mark = 1").select("s", "t_le", "f_le", (F.col("t_le") - F.col("t")).alias("t_lt"), (F.col("f_le") - F.col("f")).alias("f_lt"))


def running_sums(rows: DataFrame, bucket: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with the running sum (name_le) of each value in the order of (bucket, order): sums of whole buckets first, then inside each."""
    totals = rows.groupBy(bucket).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = totals.select(bucket, *[F.coalesce(F.sum(f"_{v}").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{v}") for v in values])  # one row a bucket
    w = W.partitionBy(bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = rows.select("*", *[F.sum(v).over(w).alias(f"{v}_in") for v in values]).join(before, bucket)
    return inner.select(*rows.columns, *[(F.col(f"{v}_in") + F.col(f"_{v}")).alias(f"{v}_le") for v in values])


def fit_thresholds(rows: DataFrame, least_false: float = 0.90, least_true: float = 0.80) -> DataFrame:
    """The best (low, high) with enough precision on both sides: by coverage, macro F1, decided accuracy and summed precision; equals by the smaller low, then high.

    Counts are running sums over distinct scores rounded to six places (at most a million and one). For a given low, the smallest
    high above it that is precise enough covers most, and wider ones that cover as much decide alike, so each low is tried with that one."""
    d = _cumulative(rows, "risk", 6)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gold") == "true", 1)).alias("true_total"), F.count(F.when(F.col("gold") == "false", 1)).alias("false_total"))
    d = d.join(F.broadcast(total))  # one row
    d = d.withColumn("pf", F.col("n") - F.col("t_lt") - F.col("f_lt")).withColumn("tf", F.col("false_total") - F.col("f_lt"))
    fine = (F.col("pf") > 0) & (F.col("tf") >= least_false * F.col("pf"))
    high = F.min(F.when(fine, F.struct(F.col("s").alias("high"), F.col("pf").alias("pred_false"), F.col("tf").alias("tp_false")))).over(W.orderBy("s").rowsBetween(1, W.unboundedFollowing))
    d = d.withColumn("h", high).where("h is not null and t_le + f_le > 0")
    pairs = d.select(F.col("s").alias("low"), "h.*", (F.col("t_le") + F.col("f_le")).alias("pred_true"), F.col("t_le").alias("tp_true"), "n", "true_total", "false_total")
    m = triage_metrics(pairs).where((F.col("false_precision") >= least_false) & (F.col("true_precision") >= least_true))
    return m.orderBy(*_best_first()).limit(1)


def _best_first() -> list[Column]:
    return [F.desc(F.round("coverage", 12)), F.desc(F.round("macro_f1", 12)), F.desc(F.round("decided_accuracy", 12)), F.desc(F.round(F.col("false_precision") + F.col("true_precision"), 12)), F.asc("low"), F.asc("high")]


def threshold_candidates(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k best (low, high) of all, without constraints: a wider gap above a low never covers more, so each low is tried with the next k highs."""
    d = _cumulative(rows, "risk", 6)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gold") == "true", 1)).alias("true_total"), F.count(F.when(F.col("gold") == "false", 1)).alias("false_total"))
    d = d.join(F.broadcast(total))  # one row
    high = F.struct(F.col("s").alias("high"), (F.col("n") - F.col("t_lt") - F.col("f_lt")).alias("pred_false"), (F.col("false_total") - F.col("f_lt")).alias("tp_false"))
    # one row for each distinct score of six places, at most a million and one
    d = d.withColumn("highs", F.collect_list(high).over(W.orderBy("s").rowsBetween(1, max(k, 1)))).withColumn("h", F.explode("highs"))
    pairs = d.select(F.col("s").alias("low"), "h.*", (F.col("t_le") + F.col("f_le")).alias("pred_true"), F.col("t_le").alias("tp_true"), "n", "true_total", "false_total")
    return triage_metrics(pairs).orderBy(*_best_first()).limit(max(k, 1))


def best_f1_threshold(rows: DataFrame, score: str = "risk") -> DataFrame:
    """rows (gold true or false, score of being true): threshold of best macro F1, closest to one half among equals."""
    half = rows.sparkSession.createDataFrame([(0.5, None)], f"{score} double, gold string")
    d = _cumulative(rows.select(score, "gold").unionByName(half.select(score, "gold")), score, None)
    total = rows.agg(F.count(F.when(F.col("gold") == "true", 1)).alias("p"), F.count(F.when(F.col("gold") == "false", 1)).alias("q"))
    x = d.join(F.broadcast(total)).withColumn("tp", F.col("p") - F.col("t_lt")).withColumn("fp", F.col("q") - F.col("f_lt"))  # one row
    true_f1, false_f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("t_lt")), ratio(2 * F.col("f_lt"), 2 * F.col("f_lt") + F.col("t_lt") + F.col("fp"))
    return x.select(F.col("s").alias("threshold"), ((true_f1 + false_f1) / 2).alias("macro_f1")).orderBy(F.desc(F.round("macro_f1", 12)), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    return F.when(size < n, F.expr("array()").cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """pairs (id, candidate, reference) with precision, recall and F1 of shared n-grams, counted with repeats, by one shuffle on id and gram."""
    # tokens are a column first: an expression inside a lambda would be evaluated again for each gram
    d = pairs.select("id", rouge_tokens(F.col("candidate")).alias("c"), rouge_tokens(F.col("reference")).alias("r"))
    d = d.select("id", ngrams(F.col("c"), n).alias("c"), ngrams(F.col("r"), n).alias("r"))
    both = d.select("id", F.explode(F.concat(F.transform("c", lambda g: F.struct(g.alias("g"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform("r", lambda g: F.struct(g.alias("g"), F.lit(0).alias("x"), F.lit(1).alias("y"))))).alias("e")).select("id", "e.*")
    per = both.groupBy("id", "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).groupBy("id").agg(F.sum(F.least("x", "y")).alias("o"), F.sum("x").alias("nc"), F.sum("y").alias("nr"))
    all_ = pairs.select("id").join(per, "id", "left").na.fill(0)
    p, r = ratio(F.col("o"), F.col("nc")), ratio(F.col("o"), F.col("nr"))
    return all_.select("id", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def lcs_f1(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence of two token lists: rows of the dynamic program are the bits of one number, so a step of it is a few machine words."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    at: dict[str, int] = dict.fromkeys(short, 0)
    for i, w in enumerate(long):
        if w in at:
            at[w] |= 1 << i
    row = full = (1 << len(long)) - 1
    for w in short:
        hit = row & at[w]
        row = (row + hit) | (row - hit)
    n = len(long) - (row & full).bit_count()
    return 2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)) if n else 0.0


def rouge_l(pairs: DataFrame) -> DataFrame:
    """F1 of the longest common subsequence of the whole texts, over Arrow batches."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [lcs_f1(a, b) for a, b in zip(batch.column("c").to_pylist(), batch.column("r").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], ["id", "f1"])

    d = pairs.select("id", rouge_tokens(F.col("candidate")).alias("c"), rouge_tokens(F.col("reference")).alias("r"))
    return d.mapInArrow(run, "id long, f1 double")
