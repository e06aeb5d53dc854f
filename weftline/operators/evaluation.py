"""Evaluation: recall, verdict summaries, comparisons of two systems, categories, stage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_filename
from ..functions.values import PARTLY, RIGHT, UNKNOWN, WRONG, safe_div
from ..storage import written


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def doc_recall(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """id, n_expected, n_hit, n_miss, recall by normalised file names. expected, retrieved: id, name; ids without an expected doc have a null recall."""
    e = expected.select("id", normalize_filename("name").alias("name")).distinct()
    r = retrieved.select("id", normalize_filename("name").alias("name"), F.lit(1).alias("hit")).distinct()
    counts = e.join(r, ["id", "name"], "left").groupBy("id").agg(F.count("name").alias("n_expected"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_hit"))
    return counts.select("id", "n_expected", "n_hit", (F.col("n_expected") - F.col("n_hit")).alias("n_miss"), safe_div(F.col("n_hit").cast("double"), F.col("n_expected")).alias("recall"))


def recall_bucket(recall: Column) -> Column:
    return F.when(recall.isNull(), "unknown").when(recall >= 1, "hit").when(recall <= 0, "miss").otherwise("partial")


def verdict_summary(rows: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """n, n_right, n_wrong, n_unknown, accuracy (over judged rows) for each group."""
    v = F.col(verdict)
    out = rows.groupBy(*keys) if keys else rows.groupBy()
    out = out.agg(F.count("*").alias("n"), _n(v == RIGHT).alias("n_right"), _n(v == WRONG).alias("n_wrong"), _n(v.isNull() | ~v.isin(RIGHT, WRONG)).alias("n_unknown"))
    return out.withColumn("accuracy", safe_div(F.col("n_right").cast("double"), F.col("n_right") + F.col("n_wrong")))


def contingency(rows: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n with totals (`total`) of rows, columns and all."""
    return rows.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c")).select(
        F.when(F.col("_r") == 1, "total").otherwise(F.col(row)).alias(row), F.when(F.col("_c") == 1, "total").otherwise(F.col(column)).alias(column), "n"
    )


def system_comparison(pairs: DataFrame, a: str, b: str, name_a: str, name_b: str, judge: str | None = None) -> DataFrame:
    """n_pairs, wins and ties over the pairs with both verdicts: the judge's winner, else right beats wrong, else a tie."""
    both = pairs.filter(F.col(a).isin(RIGHT, WRONG) & F.col(b).isin(RIGHT, WRONG))
    by_verdict = F.when((F.col(a) == RIGHT) & (F.col(b) == WRONG), name_a).when((F.col(a) == WRONG) & (F.col(b) == RIGHT), name_b).otherwise("tie")
    winner = by_verdict if judge is None else F.coalesce(judge, by_verdict)
    out = both.select(winner.alias("w")).groupBy().agg(F.count("*").alias("n_pairs"), _n(F.col("w") == name_a).alias(f"{name_a}_wins"), _n(F.col("w") == name_b).alias(f"{name_b}_wins"), _n(F.col("w") == "tie").alias("ties"))
    return out.withColumn(f"{name_a}_win_rate", safe_div(F.col(f"{name_a}_wins").cast("double"), F.col("n_pairs")))


def crosstab(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: verdicts of two systems against each other, unknown ones named so."""
    return pairs.groupBy(F.coalesce(a, F.lit(UNKNOWN)).alias(a), F.coalesce(b, F.lit(UNKNOWN)).alias(b)).agg(F.count("*").alias("n"))


def group_metrics(rows: DataFrame, keys: list[str], score: str = "score", verdict: str = "verdict") -> DataFrame:
    """Counts of verdicts, accuracy, lenient accuracy, mean score and mean / 3 for each group."""
    v = F.col(verdict)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), _n(v == RIGHT).alias("n_right"), _n(v == PARTLY).alias("n_partly"), _n(v == WRONG).alias("n_wrong"), F.avg(score).alias("score_mean")
    )
    judged = F.col("n_right") + F.col("n_partly") + F.col("n_wrong")
    return out.withColumns({"accuracy": safe_div(F.col("n_right").cast("double"), judged), "lenient_accuracy": safe_div((F.col("n_right") + F.col("n_partly")).cast("double"), judged), "score_share": F.col("score_mean") / 3})


def score_histogram(rows: DataFrame, score: str = "score", top: int = 3) -> DataFrame:
    """score, n for 0 to top, zeros included."""
    every = rows.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("score"))
    counts = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("int").alias("_s")).agg(F.count("*").alias("n"))
    return every.join(counts, F.col("score") == F.col("_s"), "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, label, n, ratio of the values of each field; blanks are NA. One pass, whatever the number of fields."""
    label = lambda f: F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("NA"))
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), label(f).alias("label")) for f in fields])))
    counts = long.groupBy("field", "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "field").select("field", "label", "n", (F.col("n") / F.col("_t")).alias("ratio"))


def coverage(groups: DataFrame, declared: DataFrame) -> DataFrame:
    """Groups (label, n) with what was declared of them: declared, coverage (null where nothing or 0 was)."""
    d = declared.select(F.col("label").alias("_l"), F.col("declared"))
    return groups.join(d, F.col("label") == F.col("_l"), "left").select("label", "n", "declared", safe_div(F.col("n").cast("double"), F.col("declared")).alias("coverage"))


def compare_categories(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, a, b, delta of two systems' values by category; a category that only one has stays."""
    left, right = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return left.join(right, keys, "full").select(*keys, "a", "b", (F.col("a") - F.col("b")).alias("delta"))


def stage_metrics(calls: DataFrame) -> DataFrame:
    """stage, n_real, n_cached, n_skipped, seconds and tokens (of real calls only). calls: stage, kind, seconds, tokens."""
    real = F.col("kind") == "real"
    return calls.groupBy("stage").agg(
        _n(real).alias("n_real"), _n(F.col("kind") == "cached").alias("n_cached"), _n(F.col("kind") == "skipped").alias("n_skipped"),
        F.coalesce(F.sum(F.when(real, F.col("seconds"))), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum(F.when(real, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"),
    )


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of a hash of their key: reproducible, without replacement. n is the feature."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def sample_for_tasks(tasks: DataFrame, rows: DataFrame, key: str, seed: int) -> DataFrame:
    """tasks' columns, place, key: for each task `n` rows in the order of a hash of seed, task and key; where there are fewer rows, they are taken again in turn.

    tasks: task (text), n. They are few, and held against all rows in one pass; a task keeps as many rows of each as any asks
    for before they are shuffled.
    """
    most = tasks.agg(F.max("n")).first()[0] or 0
    ranked = Window.partitionBy("task").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "task", F.col(key).cast("string"))), key)
    picked = rows.select(key).crossJoin(F.broadcast(tasks.select("task", "n"))).withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= most).filter("_rank <= n")
    picked = written(picked, "sample")
    held = picked.groupBy("task").agg(F.count("*").alias("_held"))
    places = tasks.join(held, "task").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    places = places.withColumn("_rank", (F.col("place") - 1) % F.col("_held") + 1)
    return places.join(picked.select("task", "_rank", key), ["task", "_rank"]).drop("_rank", "_held")


def question_tasks(spark, hop_counts: dict[int, int]) -> DataFrame:
    """task, hop, number, n: so many questions of each number of hops, each of which needs as many documents as hops."""
    rows = spark.createDataFrame([(h, c) for h, c in hop_counts.items() if c > 0], "hop int, count int")
    each = rows.select("hop", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("number"))
    return each.select(F.concat_ws("/", "hop", "number").alias("task"), "hop", "number", F.col("hop").alias("n"))
