"""Report tables: failures, details, long tables of metrics, pairwise winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_list, strip
from ..functions.values import PARTLY, RIGHT, WRONG, higher, safe_div


def failed(error: Column | str, status: Column | str, judge_status: Column | str, question: Column | str) -> Column:
    """Did the pipeline fail on a row? An error, a status of 0 of query or judge, or an empty question."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (F.coalesce(strip(c(error)), F.lit("")) != "") | F.coalesce(c(status) == 0, F.lit(False)) | F.coalesce(c(judge_status) == 0, F.lit(False)) | (F.coalesce(strip(c(question)), F.lit("")) == "")


def remaining(questions: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The questions that a resumed evaluation has still to run."""
    return questions.join(done.select(F.col(key).alias("_done")).distinct(), questions[key] == F.col("_done"), "left_anti")


def long_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, n, mean, total: one row per metric, nulls passed over."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total"))


def metric_table(rows: DataFrame, system: str, a: str, b: str, metrics: dict[str, Column]) -> DataFrame:
    """metric, a, b, delta: each metric of two systems beside each other."""
    per = rows.groupBy(system).agg(*[m.alias(name) for name, m in metrics.items()])
    long = per.select(system, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    side = lambda s: F.max(F.when(F.col(system) == s, F.col("value")))
    return long.groupBy("metric").agg(side(a).alias("a"), side(b).alias("b")).withColumn("delta", F.col("a") - F.col("b"))


def dimension_counts(rows: DataFrame, column: str) -> DataFrame:
    """dimension, n: the parts of a list column, counted."""
    return rows.select(F.explode(split_list(column)).alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))


#: What names a winner when it is all that is said, and what says a tie anywhere.
TIES = ["tie", "equal", "same", "neither", "both", "平", "平局", "相同", "一样", "并列", "都不", "都好", "相当"]
TIES_WITHIN = ["平局", "相同", "一样", "并列", "相当"]
SIDES = {"A": "甲", "B": "乙"}


def stated_winner(answer: Column | str) -> Column:
    """A, B or tie, as a judge's free text says; null where it names neither side, or both."""
    s = strip(F.col(answer) if isinstance(answer, str) else answer)
    compact = F.regexp_replace(F.lower(s), r" |_|-|回答|answer", "")
    within = F.lit(False)
    for t in TIES_WITHIN:
        within = within | F.contains(s, F.lit(t))
    says = {x: s.rlike(rf"(?i)回答\s*{x}|(^|[^\p{{L}}\p{{N}}_]){x}([^\p{{L}}\p{{N}}_]|$)|{other}") for x, other in SIDES.items()}
    out = F.when(compact.isin(TIES), "tie").when(compact.isin("a", "甲"), "A").when(compact.isin("b", "乙"), "B").when(within, "tie")
    return out.when(says["A"] & ~says["B"], "A").when(says["B"] & ~says["A"], "B")


#: Names by which an answer may call a system.
SYSTEM_NAMES = {"hypergraph": ["hypergraph", "rag", "graph", "超图"], "llm_only": ["llmonly", "llm", "baseline", "纯llm"]}


def resolved_winner(answer: Column | str, swapped: Column, first: str = "hypergraph", second: str = "llm_only") -> Column:
    """The system that a judge's text names, by its side (A is the second where the two were swapped) or by its name; tie, or null."""
    s = strip(F.col(answer) if isinstance(answer, str) else answer)
    compact = F.regexp_replace(F.lower(s), r" |_", "")
    by_name = F.when(compact.isin(SYSTEM_NAMES["hypergraph"]), "hypergraph").when(compact.isin(SYSTEM_NAMES["llm_only"]), "llm_only")
    return F.coalesce(named_winner(stated_winner(s), swapped, first, second), by_name)


def named_winner(stated: Column, swapped: Column, first: str, second: str) -> Column:
    """The system that A or B stands for: A is the second system where the two were swapped."""
    return F.when(stated == "tie", "tie").when(((stated == "A") & ~swapped) | ((stated == "B") & swapped), first).when(stated.isNotNull(), second)


def pair_winner(judge: Column, score_a: Column, score_b: Column, name_a: str, name_b: str) -> Column:
    """The judge's winner, else the one with the higher score."""
    return F.coalesce(judge, higher(score_a, score_b, name_a, name_b))


def block_answer(block: Column) -> Column:
    """A system's answer, or else its raw answer; empty where it has neither."""
    return strip(F.coalesce(F.nullif(block["answer"], F.lit("")), block["raw_answer"], F.lit("")))


def attempted(block: Column) -> Column:
    """Has a system been asked? It has an answer, an error, a status of 1 or a latency."""
    said = (block_answer(block) != "") | (F.coalesce(block["query_error"], F.lit("")) != "") | F.coalesce(block["query_status"] == 1, F.lit(False))
    return block.isNotNull() & (said | block["query_latency_s"].isNotNull())


def system_failed(block: Column) -> Column:
    """Is a system's block missing, or did its query or its judge fail?"""
    said = lambda c: F.coalesce(block[c], F.lit("")) != ""
    zero = lambda c: F.coalesce(block[c] == 0, F.lit(False))
    return block.isNull() | said("query_error") | zero("query_status") | zero("judge_status") | said("judge_error")


def item_failed(question: Column, first: Column, second: Column | None = None) -> Column:
    """Did a question's evaluation fail: no question, or a system of the one or two asked?"""
    out = (F.coalesce(question, F.lit("")) == "") | system_failed(first)
    return out if second is None else out | system_failed(second)


BLOCK = ["answer", "raw_answer", "query_status", "query_error", "llm_acc", "score", "judge_reason", "judge_status", "judge_error", "query_latency_s"]


def system_rows(results: DataFrame, systems: list[str], keys: list[str], legacy: str | None = None) -> DataFrame:
    """keys, system and the fields of its block: a row for each result and system. Where `legacy`'s block is missing, columns of the result itself that are named like its fields stand in."""
    old = F.struct(*[(F.col(c) if c in results.columns else F.lit(None)).cast(results.schema[systems[0]].dataType[c].dataType).alias(c) for c in BLOCK])
    blocks = [F.struct(F.lit(s).alias("system"), (F.coalesce(F.col(s), old) if s == legacy else F.col(s)).alias("block")) for s in systems]
    return results.select(*keys, F.inline(F.array(*blocks))).select(*keys, "system", *[F.col(f"block.{c}").alias(c) for c in BLOCK])


def detail_rows(results: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """keys, both systems' verdicts, scores and answers beside each other, score_delta and same_verdict (null verdicts are equal)."""
    a, b = F.col(first), F.col(second)
    both = [x.alias(f"{s}_{n}") for s, c in ((first, a), (second, b)) for n, x in (("verdict", c["llm_acc"]), ("score", c["score"]), ("answer", block_answer(c)))]
    return results.select(*keys, *both, (a["score"] - b["score"]).alias("score_delta"), a["llm_acc"].eqNullSafe(b["llm_acc"]).alias("same_verdict"))


def judging_mode(first: Column, second: Column) -> Column:
    """How a result is judged: pair where both systems have an answer, else the one that has, else skip."""
    a, b = block_answer(first) != "", block_answer(second) != ""
    return F.when(a & b, "pair").when(a, "first").when(b, "second").otherwise("skip")


def summary_report(rows: DataFrame, fields: list[str], verdict: str = "llm_acc", score: str = "score") -> DataFrame:
    """system, field, label, n, n_failed, n_right, n_partly, n_wrong, accuracy, score_mean: each system over all (field and label `all`) and by each category, in one pass.

    rows: system_rows() with the category columns among its keys. A blank category is NA.
    """
    label = lambda f: F.coalesce(F.nullif(strip(F.col(f).cast("string")), F.lit("")), F.lit("NA"))
    groups = F.array(F.struct(F.lit("all").alias("field"), F.lit("all").alias("label")), *[F.struct(F.lit(f).alias("field"), label(f).alias("label")) for f in fields])
    lost = F.coalesce(F.nullif(F.col("query_error"), F.lit("")), F.nullif(F.col("judge_error"), F.lit(""))).isNotNull() | F.coalesce(F.col("query_status") == 0, F.lit(False)) | F.coalesce(F.col("judge_status") == 0, F.lit(False))
    long = rows.select("system", F.col(verdict).alias("_v"), F.col(score).cast("double").alias("_s"), lost.alias("_lost"), F.inline(groups))
    count = lambda c: F.count(F.when(c, 1))
    out = long.groupBy("system", "field", "label").agg(F.count("*").alias("n"), count(F.col("_lost")).alias("n_failed"), count(F.col("_v") == RIGHT).alias("n_right"), count(F.col("_v") == PARTLY).alias("n_partly"), count(F.col("_v") == WRONG).alias("n_wrong"), F.avg("_s").alias("score_mean"))
    return out.withColumn("accuracy", safe_div(F.col("n_right").cast("double"), F.col("n_right") + F.col("n_partly") + F.col("n_wrong")))
