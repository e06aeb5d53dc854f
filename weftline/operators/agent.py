"""Plans of a question's steps: normalising, what is ready, sums over steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line, strip
from ..storage import new_path, written
from .models import TextModel, answers


def normalize_plan(steps: DataFrame, most: int = 12) -> DataFrame:
    """plan_id, position, id, question, depends_on: steps with a question and their own id (the first wins), at most `most` of a plan; dependencies on unknown steps or on themselves go.

    steps: plan_id, ord, id (null: its position), question, depends_on.
    """
    rows = steps.filter(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("id", F.coalesce("id", F.col("ord").cast("string")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("plan_id", "id").orderBy("ord"))).filter("_n = 1").drop("_n")
    cut = first.withColumn("position", F.row_number().over(Window.partitionBy("plan_id").orderBy("ord"))).filter(F.col("position") <= most)
    known = cut.withColumn("_ids", F.collect_set("id").over(Window.partitionBy("plan_id")))
    kept = F.filter(F.coalesce("depends_on", F.array().cast("array<string>")), lambda d: F.array_contains("_ids", d) & (d != F.col("id")))
    return known.select("plan_id", "position", "id", "question", F.array_distinct(kept).alias("depends_on"))


def with_llm_step(plan: DataFrame, question: str) -> DataFrame:
    """Each plan with an independent step `llm` at its end (`llm_1` where a step has that name)."""
    ends = plan.groupBy("plan_id").agg((F.max("position") + 1).alias("position"), F.max((F.col("id") == "llm").cast("int")).alias("_taken"))
    step = ends.select("plan_id", "position", F.when(F.col("_taken") == 1, "llm_1").otherwise("llm").alias("id"), F.lit(question).alias("question"), F.array().cast("array<string>").alias("depends_on"))
    return plan.withColumn("kind", F.lit("retrieve")).unionByName(step.withColumn("kind", F.lit("llm")))


def ready_steps(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The steps that aren't done and whose dependencies all are. done: plan_id, id."""
    ended = done.select("plan_id", "id").distinct()
    waiting = plan.join(ended, ["plan_id", "id"], "left_anti")
    needs = waiting.select("plan_id", "id", F.explode("depends_on").alias("need"))
    unmet = needs.join(ended.select("plan_id", F.col("id").alias("need")), ["plan_id", "need"], "left_anti").select("plan_id", "id").distinct()
    return waiting.join(unmet, ["plan_id", "id"], "left_anti")


def levels(plan: DataFrame) -> DataFrame:
    """plan_id, id, level: the round in which each step runs; steps of a cycle, and those that wait for them, are forced together after the last.

    A plan is one small group: normalize_plan() bounds its steps.
    """

    def run(steps: pd.DataFrame) -> pd.DataFrame:
        waiting, level, out = dict(zip(steps["id"], map(set, steps["depends_on"]))), 0, []
        while waiting:
            level += 1
            ready = [i for i, needs in waiting.items() if not needs & waiting.keys()] or list(waiting)
            out += [(i, level) for i in ready]
            for i in ready:
                del waiting[i]
        return pd.DataFrame(out, columns=["id", "level"]).assign(plan_id=steps["plan_id"].iloc[0])[["plan_id", "id", "level"]]

    return plan.select("plan_id", "id", "depends_on").groupBy("plan_id").applyInPandas(run, f"plan_id {plan.schema['plan_id'].dataType.simpleString()}, id string, level int")


def usage_sums(steps: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums that pass over nulls and are null only where all values are."""
    return steps.groupBy(*keys).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in columns])


def distinct_sources(rows: DataFrame, keys: list[str], source: str, order: str) -> DataFrame:
    """keys, source, place: the different sources in the order in which they first appear."""
    first = rows.filter(F.col(source).isNotNull()).groupBy(*keys, source).agg(F.min(order).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", source))).drop("_first")


# running plans


#: How earlier results stand in a prompt, and what stands for nothing.
PRIOR, STEP, NO_PRIOR, NO_ANSWER, NO_STEPS, NO_LLM = "[步骤 {}] 问：{}\n答：{}", "### 步骤 {}\n问：{}\n答：{}\n来源：{}", "（无）", "（无结论）", "（无检索子步骤结论）", "（无纯 LLM 回答）"


def _said(template: str, *columns: Column) -> Column:
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for c, p in zip(columns, parts[1:]) for x in (F.coalesce(c.cast("string"), F.lit("")), F.lit(p))])


def _blocks(rows: DataFrame, by: list[str], order: str, text: Column, empty: str, name: str) -> DataFrame:
    """Each group's texts in order, with a blank line between; groups are a plan's steps, so few."""
    found = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, text.alias("text")))).alias("_parts"))
    return found.select(*by, F.coalesce(F.nullif(F.array_join(F.transform("_parts", lambda p: p["text"]), "\n\n"), F.lit("")), F.lit(empty)).alias(name))


def run_plans(plans: DataFrame, queries: DataFrame, answer: TextModel, resolve: TextModel, direct: TextModel | None = None, resolve_prompt: str = "{query}\n{prior_results}\n{step_question}", direct_prompt: str = "{question}") -> DataFrame:
    """plan_id, id, kind, round, question (as resolved), answer, status, prior of every step of every plan.

    plans: as normalize_plan() and with_llm_step() leave them; queries: plan_id, query. All plans go on together, a round at
    a time: in a round every step runs whose dependencies have run, and steps that wait for each other are forced in one last
    round. A step that depends on others asks `resolve` for its question, with their questions and answers in the prompt, and
    takes the first line; where that fails, what is known is put behind the question as planned. A step of kind llm asks
    `direct` the whole query. A plan's steps are bounded, so are the rounds; each is written before the next.
    """
    spark = plans.sparkSession
    kind = F.col("kind") if "kind" in plans.columns else F.lit("retrieve")
    steps = plans.withColumn("kind", kind).join(levels(plans).withColumnRenamed("level", "round"), ["plan_id", "id"]).join(queries.select("plan_id", "query"), "plan_id", "left")
    steps, path = written(steps, "steps"), new_path(spark, "results")
    shapes = steps.groupBy("round").agg(F.max(F.col("kind") == "retrieve").alias("own"), F.max(F.col("kind") != "retrieve").alias("direct"), F.max(F.size("depends_on") > 0).alias("waits")).orderBy("round").collect()
    schema = f"plan_id {plans.schema['plan_id'].dataType.simpleString()}, id string, kind string, round int, question string, answer string, status int, prior string"
    for shape in shapes:  # a row for each round
        n, due = shape["round"], steps.filter(F.col("round") == shape["round"])
        needs = due.filter(F.size("depends_on") > 0).select("plan_id", "id", F.posexplode("depends_on").alias("_at", "need"))
        if n == 1:
            rows = due.withColumn("prior", F.when(F.size("depends_on") > 0, F.lit(NO_PRIOR)))
        else:
            done = spark.read.schema(schema).parquet(path)
            had = needs.join(done.select("plan_id", F.col("id").alias("need"), F.col("question").alias("_q"), F.col("answer").alias("_a")), ["plan_id", "need"])
            prior = _blocks(had, ["plan_id", "id"], "_at", _said(PRIOR, F.col("need"), strip("_q"), strip(F.coalesce("_a", F.lit("")))), NO_PRIOR, "prior")
            rows = due.join(prior, ["plan_id", "id"], "left").withColumn("prior", F.when(F.size("depends_on") > 0, F.coalesce("prior", F.lit(NO_PRIOR))))
        planned = strip("question")
        asked = F.lit(resolve_prompt)
        for field, value in (("query", F.coalesce("query", F.lit(""))), ("prior_results", F.col("prior")), ("step_question", planned)):
            asked = F.replace(asked, F.lit("{" + field + "}"), value)
        own, rows = F.col("kind") == "retrieve", rows.withColumn("prompt", asked)
        known = F.concat(planned, F.lit("\n（已知："), F.substring("prior", 1, 500), F.lit("）"))
        if shape["waits"]:
            rows = written(rows, "round")
            resolved = answers(rows.filter(own & F.col("prior").isNotNull()), resolve).select("plan_id", "id", F.when(F.col("status") == 1, F.nullif(first_line("answer"), F.lit(""))).alias("_resolved"))
            rows = rows.join(resolved, ["plan_id", "id"], "left")
        else:
            rows = rows.withColumn("_resolved", F.lit(None).cast("string"))
        rows = rows.withColumn("question", F.when(~own, F.coalesce("query", F.lit(""))).when(F.col("prior").isNull(), planned).otherwise(F.coalesce("_resolved", known)))
        prompt = F.when(own, F.col("question")).otherwise(F.replace(F.lit(direct_prompt), F.lit("{question}"), F.col("question")))
        rows = written(rows.withColumn("prompt", prompt), "round")
        asking = [answers(rows.filter(of), model) for of, model, any_ in ((own, answer, shape["own"]), (~own, direct or answer, shape["direct"])) if any_]
        out = asking[0] if len(asking) == 1 else asking[0].unionByName(asking[1])
        out.select("plan_id", "id", "kind", F.lit(n).alias("round"), "question", F.when(F.col("status") == 1, F.col("answer")).alias("answer"), "status", "prior").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if shapes else spark.createDataFrame([], schema)


def synthesis_prompts(plans: DataFrame, results: DataFrame, queries: DataFrame, template: str = "{query}\n{step_results}\n{llm_answer}") -> DataFrame:
    """plan_id, prompt: each plan's query, its retrieval steps' questions and answers in the plan's order, and the answer of its llm step.

    results: of run_plans(), with `sources` (array<string>) where there are any.
    """
    rows = results if "sources" in results.columns else results.withColumn("sources", F.array().cast("array<string>"))
    placed = rows.join(plans.select("plan_id", "id", "position"), ["plan_id", "id"])
    text = lambda empty: F.coalesce(F.nullif(strip(F.coalesce("answer", F.lit(""))), F.lit("")), F.lit(empty))
    sources = F.coalesce(F.nullif(F.array_join("sources", " / "), F.lit("")), F.lit(NO_PRIOR))
    blocks = _blocks(placed.filter("kind = 'retrieve'"), ["plan_id"], "position", _said(STEP, F.col("id"), strip("question"), text(NO_ANSWER), sources), NO_STEPS, "_steps")
    llm = placed.filter("kind = 'llm'").groupBy("plan_id").agg(F.min_by(text("（纯 LLM 无结论）"), "position").alias("_llm"))
    out = queries.select("plan_id", "query").join(blocks, "plan_id", "left").join(llm, "plan_id", "left")
    prompt = F.lit(template)
    for field, value in (("query", F.coalesce("query", F.lit(""))), ("step_results", F.coalesce("_steps", F.lit(NO_STEPS))), ("llm_answer", F.coalesce("_llm", F.lit(NO_LLM)))):
        prompt = F.replace(prompt, F.lit("{" + field + "}"), value)
    return out.select("plan_id", prompt.alias("prompt"))
