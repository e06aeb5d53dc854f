"""Slices of one source document: what stands before each, and stages that go through a family slice by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..storage import new_path, written
from .models import TextModel, answers

#: How an earlier slice stands in a prompt.
HEADING, PAGES = "【前文第 {} 段 / {}{}】\n", "，源页约 {}-{}"
_NAME = r"(?i)^(.+\.pdf)_([0-9]+)$"


def slice_meta(docs: DataFrame) -> DataFrame:
    """Adds source_name, slice_index, n_slices: what extra (JSON) says, else what a name like x.pdf_2 does.

    A name's number counts where extra has none, and n_slices is more than the index at least.
    """
    said = lambda k: F.get_json_object("extra", f"$.{k}")
    name, number = strip(F.coalesce("name", F.lit(""))), F.coalesce(F.regexp_extract(strip(F.coalesce("name", F.lit(""))), _NAME, 2).try_cast("int"), F.lit(0))
    stated, parts = F.coalesce(said("slice_index").try_cast("int"), F.lit(0)), F.coalesce(said("n_slices").try_cast("int"), F.lit(1))
    source = F.nullif(strip(F.coalesce(said("source_name"), F.lit(""))), F.lit(""))
    guess = source.isNull() | ((stated <= 0) & (parts <= 1))
    index = F.greatest(F.lit(0), F.when(guess & (stated <= 0) & (F.coalesce(said("slice_index"), F.lit("0")) == "0"), number).otherwise(stated))
    base = F.when(name.rlike(_NAME), F.regexp_extract(name, _NAME, 1)).otherwise(name)
    return docs.withColumns({"source_name": F.coalesce(source, base), "slice_index": index, "n_slices": F.greatest(F.lit(1), parts, index + 1)})


def _template(text: str, *values: Column) -> Column:
    parts = text.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:]) for x in (v.cast("string"), F.lit(p))])


def prior_text(docs: DataFrame) -> DataFrame:
    """Adds prior, n_prior: the contents of the slices before a document's own, in order, each under a heading, with a blank line between.

    docs: slice_meta() of documents (id, name, content, extra). A slice that is missing or empty is passed over; of documents with
    one name the least id counts. Slices know each other by their names: source, source_1, source_2 ... The prior text of
    slice i holds i others, so all of a family's are as long as its length times its number of slices.
    """
    page = lambda k: F.get_json_object("extra", f"$.{k}").try_cast("int")
    pages = F.when(page("page_start").isNotNull() & page("page_end").isNotNull(), _template(PAGES, page("page_start") + 1, page("page_end"))).otherwise("")
    text = strip(F.coalesce("content", F.lit("")))
    held = docs.select(F.col("name").alias("_name"), "id", text.alias("_text"), pages.alias("_pages")).groupBy("_name").agg(F.min_by(F.struct("_text", "_pages"), "id").alias("_s"))
    wanted = docs.filter("slice_index > 0").select("id", F.col("source_name").alias("_source"), F.explode(F.sequence(F.lit(0), F.col("slice_index") - 1)).alias("_i"))
    wanted = wanted.withColumn("_name", F.when(F.col("_i") == 0, F.col("_source")).otherwise(F.concat_ws("_", "_source", F.col("_i").cast("string"))))
    found = wanted.join(held, "_name").filter("_s._text <> ''")
    part = F.concat(_template(HEADING, F.col("_i") + 1, F.col("_name"), F.col("_s._pages")), F.col("_s._text"))
    prior = found.groupBy(F.col("id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_i", part.alias("part")))).alias("_parts"))
    joined = docs.join(prior, F.col("id") == F.col("_of"), "left")
    return joined.withColumns({"prior": F.coalesce(F.array_join(F.transform("_parts", lambda p: p["part"]), "\n\n"), F.lit("")), "n_prior": F.coalesce(F.size("_parts"), F.lit(0))}).drop("_of", "_parts")


def summary_prompts(docs: DataFrame, template: str, continuation: str) -> DataFrame:
    """Adds prompt, continued: a slice with earlier text goes into `continuation` ({slice_pos}, {n_slices}, {prior_content}, {content}), any other into `template` ({content})."""
    rows = prior_text(slice_meta(docs))
    content = F.coalesce("content", F.lit(""))
    plain = F.replace(F.lit(template), F.lit("{content}"), content) if "{content}" in template else F.concat(F.lit(f"{template}\n\n"), content)
    more = F.lit(continuation)
    for field, value in (("slice_pos", _template("{}/{}", F.col("slice_index") + 1, F.col("n_slices"))), ("n_slices", F.col("n_slices").cast("string")), ("prior_content", F.col("prior")), ("content", content)):
        more = F.replace(more, F.lit("{" + field + "}"), value)
    continued = F.col("prior") != ""
    return rows.withColumns({"continued": continued, "prompt": F.when(continued, more).otherwise(plain)})


def wavefront(rows: DataFrame, family: str, index: str, model: TextModel, template: str = "{prior}\n{content}", text: str = "content", keep: int = 2_000) -> DataFrame:
    """Adds turn, answer, status, prior: every family goes through the model slice by slice, all families at once.

    Round i asks for the i-th slice of each family, with the answers that came before it in its prompt: the last `keep`
    characters of them, one after the other. A slice whose call failed adds nothing. There are as many rounds as the longest
    family has slices; each is written before the next, and reads only the answers of the one before it.
    """
    spark = rows.sparkSession
    ordered = written(rows.withColumn("turn", F.row_number().over(Window.partitionBy(family).orderBy(index))), "slices")
    rounds, path = ordered.agg(F.max("turn")).first()[0] or 0, new_path(spark, "wavefront")
    carried, schema = None, None
    for n in range(1, rounds + 1):
        due = ordered.filter(F.col("turn") == n)
        due = due.withColumn("prior", F.lit("")) if carried is None else due.join(carried, family, "left").withColumn("prior", F.coalesce("prior", F.lit("")))
        prompt = F.replace(F.replace(F.lit(template), F.lit("{prior}"), F.col("prior")), F.lit("{content}"), F.coalesce(F.col(text), F.lit("")))
        done = answers(due.withColumn("prompt", prompt), model).drop("key", "cache_hit", "prompt").withColumn("answer", F.when(F.col("status") == 1, F.col("answer")))
        schema = schema or done.schema
        done.select(*schema.names).write.parquet(f"{path}/round-{n}")
        last = spark.read.schema(schema).parquet(f"{path}/round-{n}")
        joined = F.concat_ws("\n", F.nullif("prior", F.lit("")), "answer")
        carried = last.select(family, F.substring(joined, F.greatest(F.lit(1), F.char_length(joined) - keep + 1), F.lit(keep)).alias("prior"))
    if not rounds:
        return ordered.withColumns({"prior": F.lit(""), "answer": F.lit(None).cast("string"), "status": F.lit(None).cast("int")})
    return spark.read.schema(schema).parquet(*[f"{path}/round-{n}" for n in range(1, rounds + 1)])
