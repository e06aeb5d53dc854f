"""Reading the engine's own tables and files: documents, sub-graphs, evaluation files, statistics sheets; exports of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.values import cell_text, lenient_int, ratio


def documents(docs: DataFrame) -> DataFrame:
    """id, name, content of the documents that hold text; a missing name is doc_{id}."""
    name = F.coalesce(F.nullif(strip("name"), F.lit("")), F.concat(F.lit("doc_"), F.col("id").cast("string")))
    return docs.filter(F.coalesce(strip("content"), F.lit("")) != "").select("id", name.alias("name"), "content")


def resolve_ids(docs: DataFrame, ids: list[int], names: list[str]) -> DataFrame:
    """doc_id, place: the ids, then those of the names, each once at its first place. An unknown name raises."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "n int, wanted string")
    found = asked.join(docs.select("id", "name"), F.col("wanted") == F.col("name"), "left").groupBy("n", "wanted").agg(F.min("id").alias("doc_id"))
    if lost := [r.wanted for r in found.filter("doc_id IS NULL").orderBy("n").collect()]:
        raise ValueError(f"no document is named {lost[0]!r}")
    given = spark.createDataFrame([(i, d) for i, d in enumerate(ids)], "place long, doc_id long")
    all_ = given.unionByName(found.select((F.col("n") + len(ids)).cast("long").alias("place"), F.col("doc_id").cast("long").alias("doc_id")))
    first = all_.groupBy("doc_id").agg(F.min("place").alias("first"))
    return first.select("doc_id", F.row_number().over(Window.orderBy("first")).alias("place"))  # as many rows as were asked for


def sub_graphs(docs: DataFrame, hyperedges: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, doc, hyperedges, chunks, nodes: each document with the {name, content} of its rows of every table, by id; none are empty lists."""
    out = docs.select(F.col("id").alias("doc_id"), F.struct("name", "content").alias("doc"))
    for label, table in (("hyperedges", hyperedges), ("chunks", chunks), ("nodes", nodes)):
        parts = table.groupBy(F.col("doc_id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("id", "name", "content"))).alias("_rows"))
        pairs = F.transform(F.col("_rows"), lambda r: F.struct(r["name"].alias("name"), r["content"].alias("content")))
        out = out.join(parts, F.col("doc_id") == F.col("_of"), "left").withColumn(label, F.coalesce(pairs, F.array().cast("array<struct<name: string, content: string>>"))).drop("_of", "_rows")
    return out


def listed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The elements of the list `key` of JSON files that hold one object each (questions of a dataset, results of an evaluation). A file without it raises."""
    whole = spark.read.json(path, multiLine=True)
    if key not in whole.columns:
        raise ValueError(f"{path} has no {key!r}")
    return whole.select(F.inline(key))


#: Header words of a statistics sheet.
COUNT_HEADERS = ["数量", "计数", "count", "n"]
RATIO_HEADERS = ["占比", "比例", "ratio", "percent", "%"]
LABEL_HEADERS = ["类别", "分类", "label", "项"]
TOTAL_LABELS = ["总问题数", "问题总数", "n_questions"]
UNNAMED = "未命名分类"


def distributions(sheet: DataFrame, row: str = "row", cells: tuple[str, str, str] = ("a", "b", "c"), sheet_id: str = "sheet") -> DataFrame:
    """sheet, field, label, n, ratio of the tables `label, count, share` on statistics sheets, one of three cells a row.

    A table starts at its header (category, 数量, 占比), is named by the header or, where that is general, by the title above
    it (按...分布), and ends at an empty row or one that isn't an item. Missing shares are those of the counts. A sheet is
    small; sheets are independent of each other.
    """
    texts = [cell_text(c) for c in cells]
    full = F.filter(F.array(*texts), lambda x: x != "")
    rows = sheet.select(F.col(sheet_id).alias("sheet"), F.col(row).alias("row"), full.alias("_full"), *[t.alias(f"_{i}") for i, t in enumerate(texts)])
    size, first, second, third = F.size("_full"), F.get("_full", F.lit(0)), F.get("_full", F.lit(1)), F.get("_full", F.lit(2))
    title = F.when(size == 1, F.nullif(F.regexp_extract(first, "^按(.+?)分布$", 1), F.lit("")))
    header = (size >= 2) & second.isin(COUNT_HEADERS) & (third.isNull() | third.isin(RATIO_HEADERS))
    total = (size > 0) & first.isin(TOTAL_LABELS)
    count = lenient_int("_1")
    item = (F.col("_0") != "") & count.isNotNull()
    kind = F.when(size == 0, "empty").when(total, "total").when(title.isNotNull(), "title").when(header, "header").when(item, "item").otherwise("other")
    rows = rows.withColumns({"_kind": kind, "_title": title})
    until = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a title holds until an empty row or the next header; a table from its header to whatever else is no item (a total's row doesn't end it)
    marked = rows.withColumn("_start", F.last(F.when(~F.col("_kind").isin("item", "total"), F.struct("row", "_kind")), ignorenulls=True).over(until))
    before = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_above", F.last(F.when(F.col("_kind").isin("empty", "title", "header"), F.struct(F.col("_kind").alias("kind"), F.col("_title").alias("title"))), ignorenulls=True).over(before))
    named = F.when(first.isin(LABEL_HEADERS), F.coalesce(F.when(F.col("_above.kind") == "title", F.col("_above.title")), F.lit(UNNAMED))).otherwise(first)
    headers = marked.filter("_kind = 'header'").select(F.col("sheet").alias("_s"), F.col("row").alias("_r"), named.alias("field"))
    parts = marked.filter("_kind = 'item' AND _start._kind = 'header'").join(headers, (F.col("sheet") == F.col("_s")) & (F.col("_start.row") == F.col("_r")))
    last = parts.withColumns({"n": count, "_last": F.max("_r").over(Window.partitionBy("sheet", "field"))}).filter("_r = _last")
    share = F.coalesce(ratio("_2"), F.round(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("sheet", "field")), F.lit(0)), 6))
    return last.select("sheet", "field", F.col("_0").alias("label"), "n", share.alias("ratio"))


def design_entries(sheet: DataFrame, row: str = "row", key: str = "a", value: str = "b") -> DataFrame:
    """key, value of a sheet of pairs; of equal keys the last row counts, rows without a key go."""
    pairs = sheet.select(F.col(row).alias("_row"), cell_text(key).alias("key"), cell_text(value).alias("value")).filter("key <> ''")
    return pairs.groupBy("key").agg(F.max_by("value", "_row").alias("value"))


def drop_cached(cache: DataFrame, names: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The cache (key, input, ...) without the entries whose input JSON has one of the names, or whose key is listed."""
    out = cache
    if names is not None:
        gone = names.select(F.col("name").alias("_gone")).distinct()
        out = out.join(gone, F.get_json_object("input", "$.name") == F.col("_gone"), "left_anti")
    if keys is not None:
        out = out.join(keys.select(F.col("key").alias("_gone")).distinct(), F.col("key") == F.col("_gone"), "left_anti")
    return out


def throughput(samples: DataFrame, keys: list[str], at: str, counters: list[str], gauges: list[str] = ()) -> DataFrame:
    """keys, dt and, between a window's first and last sample, each counter's growth (_d) and rate (_ps) and each gauge's mean of both ends (_avg). A window of one sample has null rates."""
    ends = samples.groupBy(*keys).agg(
        F.min(at).alias("_t0"), F.max(at).alias("_t1"), *[f(c, at).alias(f"_{c}{i}") for c in [*counters, *gauges] for i, f in ((0, F.min_by), (1, F.max_by))]
    )
    dt = (F.col("_t1").cast("double") - F.col("_t0").cast("double")).alias("dt")
    out = ends.withColumn("dt", dt)
    for c in counters:
        out = out.withColumn(f"{c}_d", F.col(f"_{c}1") - F.col(f"_{c}0")).withColumn(f"{c}_ps", F.when(F.col("dt") > 0, F.col(f"{c}_d") / F.col("dt")))
    for g in gauges:
        known = F.col(f"_{g}0").isNotNull() | F.col(f"_{g}1").isNotNull()
        out = out.withColumn(f"{g}_avg", F.when(known, (F.coalesce(f"_{g}0", F.lit(0)) + F.coalesce(f"_{g}1", F.lit(0))) / 2.0))
    return out.select(*keys, "dt", *[f"{c}_{x}" for c in counters for x in ("d", "ps")], *[f"{g}_avg" for g in gauges])


def counter_by_label(metrics: DataFrame, name: str, label: str) -> DataFrame:
    """label, value of a counter by one of its labels (name, labels, value as exposition() gives them); `total` where it has none. Of equal labels the last line counts, here the greatest value, as counters grow."""
    value = F.coalesce(F.nullif(F.regexp_extract("labels", f'{label}="([^"]+)"', 1), F.lit("")), F.lit("total"))
    return metrics.filter(F.col("name") == name).groupBy(value.alias(label)).agg(F.max(F.floor("value")).cast("long").alias("value"))


def sum_and_count(metrics: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, sum, count of a histogram, and their mean (null without a count)."""
    of = lambda suffix: F.max(F.when(F.col("name") == name + suffix, F.col("value")))
    out = metrics.groupBy(*keys).agg(of("_sum").alias("sum"), of("_count").alias("count"))
    return out.withColumn("mean", F.when(F.col("count") != 0, F.col("sum") / F.col("count")))
