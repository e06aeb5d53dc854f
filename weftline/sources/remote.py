"""Sources: remote product rows, object downloads, local files, text and PDF documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, file_name, object_key, slice_name

#: The file types of the product table.
FILE_TYPES = {"all": None, "0": None, "none": None, "*": None, "": None, "1": 1, "tds": 1, "2": 2, "msds": 2}


def file_type(value: str | int | None) -> int | None:
    key = "all" if value is None else str(value).strip().lower()
    if key not in FILE_TYPES:
        raise ValueError(f"unknown file type {value!r}")
    return FILE_TYPES[key]


def product_rows(table: DataFrame, kind: str | int | None = "all", limit: int = 0) -> DataFrame:
    """The rows to download of a remote table: only columns that exist are projected and filtered on."""
    have = {c.lower(): c for c in table.columns}
    wanted = [have[c] for c in ("id", "oss_url", "type", "is_delete", "product_name") if c in have]
    out = table.select(*wanted)
    if "is_delete" in have:
        out = out.filter(F.col(have["is_delete"]) == 0)
    if "type" in have and file_type(kind) is not None:
        out = out.filter(F.col(have["type"]) == file_type(kind))
    out = out.orderBy(have.get("id", have["oss_url"]))
    return out.limit(limit) if limit > 0 else out


def jdbc_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; partition: numeric column, lower and upper bound, number of parallel reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


def downloads(rows: DataFrame, url_col: str = "oss_url", order_col: str = "id") -> DataFrame:
    """url, key, file and what becomes of each row: download, skipped_invalid or skipped_duplicate (first by key, then by file name, wins)."""
    keyed = rows.select(F.col(order_col).alias("id"), F.col(url_col).alias("url"), object_key(url_col).alias("key"), file_name(object_key(url_col)).alias("file"))
    valid = F.col("file").isNotNull()
    by_key = Window.partitionBy("key").orderBy("id")
    first = keyed.withColumn("n_key", F.when(valid, F.row_number().over(by_key)))
    by_file = Window.partitionBy("file", F.col("n_key") == 1).orderBy("id")
    ranked = first.withColumn("n_file", F.when(F.col("n_key") == 1, F.row_number().over(by_file)))
    state = F.when(~valid, "skipped_invalid").when((F.col("n_key") > 1) | (F.col("n_file") > 1), "skipped_duplicate").otherwise("download")
    return ranked.select("id", "url", "key", "file", state.alias("state"))


def keep_preference(name: Column | str) -> Column:
    """Which of equal files to keep: a long hexadecimal stem, then the least `_digits` tail, then the name."""
    c = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    tail = F.regexp_extract(stem, r"_([0-9]{1,18})$", 1)
    return F.struct(
        F.when(stem.rlike("^[0-9a-fA-F]{16,}$"), 0).when(tail != "", 1).otherwise(2).alias("kind"),
        F.when(stem.rlike("^[0-9a-fA-F]{16,}$") | (tail == ""), F.lit(0).cast("long")).otherwise(tail.try_cast("long")).alias("number"),
        c.alias("name"),
    )


def duplicate_files(files: DataFrame, name_col: str = "name", hash_col: str = "hash") -> DataFrame:
    """name, hash, kept_name, keep: of the files with equal hashes the preferred one is kept. Any group's minimum is found before rows are shuffled."""
    best = files.groupBy(F.col(hash_col).alias("_h")).agg(F.min(keep_preference(name_col)).alias("_best"))
    joined = files.join(best, files[hash_col] == F.col("_h"))
    return joined.select(files[name_col].alias("name"), files[hash_col].alias("hash"), F.col("_best.name").alias("kept_name"), (files[name_col] == F.col("_best.name")).alias("keep"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """name, content: one row for each text file."""
    return spark.read.option("wholetext", True).text(path).select(base_name(F.input_file_name()).alias("name"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """name, path, hash, problem: listed files with the MD5 of their bytes and what is wrong with them ("" if they are PDFs). Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(base_name("path").alias("name"), "path", F.md5("content").alias("hash"), pdf_problem(F.col("content")).alias("problem"))


def pdf_problem(content: Column) -> Column:
    """What a file is by its first bytes, "" for a PDF."""
    head = F.substring(F.hex(content), 1, 16)
    text = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    return (
        F.when(head.startswith("25504446"), "").when(head.startswith("89504E47"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("504B0304"), "ZIP")
        .when(head.startswith("D0CF11E0"), "OLE").when(text.rlike(r"^\s*<(!doctype|html)"), "HTML").when(text.rlike("error|denied|not found|nosuchkey"), "error text").otherwise("unknown")
    )


def plan_slices(files: DataFrame, max_pages: int = 12, name_col: str = "name", pages_col: str = "pages") -> DataFrame:
    """One row for each half-open range of at most max_pages pages: base, doc_name, page_start, page_end, slice_index, total_pages, n_slices."""
    n = F.greatest(F.lit(1), F.ceil(F.col(pages_col) / max_pages)).cast("int")
    out = files.withColumn("n_slices", n).withColumn("slice_index", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))
    i = F.col("slice_index")
    return out.select(
        F.col(name_col).alias("base"), slice_name(F.col(name_col), i).alias("doc_name"), (i * max_pages).cast("long").alias("page_start"),
        F.least(F.col(pages_col).cast("long"), (i + 1) * max_pages).alias("page_end"), "slice_index", F.col(pages_col).cast("long").alias("total_pages"), "n_slices",
    )
