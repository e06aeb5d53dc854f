"""Table operations: insert-or-ignore, partial updates, keyset pages, cascades, slice families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import family_base
from ..storage import written
from .components import components


def insert_ignore(existing: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of new that an INSERT OR IGNORE adds: the first by order for each key, unless the key exists. Null keys never clash."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.filter(known).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if existing is not None:
        fresh = fresh.join(existing.select(*keys), keys, "left_anti")
    return fresh.unionByName(new.filter(~known))


def update_last_wins(table: DataFrame, changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A partial update by key: of several changes to a row the last one counts; rows without one stay."""
    last = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    joined = table.join(last, table[key] == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(table[c]).alias(c) if c in columns else table[c] for c in table.columns])


def keyset_page(table: DataFrame, where, id_cols: list[str], after: tuple | None, size: int, columns: list[str] | None = None) -> DataFrame:
    """The next page of rows by ascending id columns."""
    rows = table.filter(where)
    if after is not None:
        rows = rows.filter(F.struct(*id_cols) > F.struct(*[F.lit(v).cast(table.schema[c].dataType) for c, v in zip(id_cols, after)]))
    return rows.select(*dict.fromkeys([*id_cols, *(columns or table.columns)])).orderBy(*id_cols).limit(size)


def cascade(parents: DataFrame, children: list[tuple[DataFrame, str, str]], key: str) -> list[tuple[DataFrame, DataFrame]]:
    """(kept, deleted) of each child table in turn, given deleted parents; children: (table, its foreign key, its own key)."""
    gone, out = parents.select(F.col(key).alias("_gone")).distinct(), []
    for table, foreign, own in children:
        out.append((table.join(gone, table[foreign] == F.col("_gone"), "left_anti"), table.join(gone, table[foreign] == F.col("_gone"), "left_semi")))
        gone = out[-1][1].select(F.col(own).alias("_gone")).distinct()
    return out


def family_closure(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The docs that a delete of `names` reaches: by name, slice-family base or source name, until nothing is added.

    docs: id, name, source_name. names: name. Names that one doc has are joined, and what is reached is whole components of such
    names, which take a number of rounds that grows with the logarithm of a chain's length.
    """
    base = family_base("name")
    own = docs.select("id", F.array_distinct(F.array_compact(F.array(F.col("name"), base, F.col("source_name")))).alias("_names"))
    edges = own.select(F.array_min("_names").alias("a"), F.explode("_names").alias("b"))
    roots = written(components(edges), "closure")
    wanted = names.select(F.col("name").alias("_wanted")).union(names.select(base)).distinct()
    reached = roots.join(wanted, F.col("node") == F.col("_wanted"), "left_semi").select("root").distinct()
    whole = roots.join(reached, "root", "left_semi").select(F.col("node").alias("_wanted")).union(wanted).distinct()
    hit = own.select("id", F.explode("_names").alias("_name")).join(whole, F.col("_name") == F.col("_wanted"), "left_semi").select("id").distinct()
    return docs.join(hit, "id", "left_semi")
