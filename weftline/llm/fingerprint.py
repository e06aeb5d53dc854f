"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For each of K samples every term draws r and c from
Gamma(2, 1) and b from the unit interval, all from hashes of the term and the sample's number; with t = floor(ln(w) / r + b)
its rank is ln(c) - r * (t - b + 1), and the term of least rank is the sample. Two texts agree on a sample with a probability
equal to the generalised Jaccard similarity of their weights (sum of minima over sum of maxima). The least rank itself tells
term and t apart, so a fingerprint is K hashes of 16 bits, one for each least rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, written

SAMPLES = 64
_HEX = 4  # hex digits a sample
_REACH = 14.0  # e**rank is exponential with a mean of 1/weight, so the least of a text is beyond _REACH/words once in e**14 samples


def weighted_terms(text: Column | str) -> Column:
    """array<struct<term, at>> of sorted term hashes at the end of each run of equal ones; run lengths are the weights."""
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _unit(bits: Column, shift: int, width: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) / float(1 << width)


def _rank(term: Column, log_weight: Column, k: int) -> Column:
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_unit(one, 0, 32) * _unit(one, 32, 32))
    log_c = F.ln(-F.ln(_unit(two, 0, 24) * _unit(two, 24, 24)))
    b = _unit(two, 48, 16)
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def _within(term: Column, bound: Column, single: Column, k: int) -> Column:
    """False only if e**rank is above bound (times the weight), told without a logarithm.

    e**rank is c * u**z with c = -ln(p) >= 2 (1 - p) / (1 + p) and u = e**-r. For single words z is s = 1 - b and
    u**s >= u / (s + (1 - s) u), the harmonic mean below the geometric one; for others u**z >= u / weight.
    """
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u, p = _unit(one, 0, 32) * _unit(one, 32, 32), _unit(two, 0, 24) * _unit(two, 24, 24)
    s = F.lit(1.0) - _unit(two, 48, 16) * single
    return F.lit(2.0) * (F.lit(1.0) - p) * u <= bound * (F.lit(1.0) + p) * (s + (F.lit(1.0) - s) * u)


def sign(rows: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES, sure: bool = True) -> DataFrame:
    """keys and `fingerprint` for each distinct set of keys, whose rows must have one text each.

    Rows already partitioned by some of the keys are not shuffled again. A text without words has a fingerprint of its
    own, equal for all such texts. Unless it has to be sure, only ranks that may be within _REACH/words are drawn, and the
    fingerprint is null if a sample has none there; it is the same otherwise.
    """
    hashed = rows.select(*keys, weighted_terms(F.col(text_col)).alias("_terms"))
    ends = F.filter(F.transform("_terms", lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda e: F.coalesce(F.get("_terms", e["at"] + 1) != e["term"], F.lit(True)))
    runs = hashed.select(*keys, F.size("_terms").alias("_words"), ends.alias("_ends"))
    weighted = F.transform("_ends", lambda e, i: F.struct(e["term"].alias("term"), (e["at"] - F.coalesce(F.get("_ends", i - 1)["at"], F.lit(-1))).alias("weight")))
    terms = runs.select(*keys, "_words", F.explode_outer(weighted).alias("_t"))
    weight, reach = F.col("_t.weight").cast("double"), F.when(F.col("_words") > _REACH, F.lit(_REACH) / F.col("_words")).otherwise(F.lit(float("inf")))
    draws = terms.select(*keys, F.col("_t.term").alias("_term"), F.ln(weight).alias("_log_weight"), reach.alias("_within"), (reach * weight).alias("_bound"), F.when(weight == 1, 1.0).otherwise(0.0).alias("_single"))
    ranks = [_rank(F.col("_term"), F.col("_log_weight"), k) for k in range(samples)]
    if not sure:
        ranks = [F.when(_within(F.col("_term"), F.col("_bound"), F.col("_single"), k), rank) for k, rank in enumerate(ranks)]
    least = draws.groupBy(*keys).agg(*[F.min(rank).alias(f"_m{k}") for k, rank in enumerate(ranks)], F.max("_within").alias("_within"))
    parts = [F.lpad(F.hex(F.xxhash64(f"_m{k}").bitwiseAND(F.lit(0xFFFF))), _HEX, "0") for k in range(samples)]
    fingerprint = F.lower(F.concat(*parts))
    if not sure:
        most = F.greatest(*[F.coalesce(f"_m{k}", F.lit(float("inf"))) for k in range(samples)], F.lit(float("-inf")))
        # a text of few words has all its ranks drawn, one without words has none
        fingerprint = F.when((F.col("_within") == float("inf")) | (most < F.ln("_within") - 1e-9), fingerprint)
    return least.select(*keys, fingerprint.alias("fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of samples on which two fingerprints agree: the estimate of the generalised Jaccard similarity."""
    agree = [(F.substring(a, _HEX * k + 1, _HEX) == F.substring(b, _HEX * k + 1, _HEX)).cast("int") for k in range(samples)]
    total = agree[0]
    for x in agree[1:]:
        total = total + x
    return total / F.lit(float(samples))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: id, fingerprint. A null text is empty; repeated rows and null ids are kept."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return sign(rows, ["_row", "_id"], "_text", samples).select(F.col("_id").alias(id_col), "fingerprint")


_FAN = 12


def _lower_bucket(buckets: DataFrame, least: int, most: int) -> DataFrame:
    """bucket, below: the next lower bucket there is, null for the lowest. Buckets are distinct; no task gets more than 2**_FAN."""
    if most - least < 1 << _FAN:
        return buckets.withColumn("below", F.lag("bucket").over(Window.partitionBy(F.lit(0)).orderBy("bucket")))
    grouped = buckets.withColumn("group", F.shiftright("bucket", _FAN))
    inside = grouped.withColumn("below", F.lag("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    tops = written(grouped.groupBy("group").agg(F.max("bucket").alias("top")), "bucket-tops")
    under = _lower_bucket(tops.select(F.col("group").alias("bucket")), least >> _FAN, most >> _FAN).withColumnsRenamed({"bucket": "group", "below": "lower_group"})
    under = under.join(tops.withColumnRenamed("group", "lower_group"), "lower_group", "left").select("group", F.col("top").alias("under_top"))
    return inside.join(under, "group", "left").select("bucket", F.coalesce("below", "under_top").alias("below"))


def _signed_pairs(rows: DataFrame, beyond: DataFrame, samples: int, sure: bool) -> DataFrame:
    """For each row of whole buckets its place, its next row's place, and the fingerprints of its text and its edited text."""
    order = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("text"))
    placed = rows.withColumns({"rn": F.row_number().over(order), "after": F.when(F.col("id").isNotNull(), F.lead("text").over(order))})
    placed = placed.join(beyond, F.col("bucket") == F.col("of_bucket"), "left")
    n_chars, inside = F.char_length("text").cast("long"), F.col("after").isNotNull()
    swap = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - swap), F.substring(F.coalesce("after", "first_text", F.lit("")), F.lit(1), swap))
    placed = placed.select("bucket", "rn", "id", "text", n_chars.alias("n_chars"), "after", "first_text", F.when(inside, F.col("bucket")).otherwise(F.col("next_bucket")).alias("next_bucket"), F.when(inside, F.col("rn") + 1).otherwise(1).alias("next_rn"))
    placed = placed.select("bucket", "rn", "id", "n_chars", "next_bucket", "next_rn", "text", edited.alias("edited"))
    facts = ["bucket", "rn", "id", "n_chars", "next_bucket", "next_rn", "edited_sha256"]
    placed = placed.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    both = placed.select(*facts, F.inline(F.array(F.struct(F.lit(False).alias("changed"), F.col("text").alias("body")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("body")))))
    signed = sign(both, [*facts, "changed"], "body", samples, sure)
    return signed.groupBy(*facts).agg(F.max(F.when(~F.col("changed"), F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("changed"), F.col("fingerprint"))).alias("edited_fingerprint"))


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, bits: int = 6) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The next document is the next row by descending id (by descending text among equal ids), after the last one the
    first; the edited text has the last third of the code points (rounded down) replaced by as many of the next document's
    first, or all it has. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. The next document of a row with a null id is the first row, and none comes before it. A table of
    one row is its own next; an empty table gives no rows. Texts move once, by buckets of 2**bits ids, which may be of any
    size and spread.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(F.shiftright("id", bits), F.lit(-(1 << 62)) + F.pmod(F.xxhash64("text"), F.lit(1 << 20))))
    known = rows.filter("id IS NOT NULL")
    ends = known.agg(F.min("bucket").alias("least"), F.max("bucket").alias("most")).first()
    least, most = ends.least or 0, ends.most or 0
    tops = known.groupBy("bucket").agg(F.max(F.struct("id", "text")).alias("top")).select(F.col("bucket").alias("next_bucket"), F.col("top.text").alias("first_text"))
    lower = _lower_bucket(known.select("bucket").distinct(), least, most).select("bucket", F.coalesce("below", F.lit(most)).alias("next_bucket"))
    lower = lower.union(rows.filter("id IS NULL").select("bucket").distinct().select("bucket", F.lit(most).cast("long")))
    beyond = written(lower.join(tops, "next_bucket", "left").select(F.col("bucket").alias("of_bucket"), "next_bucket", "first_text"), "next-buckets")
    pairs = written(_signed_pairs(rows, beyond, samples, sure=False), "fingerprints")
    unsure = written(pairs.filter("fingerprint IS NULL OR edited_fingerprint IS NULL").select("bucket").distinct(), "buckets-unsure")
    again = written(_signed_pairs(rows.join(unsure, "bucket", "left_semi"), beyond, samples, sure=True), "fingerprints-sure")
    pairs = pairs.join(unsure, "bucket", "left_anti").unionByName(again)
    then = pairs.select(F.col("bucket").alias("b"), F.col("rn").alias("n"), F.col("fingerprint").alias("next_fingerprint"))
    joined = pairs.join(then, (F.col("next_bucket") == F.col("b")) & (F.col("next_rn") == F.col("n")), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), F.coalesce(likeness("fingerprint", "next_fingerprint", samples), F.lit(0.0)).alias("near_next")
    )
