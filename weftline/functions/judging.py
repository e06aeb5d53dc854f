"""Models' JSON answers of many shapes, read as VARIANT: judges' verdicts on one or two systems, and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col, strip, strip_fence
from .values import PARTLY, RIGHT, WRONG, json_object, score_0_to_3, verdict, verdict_of_score


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parsed_object(text: Column | str) -> Column:
    """The JSON object of an answer: all of it without fences, or what its outermost braces hold where that isn't JSON. Null for anything else."""
    whole, inner = F.try_parse_json(strip_fence(text)), F.try_parse_json(json_object(strip_fence(text)))
    found = F.when(whole.isNotNull(), whole).otherwise(inner)
    return F.when(is_object(found), found)


def field(v: Column, *path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "variant")


def text_field(v: Column, *path: str) -> Column:
    """A field as text; null where it is missing, null or empty."""
    return F.nullif(F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "string"), F.lit(""))


def items(v: Column, *path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "array<variant>")


def _first_object(*vs: Column) -> Column:
    return F.coalesce(*[F.when(is_object(v), v) for v in vs])


def _side(nested: Column) -> Column:
    return F.struct(
        F.coalesce(text_field(nested, "judgment"), text_field(nested, "llm_acc")).alias("judgment"), text_field(nested, "score").alias("score"),
        text_field(nested, "reason").alias("reason"), F.coalesce(items(nested, "dimension_scores"), items(nested, "dimensions")).alias("dimensions"),
    )


def own_object(v: Column, side: str) -> Column:
    """The object that holds answer A or B of a comparison: under a key of its own (answer_a, 回答A, A and so on), at the top or within `answers`, or with a label in a list of answers."""
    low, up = side.lower(), side.upper()
    keys = [f"answer_{low}", f"answer{low}", f"Answer_{up}", f"回答{up}", f"回答{low}", up, low]
    label = lambda x: F.upper(strip(F.coalesce(text_field(x, "id"), text_field(x, "label"), text_field(x, "name"), F.lit(""))))
    listed = F.filter(items(v, "answers"), lambda x: is_object(x) & label(x).isin(up, f"ANSWER_{up}", f"ANSWER{up}", f"回答{up}"))
    return _first_object(*[field(v, k) for k in keys], *[field(v, "answers", k) for k in keys], F.get(listed, F.lit(0)))


def spread_side(v: Column, side: str) -> Column:
    """As _side(), of an answer that spreads a side over fields such as score_a; null where it has none of them."""
    low, up = side.lower(), side.upper()

    def spread(get, *names: str) -> Column:
        return F.coalesce(*[get(v, k) for n in names for k in (f"{n}_{low}", f"{low}_{n}", f"{n}{up}", f"{n}_{up}")])

    parts = {"judgment": spread(text_field, "judgment", "llm_acc"), "score": spread(text_field, "score"), "reason": spread(text_field, "reason", "comment"), "dimensions": spread(items, "dimension_scores", "dimensions")}
    return F.when(F.coalesce(*[F.when(p.isNotNull(), True) for p in parts.values()]), F.struct(*[p.alias(n) for n, p in parts.items()]))


def judged_pairs(rows: DataFrame, answer: str, keys: list[str], three: bool = True, dimensions: Column | None = None) -> DataFrame:
    """keys, a, b, hypergraph, llm_only (side_judgment() of each side that an answer names, else null), better (as better_raw() gives it).

    Each step is a column of its own, which Spark evaluates once, as the next ones use it many times.
    """
    sides = ("a", "b")
    parsed = rows.select(*keys, parsed_object(answer).alias("_v"))
    v = F.col("_v")
    found = parsed.withColumns({f"_own_{s}": own_object(v, s) for s in sides} | {f"_spread_{s}": spread_side(v, s) for s in sides} | {f"_named_{s}": F.coalesce(*[field(v, k) for k in ks]) for s, ks in SYSTEM_KEYS.items()})
    both = is_object(F.col("_named_hypergraph")) & is_object(F.col("_named_llm_only"))
    shaped = {f"_{s}": F.when(F.col(f"_own_{s}").isNotNull(), _side(F.col(f"_own_{s}"))).otherwise(F.col(f"_spread_{s}")) for s in sides}
    shaped |= {f"_{s}": F.when(both, _side(F.col(f"_named_{s}"))) for s in SYSTEM_KEYS}
    found = found.withColumns(shaped)
    judged = found.withColumns({s: side_judgment(F.col(f"_{s}"), three, dimensions) for s in (*sides, *SYSTEM_KEYS)})
    return judged.select(*keys, *sides, *SYSTEM_KEYS, better_raw(v).alias("better"))


#: Keys under which an answer may name the two systems.
SYSTEM_KEYS = {"hypergraph": ["hypergraph", "超图", "rag"], "llm_only": ["llm_only", "纯LLM", "llm", "baseline"]}


def better_raw(v: Column) -> Column:
    """What an answer says of the winner: better, winner or prefer, at the top or within `comparison`, or that as text."""
    top = [F.try_variant_get(v, f"$.{k}", "string") for k in ("better", "winner", "prefer")]
    inside = [text_field(v, "comparison", k) for k in ("better", "winner", "prefer")]
    plain = F.when(~is_object(field(v, "comparison")), F.try_variant_get(v, "$.comparison", "string"))
    return F.coalesce(*top, *inside, plain)


def side_judgment(side: Column, three: bool = True, dimensions: Column | None = None) -> Column:
    """struct<llm_acc, score, judge_reason, dimension_scores> of a side; null where it names no known verdict.

    With three labels a score stands in for a missing verdict and a verdict for a missing score; `dimensions` (names) get the
    overall score where the side scores none. With two there are no scores.
    """
    reason = F.coalesce(strip(side["reason"]), F.lit("")).alias("judge_reason")
    if not three:
        found = verdict(side["judgment"], three=False)
        return F.when(found.isNotNull(), F.struct(found.alias("llm_acc"), reason))
    given = score_0_to_3(side["score"])
    found = F.coalesce(verdict(side["judgment"]), verdict_of_score(given))
    score = F.coalesce(given, F.when(found == RIGHT, 2).when(found == PARTLY, 1).when(found == WRONG, 0))

    def scored(d: Column) -> Column:
        of = score_0_to_3(text_field(d, "score"))
        passed = F.coalesce(F.try_variant_get(d, "$.pass", "boolean"), of >= 2)
        return F.struct(strip(F.coalesce(text_field(d, "dimension"), text_field(d, "name"), F.lit(""))).alias("dimension"), of.alias("score"), passed.alias("pass"), strip(F.coalesce(text_field(d, "comment"), F.lit(""))).alias("comment"))

    own = F.filter(F.transform(F.filter(side["dimensions"], is_object), scored), lambda d: d["dimension"] != "")
    names = dimensions if dimensions is not None else F.array().cast("array<string>")
    inherited = F.transform(names, lambda n: F.struct(n.alias("dimension"), score.alias("score"), (score >= 2).alias("pass"), F.lit("").alias("comment")))
    return F.when(found.isNotNull(), F.struct(found.alias("llm_acc"), score.alias("score"), reason, F.when(F.size(own) > 0, own).otherwise(inherited).alias("dimension_scores")))


def parse_plan(text: Column | str) -> Column:
    """array<struct<id, question, depends_on>> of a plan in an answer: its steps (or `plan`) with a question, ids by default their place from 1; no steps where there is no plan."""
    v = parsed_object(text)
    steps = items(v, "steps")
    listed = F.when(F.size(steps) > 0, steps).when(F.coalesce(text_field(v, "steps"), F.lit("[]")).isin("[]", "{}", "0", "false", "null"), items(v, "plan"))

    def step(s: Column, i: Column) -> Column:
        of = F.nullif(text_field(s, "id"), F.lit("0"))
        deps = F.coalesce(F.when(F.size(items(s, "depends_on")) > 0, items(s, "depends_on")), items(s, "deps"), F.array().cast("array<variant>"))
        named = F.filter(F.transform(deps, lambda d: strip(F.try_variant_get(d, "$", "string"))), lambda d: d != "")
        place = (i + 1).cast("string")
        question = strip(F.coalesce(text_field(s, "question"), text_field(s, "query"), F.lit("")))
        return F.struct(F.coalesce(F.nullif(strip(of), F.lit("")), place).alias("id"), F.when(is_object(s), question).otherwise("").alias("question"), named.alias("depends_on"))

    found = F.filter(F.transform(listed, step), lambda s: s["question"] != "")
    return F.coalesce(found, F.array().cast("array<struct<id: string, question: string, depends_on: array<string>>>"))


def truthy(text: Column | str) -> Column:
    """Does a JSON field's text (as get_json_object gives it) stand for something other than nothing, false or zero?"""
    c = _col(text)
    return F.coalesce(~c.isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))
