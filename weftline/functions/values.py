"""Numeric, verdict and JSON expressions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip, strip_fence

RIGHT, WRONG, PARTLY, UNKNOWN = "正确", "错误", "部分正确", "未知"


def lenient_number(c: Column | str) -> Column:
    """A number from text with thousands commas or a percent sign; null where there is none."""
    return F.regexp_replace(strip(_col(c).cast("string")), "[,%]", "").try_cast("double")


def lenient_int(c: Column | str) -> Column:
    x = lenient_number(c)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def ratio(raw: Column | str, count: Column | None = None, total: Column | None = None) -> Column:
    """A share, rounded to 6 places, of a cell: its first number (thousands commas aside), in hundredths where the cell has a percent sign or the number is above 1. An empty cell gives count / total, one without a number null."""
    cell = _col(raw).cast("string")
    x = F.nullif(F.regexp_extract(F.regexp_replace(cell, ",", ""), r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    found = F.when(F.contains(cell, F.lit("%")) | (x > 1 + 1e-9), x / 100).otherwise(x)
    empty = cell.isNull() | (cell == "")
    spare = safe_div(count.cast("double"), total.cast("double")) if count is not None and total is not None else F.lit(None).cast("double")
    return F.round(F.when(empty, spare).otherwise(found), 6)


def cell_text(c: Column | str) -> Column:
    """A cell as text: a whole number without its point, nothing for NaN."""
    text = strip(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(text == "NaN", "").otherwise(F.regexp_replace(text, r"^(-?[0-9]+)\.0$", "$1"))


def score_0_to_3(c: Column | str) -> Column:
    """Half-even rounding, held within 0 and 3."""
    x = lenient_number(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(3), F.bround(x, 0).cast("int"))))


def verdict_of_score(score: Column | str) -> Column:
    s = _col(score)
    return F.when(s >= 2, RIGHT).when(s == 1, PARTLY).when(s == 0, WRONG)


#: What a judge's answer may contain, as it is written, and words that it may consist of in any case.
THREE = {PARTLY: (["部分正确", "部分对", "不完全", "partial"], []), WRONG: (["不正确", "全部错误", "完全错误", "错误", "wrong", "incorrect"], []), RIGHT: (["全部正确", "完全正确", "正确", "correct", "right"], ["true", "yes"])}
TWO = {WRONG: ["不正确", "全部错误", "完全错误", "错误", "错", "wrong", "incorrect", "false", "no"], RIGHT: ["全部正确", "完全正确", "正确", "对", "correct", "right", "true", "yes"]}


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def verdict(text: Column | str, three: bool = True, score: Column | None = None) -> Column:
    """The verdict that a free answer names, else null (or, of three labels, what the score says). An answer that is a label is that label; otherwise partly comes before wrong, and wrong before right."""
    s = strip(_col(text).cast("string"))
    low = F.lower(s)
    if not three:
        found = F.when(s.isin(*TWO), s)
        for label, words in TWO.items():
            found = found.when(low.isin(words) | _any(s, words), label)
        return found
    found = F.when(s.isin(*THREE), s)
    for label, (parts, wholes) in THREE.items():
        found = found.when(_any(s, parts) | low.isin(wholes), label)
    return found if score is None else F.coalesce(found, verdict_of_score(score))


def judge_order(key: Column | str) -> Column:
    """True where the two systems swap places: the low bit of the first byte of the key's MD5."""
    return F.conv(F.substring(F.md5(_col(key).cast("string").cast("binary")), 1, 2), 16, 10).cast("int") % 2 == 1


def higher(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(a > b, name_a).when(b > a, name_b).otherwise("tie")


def similarity(squared: Column) -> Column:
    """The score of a squared L2 distance: 1 - d^2 / 2 within 0 and 1, d itself being the squared distance."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - squared * squared / 2))


def json_object(text: Column | str) -> Column:
    """The JSON object in an answer: from the first brace to the last, without fences."""
    return F.nullif(F.regexp_extract(_col(text), r"(?s)(\{.*\})", 1), F.lit(""))


def entities(text: Column | str) -> Column:
    """array<struct<name, content>> of an extraction: {"entities": {...}}, a list of such objects, or an object of strings.

    Null where the answer isn't JSON of such a shape, a list is empty, or a description isn't a string; then it is asked for
    again. Entities come in the order of their names, item by item.
    """
    v = F.try_parse_json(strip_fence(text))
    shape = F.schema_of_variant(v)
    inner = lambda x: F.try_variant_get(x, "$.entities", "variant")
    maps = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "map<string,variant>"))
    bare = maps(v)
    of_object = F.when(F.map_contains_key(bare, "entities"), F.array(maps(inner(v)))).when(F.size(bare) > 0, F.array(bare))
    found = F.when(shape.startswith("OBJECT"), of_object).when(shape.startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: maps(inner(x))))
    strings = F.forall(found, lambda m: m.isNotNull() & F.forall(F.map_values(m), lambda x: F.schema_of_variant(x) == "STRING"))
    pairs = F.flatten(F.transform(found, lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("content")))))
    return F.when(strings & (F.size(found) > 0), pairs)
