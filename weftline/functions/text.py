"""String expressions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x01"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space; trim() takes spaces only."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def sentences(text: Column | str) -> Column:
    """array<string>: a unit ends after 。！？.!? with the white space that follows, or at a line break; decimals split too."""
    lines = F.regexp_replace(_col(text), r"\r\n?", "\n")
    marked = F.regexp_replace(lines, r"(?U)([。！？.!?])\s*", "$1" + _MARK)
    return F.filter(F.transform(F.split(marked, f"{_MARK}|\n+"), strip), lambda u: u != "")


def join_units(units: Column | str) -> Column:
    """Concatenate; a space goes only between two ASCII letters or digits."""
    edge = "[A-Za-z0-9]"
    return F.aggregate(_col(units), F.lit(""), lambda acc, u: F.concat(acc, F.when(acc.rlike(edge + "$") & u.rlike("^" + edge), " ").otherwise(""), u))


def family_base(name: Column | str) -> Column:
    """foo.pdf_1 -> foo.pdf; a name whose `_N` doesn't follow an extension stays."""
    return F.regexp_replace(_col(name), r"^(.*\.[A-Za-z0-9]+)_[0-9]+$", "$1")


def slice_name(base: Column | str, index: Column) -> Column:
    return F.when(index >= 1, F.concat(_col(base), F.lit("_"), index.cast("string"))).otherwise(_col(base))


def slice_index(name: Column | str) -> Column:
    """N of a name that ends in .pdf_N (any case), else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_col(name), r"(?i)\.pdf_([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(_col(path), r"\\", "/"), "/", -1)


def normalize_filename(path: Column | str) -> Column:
    return F.lower(strip(base_name(path)))


def object_key(url: Column | str) -> Column:
    """A URL without scheme, host and leading slashes."""
    return F.regexp_replace(F.regexp_replace(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"^/+", "")


def file_name(key: Column | str) -> Column:
    """The key's last part without query or fragment, illegal characters as `_`; null where nothing is left."""
    last = F.substring_index(F.regexp_replace(_col(key), r"[?#].*$", ""), "/", -1)
    return F.nullif(F.regexp_replace(last, r'[\\/:*?"<>|]', "_"), F.lit(""))


def strip_fence(text: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(_col(text)), r"^```[A-Za-z0-9_-]*[ \t]*\n?", ""), r"\n?```$", ""))


def strip_think(text: Column | str) -> Column:
    return strip(F.regexp_replace(_col(text), r"(?s)^\s*<think>.*?</think>", ""))


def first_line(text: Column | str) -> Column:
    return strip(F.substring_index(strip(_col(text)), "\n", 1))


def split_list(text: Column | str) -> Column:
    """Parts between ；;、|/ without blanks."""
    return F.filter(F.transform(F.split(_col(text), "[；;、|/]"), strip), lambda x: x != "")


def truncate(text: Column | str, limit: int, mark: str = "...[truncated]") -> Column:
    c = _col(text)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit - 20), r"(?U)\s+$", ""), F.lit(mark)))


def folded(c: Column | str) -> Column:
    """Case folded as Unicode says, but for ligatures: ß is ss, a final sigma a sigma. lower() alone keeps both."""
    lower = F.lower(F.upper(_col(c)))
    return F.replace(F.replace(lower, F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))  # translate() goes character by character


def contains_folded(text: Column | str, word: Column) -> Column:
    """Case-insensitive containment; false on an empty text or word."""
    c = _col(text)
    return F.coalesce((c != "") & (word != "") & F.contains(folded(c), folded(word)), F.lit(False))


def with_instruction(query: Column | str, instruction: str) -> Column:
    c = _col(query)
    return F.when(c.startswith("Instruct:"), c).otherwise(F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), c))


#: Labels that an answer's parts begin with.
_ANSWER = r"(?iU)(?:^|\n)\s*(?:Answer|回答|结论)\s*[:：]\s*"
_THOUGHT = r"(?iU)^\s*(?:Thought|思考)\s*[:：]\s*"


def thought_and_answer(text: Column | str) -> Column:
    """struct<thought, answer>: the answer stands after the last label for one at the start of a line, the thought before it.

    Without such a label a text that begins with one for a thought is all thought, any other all answer.
    """
    c = strip(F.coalesce(_col(text), F.lit("")))
    after = F.element_at(F.split(c, _ANSWER, -1), -1)
    label = F.element_at(F.regexp_extract_all(c, F.lit(_ANSWER), F.lit(0)), -1)
    labelled = c.rlike(_ANSWER)
    before = strip(F.substring(c, F.lit(1), F.char_length(c) - F.char_length(after) - F.char_length(F.when(labelled, label).otherwise(""))))
    bare = lambda x: strip(F.regexp_replace(x, _THOUGHT, ""))
    thinks = c.rlike(_THOUGHT)
    thought = F.when(labelled, bare(before)).when(thinks, bare(c)).otherwise("")
    answer = F.when(labelled, strip(after)).when(thinks, "").otherwise(c)
    return F.struct(thought.alias("thought"), answer.alias("answer"))


def answer_section(text: Column | str) -> Column:
    return thought_and_answer(text)["answer"]


def error_kind(message: Column | str) -> Column:
    """An error message with its changing parts replaced, at most 160 characters."""
    c = F.regexp_replace(_col(message), r"0x[0-9a-fA-F]+", "<hex>")
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[0-9]+", "<n>"), r"\s+", " "), 1, 160)


def error_fingerprint(message: Column | str, kind: Column) -> Column:
    """An error's type and its message with file names, attempts and page counts replaced, 160 characters of it at most."""
    c = F.coalesce(_col(message), F.lit(""))
    for pattern, put in ((r"(?iU)for\s+\S+\.pdf", "for <file>.pdf"), (r"(?iU)attempt\s+\d+\s*/\s*\d+", "attempt ?/?"), (r"(?U)pages=\d+", "pages=?"), (r"(?U)\s+", " ")):
        c = F.regexp_replace(c, pattern, put)
    return F.concat(kind, F.lit("|"), F.substring(strip(c), 1, 160))


def question_id(raw: Column | str, number: Column | None = None) -> Column:
    """Q and four digits at least for an id of digits, with or without a Q before them; any other id as it is; for none Q and the row's number."""
    c = strip(F.coalesce(_col(raw).cast("string"), F.lit("")))
    padded = lambda d: F.concat(F.lit("Q"), F.when(F.length(d) < 4, F.lpad(d, 4, "0")).otherwise(d))
    digits = F.regexp_replace(F.regexp_extract(c, "^[Qq]?([0-9]+)$", 1), "^0+(?=.)", "")
    blank = padded(number.cast("string")) if number is not None else c
    return F.when(c == "", blank).when(digits == "", c).otherwise(padded(digits))
