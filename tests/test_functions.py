from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import values as V


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


def test_sentences(spark):
    assert one(spark, X.sentences, "One. Two!  15.2 kg\r\n\nNo? 是。好") == ["One.", "Two!", "15.", "2 kg", "No?", "是。", "好"]
    assert one(spark, X.sentences, " 　\n") == []


def test_join_units(spark):
    assert one(spark, lambda c: X.join_units(F.split(c, ",")), "a,b,。,c,d.,e") == "a b。c d.e"


def test_names(spark):
    assert [one(spark, X.family_base, n) for n in ("foo.pdf_1", "foo_1", "a.b.pdf_12", "foo.pdf")] == ["foo.pdf", "foo_1", "a.b.pdf", "foo.pdf"]
    assert [one(spark, X.slice_index, n) for n in ("foo.pdf_7", "foo.PDF_2", "foo.txt_3", "foo")] == [7, 2, 0, 0]
    assert one(spark, X.normalize_filename, "/a/B/File.PDF ") == "file.pdf"
    assert one(spark, X.object_key, "https://h.example//a/b.pdf?x=1") == "a/b.pdf?x=1"
    assert one(spark, X.file_name, "a/b:c.pdf?x=1#y") == "b_c.pdf"
    assert one(spark, X.file_name, "a/") is None


def test_answers(spark):
    assert one(spark, X.strip_fence, "```json\n{}\n```") == "{}"
    assert one(spark, X.strip_think, "<think>x\ny</think>\n z ") == "z"
    assert one(spark, X.answer_section, "Thought: a\nAnswer: b\nAnswer: c ") == "c"
    assert one(spark, X.split_list, "a；b; c、|d/") == ["a", "b", "c", "d"]
    assert [one(spark, X.question_id, q) for q in ("7", "Q12", "abc")] == ["Q0007", "Q0012", "abc"]
    assert one(spark, lambda c: X.truncate(c, 30), "x" * 40) == "x" * 10 + "...[truncated]"


def test_numbers(spark):
    assert [one(spark, V.lenient_int, s) for s in ("1,234.9", "-2.7", "30%", "x")] == [1234, -2, 30, None]
    assert [one(spark, V.score_0_to_3, s) for s in ("2.5", "1.5", "9", "-1", "?")] == [2, 2, 3, 0, None]
    assert [one(spark, lambda c: V.ratio(c, F.lit(1), F.lit(4)), s) for s in ("0.294", "29.4", "29.4%", None)] == [0.294, 0.294, 0.294, 0.25]


def test_verdicts(spark):
    assert [one(spark, V.verdict, s) for s in ("partially right", "incorrect", "correct!", "Correct!", "正确", "YES", "?")] == [V.PARTLY, V.WRONG, V.RIGHT, None, V.RIGHT, V.RIGHT, None]
    assert one(spark, lambda c: V.verdict(c, three=False), "partially right") == V.RIGHT


def test_entities(spark):
    got = one(spark, V.entities, '```json\n{"a": "1", "b": "", "c": "x: 2"}\n```')
    assert [(r.name, r.content) for r in got] == [("a", "1"), ("b", ""), ("c", "x: 2")]
    got = one(spark, V.entities, '[{"entities": {"a": "1"}, "knowledge": 2}, {"entities": {"a": "2"}}]')
    assert [(r.name, r.content) for r in got] == [("a", "1"), ("a", "2")]
    assert one(spark, V.entities, '{"entities": {}}') == []
    assert [one(spark, V.entities, t) for t in ("{}", "[]", "[1]", '[{"a": "1"}]', '{"entities": {"a": 1}}', "text {", 'text {"a": "1"}')] == [None] * 7
    assert one(spark, V.entities, '{"a": 1}') is None
