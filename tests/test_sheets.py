"""Workbooks as a data source, and question sheets."""

import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.sources import sheets


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(sheets.SheetSource)
    return lambda path: spark.read.format("sheets").load(str(path))


def workbook(path, parts, shared=()):
    """A workbook by hand: {sheet name: rows as XML}."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(f"""<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>""" for i, n in enumerate(parts))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>""" for i in range(len(parts)))}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')
        for i, rows in enumerate(parts.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


def test_cells_of_every_kind(source, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="A4"><v>5</v></c><c r="B4"><v>29.40</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="str"><v> f </v></c><c r="E4" t="inlineStr"><is><t> in </t></is></c><c r="AA4"><v>1E3</v></c></row><row><c><v>7</v></c></row>'
    workbook(tmp_path / "a.xlsx", {"one": rows, "two &amp; 3": ""}, ["<t>plain</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh>"])
    got = source(tmp_path).orderBy("row").collect()
    assert [(r.sheet, r.place, r.row) for r in got] == [("one", 0, 1), ("one", 0, 4), ("one", 0, 5)]
    assert got[0].cells == ["plain", "", "rich text"] and got[1].cells == ["5", "29.4", "true", "f", "in"] + [""] * 21 + ["1000"] and got[2].cells == ["7"]
    assert source(tmp_path / "none*.xlsx").count() == 0 and source(tmp_path / "a.xlsx").select("file").distinct().count() == 1


def test_what_is_written_is_read(spark, source, tmp_path):
    rows = [("s1", i, [f"{i}", "a<b>&\"c\"", None, "é\x01 x"]) for i in range(50)] + [("S1", 0, ["other"]), ("a/b*" + "c" * 40, 0, []), (None, 0, ["nameless"])]
    df = spark.createDataFrame(rows, "sheet string, row int, cells array<string>")
    df.coalesce(1).write.format("sheets").mode("append").save(str(tmp_path / "out"))
    got = source(tmp_path / "out")
    assert got.filter("sheet = 's1'").orderBy("row").select("cells").first().cells == ["0", 'a<b>&"c"', "", "é x"]
    assert {r.sheet: r["count"] for r in got.groupBy("sheet").count().collect()} == {"s1": 50, "S1_2": 1, "a_b_" + "c" * 27: 1, "Sheet": 1}


def sheet(spark, file, name, rows, place=0):
    return spark.createDataFrame([(file, name, place, i, r) for i, r in enumerate(rows, 1)], sheets.SCHEMA)


def test_questions_of_sheets_with_different_headers(spark):
    first = sheet(spark, "a", "测试集", [["序号", "问题文本", " 预期答案\n要点", "评分维度", "难度等级", "其它", "身份分类"], ["1", "q one ", "a1", "d1；d2", "hard", "", "x"], ["", "", "no question"], ["", "q two"], ["abc12", "q three", "", "", " "]])
    second = sheet(spark, "b", "x", [["ID", "Query", "问题", "ground_truth", "难度等级", "查询类型"], ["q7", "first", "second", "gt", "easy", "kind"]])
    third = sheet(spark, "c", "x", [["something"], ["else"]])
    got = {(r.file, r.id): r for r in sheets.question_rows(first.unionByName(second).unionByName(third)).collect()}
    assert set(got) == {("a", "Q0001"), ("a", "Q0003"), ("a", "abc12"), ("b", "Q0007")}
    r = got["a", "Q0001"]
    assert (r.kind, r.row, r.raw_id, r.question, r.expected_answer, r.score_dimensions, r.score_dimensions_raw, r.note) == ("set2", 2, "1", "q one", "a1", ["d1", "d2"], "d1；d2", "")
    assert list(r.categories.items()) == [("身份分类", "x"), ("难度等级", "hard"), ("其它", "NA")]
    assert got["a", "abc12"].categories == {"难度等级": "NA"} and got["a", "Q0003"].categories == {}
    r = got["b", "Q0007"]
    assert (r.kind, r.question, r.expected_answer, r.categories) == ("generic", "first", "gt", {"Query": "first", "难度等级": "easy", "查询类型": "kind"})  # fields are found whatever their case, categories left out by their exact names


def test_kinds_and_the_order_of_categories(spark):
    rows = sheet(spark, "a", "s", [["题号", "问题描述", "应用场景", "知识层", "新", "难度等级"], ["1", "q", "1", "2", "3", "4"]])
    r = sheets.sheet_schemas(rows).first()
    assert (r.kind, r.categories, r.at_id, r.at_question, r.at_note) == ("set1", ["难度等级", "知识层", "应用场景", "新"], 0, 1, None)


@pytest.mark.parametrize(
    ("names", "given", "want"),
    [
        (["统计概览", "测试集A", "设计说明"], {}, ("测试集A", "统计概览", "设计说明")), (["Stats", "data", "Design notes"], {}, ("data", "Stats", "Design notes")), (["stats"], {}, ("stats", None, None)),
        (["a", "b"], {"questions": "B"}, ("b", None, None)), (["测试集统计", "统计"], {}, ("测试集统计", "统计", None)), (["a"], {"questions": "zz"}, (None, None, None)), (["x", "questions", "Questions"], {"questions": "Questions"}, ("Questions", None, None)),
    ],
)
def test_sheet_roles(spark, names, given, want):
    df = spark.createDataFrame([("f", n, i) for i, n in enumerate(names)], "file string, sheet string, place int")
    r = sheets.sheet_roles(df, **given).first()
    assert (r.questions, r.stats, r.design) == want
