"""Workbooks as a data source: every sheet is a partition whose rows stream; and question sheets as rows.

    spark.dataSource.register(SheetSource)
    spark.read.format("sheets").load("folder/*.xlsx")          file, sheet, place, row, cells
    rows.write.format("sheets").mode("append").save("folder")  a workbook for each task: sheet, row, cells

Paths are those of pyarrow.fs (local, hdfs://, s3:// ...). A cell is a text: whole numbers without a point, true and false, empty
where there is nothing; a date is the number that the workbook holds.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import question_id, split_list, strip

SCHEMA = "file string, sheet string, place int, row int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MOST_ROWS = 1_048_576


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _found(path: str) -> list[str]:
    """The workbooks at a path: a file, all of a folder, or those of a pattern in a folder's names."""
    from pyarrow import fs

    store, inner = _store(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if any(c in inner for c in "*?["):
        infos = store.get_file_info(fs.FileSelector(posixpath.dirname(inner)))
        names = [i.path for i in infos if fnmatch.fnmatch(posixpath.basename(i.path), posixpath.basename(inner))]
    else:
        info = store.get_file_info(inner)
        names = [inner] if info.is_file else [i.path for i in store.get_file_info(fs.FileSelector(inner)) if i.path.lower().endswith((".xlsx", ".xlsm"))]
    return sorted(head + n for n in names)


def _number(text: str) -> str:
    """A number as cells show it: whole ones without a point."""
    try:
        x = float(text)
    except ValueError:
        return text.strip()
    return "" if x != x else str(int(x)) if x.is_integer() else repr(x)


class Workbook:
    """Sheets and rows of an open .xlsx file."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in book.iter(f"{_MAIN}sheet")}
        self._shared: list[str] | None = None

    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                for _, e in ElementTree.iterparse(self.zip.open("xl/sharedStrings.xml")):
                    if e.tag == f"{_MAIN}si":
                        self._shared.append(_plain(e))
                        e.clear()
        return self._shared

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str]]]:
        """Row number and cells of each row that the sheet holds, one at a time."""
        target = self.sheets[sheet]
        n = 0
        for _, e in ElementTree.iterparse(self.zip.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}")):
            if e.tag != f"{_MAIN}row":
                continue
            n = int(e.get("r", n + 1))
            cells: list[str] = []
            for c in e.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells)) + [self._cell(c)]
            yield n, cells
            e.clear()

    def _cell(self, c: ElementTree.Element) -> str:
        kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v") or ""
        if kind == "s":
            return self.shared()[int(v)].strip() if v else ""
        if kind == "inlineStr":
            return _plain(c).strip()
        if kind == "b":
            return "true" if v == "1" else "false" if v else ""
        return _number(v) if kind == "n" else v.strip()


def _plain(e: ElementTree.Element) -> str:
    """An element's text without that of phonetic hints."""
    hints = {id(t) for h in e.iter(f"{_MAIN}rPh") for t in h.iter(f"{_MAIN}t")}
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t") if id(t) not in hints)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


@dataclass
class Sheet(InputPartition):
    file: str
    sheet: str
    place: int


class SheetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        out = []
        for name in _found(self.path):
            store, inner = _store(name)
            with store.open_input_file(inner) as f:
                out += [Sheet(name, s, i) for i, s in enumerate(Workbook(f).sheets)]
        return out or [Sheet("", "", 0)]

    def read(self, part: Sheet) -> Iterator[tuple]:
        if part.file:
            store, inner = _store(part.file)
            with store.open_input_file(inner) as f:
                for n, cells in Workbook(f).rows(part.sheet):
                    yield part.file, part.sheet, part.place, n, cells


@dataclass
class Written(WriterCommitMessage):
    file: str | None


def sheet_name(name: str, taken: set[str]) -> str:
    """A name that a workbook can have: 31 characters at most, none of []:*?/\\, and told apart from those taken whatever its case."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name or "").strip("'")[:31] or "Sheet"
    out, n = base, 1
    while out.lower() in taken:
        n += 1
        out = f"{base[: 31 - len(str(n)) - 1]}_{n}"
    taken.add(out.lower())
    return out


class SheetWriter(DataSourceWriter):
    """A task's rows (sheet, row, cells, by those names) make a workbook, in the order in which they come."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.at = path, {c: columns.index(c) for c in ("sheet", "cells")}

    def write(self, rows: Iterator) -> Written:
        sheets: dict[str, list] = {}  # name -> (scratch file, rows)
        for r in rows:
            name = r[self.at["sheet"]] or ""
            open_ = sheets.setdefault(name, [])
            if not open_ or open_[-1][1] == MOST_ROWS:
                open_.append([tempfile.SpooledTemporaryFile(8_000_000), 0])
            part = open_[-1]
            part[1] += 1
            cells = "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_allowed(c))}</t></is></c>' for c in r[self.at["cells"]] or [])
            part[0].write(f'<row r="{part[1]}">{cells}</row>'.encode())
        if not sheets:
            return Written(None)
        store, inner = _store(f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}.xlsx")
        store.create_dir(posixpath.dirname(inner), recursive=True)
        taken: set[str] = set()
        parts = [(sheet_name(name, taken), f) for name, open_ in sheets.items() for f, _ in open_]
        with store.open_output_stream(inner) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(parts)))
            z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>')
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in range(len(parts)))}</Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="s{i}"/>""" for i, (n, _) in enumerate(parts))}</sheets></workbook>')
            for i, (_, held) in enumerate(parts):
                held.seek(0)
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                    sheet.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    while block := held.read(1 << 20):
                        sheet.write(block)
                    sheet.write(b"</sheetData></worksheet>")
        return Written(inner)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(m.file)


def _allowed(text: str) -> str:
    """Without the characters that XML has no place for."""
    return re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", str(text))


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        if overwrite:
            raise ValueError("sheets are appended to a folder; clear it first")
        return SheetWriter(self.options["path"], list(schema.names))


# what sheets hold

#: Header names of question sheets and the fields they stand for.
FIELDS = {
    "id": ["序号", "id", "题号"],
    "question": ["问题文本", "问题描述", "问题", "query"],
    "expected_answer": ["预期答案要点", "标准答案要点", "标准答案", "答案要点", "ground_truth"],
    "score_dimensions": ["评分维度", "评估要点", "评分要点"],
    "reasoning_path": ["参考推理链/解题路径", "预期检索路径", "推理链", "解题路径"],
    "knowledge_source": ["所需知识来源", "知识来源"],
    "note": ["业务场景备注", "备注", "场景备注"],
}
#: The headers that tell the two known kinds of sheet, and the categories that each prefers.
KINDS = {"set2": ["问题文本", "预期答案要点", "评分维度"], "set1": ["问题描述", "标准答案要点", "评估要点"]}
CATEGORIES = {
    "set2": ["身份分类", "难度等级", "能力维度", "问题层面", "推理跳数", "提问者身份", "所需知识来源"],
    "set1": ["难度等级", "查询类型", "问题维度", "推理跳数", "知识层", "材料类别", "产品类别", "应用场景"],
}
#: What the names of question, statistics and design sheets contain.
HINTS = {"questions": ["测试集", "测试问题", "问题集", "questions"], "stats": ["分布统计", "统计概览", "统计", "stats", "distribution"], "design": ["设计说明", "说明", "design"]}


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def sheet_roles(sheets: DataFrame, questions: str | None = None, stats: str | None = None, design: str | None = None) -> DataFrame:
    """file, questions, stats, design: which of a file's sheets (file, sheet, place) holds what.

    A given name is taken, whatever its case, else the first sheet whose name contains a hint. Where no name hints at questions,
    the first sheet that is neither statistics nor design holds them, or else the first; a sheet has one role.
    """
    named = sheets.groupBy("file").agg(F.transform(F.sort_array(F.collect_set(F.struct("place", "sheet"))), lambda s: s["sheet"]).alias("_all"))

    def pick(given: str | None, role: str, taken: list[Column]) -> Column:
        if given:
            return F.coalesce(F.get(F.filter("_all", lambda s: s == given), F.lit(0)), F.get(F.filter("_all", lambda s: F.lower(s) == given.lower()), F.lit(0)))
        hinted = lambda s: F.exists(_texts(HINTS[role]), lambda h: F.contains(F.lower(s), h))
        return F.get(F.filter("_all", lambda s: hinted(s) & ~F.array_contains(F.array_compact(F.array(*taken)) if taken else _texts([]), s)), F.lit(0))

    rows = named.withColumns({"_s": pick(None, "stats", []), "_d": pick(None, "design", [])})
    other = F.filter("_all", lambda s: ~F.array_contains(F.array_compact(F.array("_s", "_d")), s))
    rows = rows.withColumn("questions", F.coalesce(pick(questions, "questions", []), *([] if questions else [F.get(other, F.lit(0)), F.get("_all", F.lit(0))])))
    rows = rows.withColumn("stats", pick(stats, "stats", [F.col("questions")]))
    return rows.withColumn("design", pick(design, "design", [F.col("questions"), F.col("stats")])).select("file", "questions", "stats", "design")


def _header(c: Column) -> Column:
    return F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n")), F.lit(" "))


def sheet_schemas(rows: DataFrame) -> DataFrame:
    """file, sheet, kind (set1, set2 or generic), headers, categories, at_<field>: what a question sheet's first row says.

    Of several headers for a field the first counts, so do those that differ in case. Categories are the preferred ones of the
    kind, in their order, then all other headers that no field claims, in the sheet's.
    """
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row"))).filter("_n = 1")
    raw = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit(""))))
    heads = top.select("file", "sheet", raw.alias("headers"), F.transform(raw, _header).alias("_h"))
    kind = F.lit("generic")
    for name in ("set1", "set2"):
        kind = F.when(F.arrays_overlap("_h", _texts(KINDS[name])), name).otherwise(kind)
    low = F.transform("_h", F.lower)
    at = {f"at_{f}": F.get(F.filter(F.transform(low, lambda h, i: F.when(F.array_contains(_texts([a.lower() for a in names]), h), i)), lambda i: i.isNotNull()), F.lit(0)) for f, names in FIELDS.items()}
    known = _texts(sorted({a for names in FIELDS.values() for a in names} | {"ID"}))
    preferred = F.when(kind == "set2", _texts(CATEGORIES["set2"])).when(kind == "set1", _texts(CATEGORIES["set1"])).otherwise(_texts([]))
    first = F.filter(F.transform(preferred, lambda n: F.try_element_at(F.transform(F.filter(F.arrays_zip("headers", "_h"), lambda x: x["_h"] == n), lambda x: x["headers"]), F.lit(-1))), lambda h: h.isNotNull())
    rest = F.transform(F.filter(F.arrays_zip("headers", "_h"), lambda x: (x["_h"] != "") & ~F.array_contains(known, x["_h"])), lambda x: x["headers"])
    return heads.select("file", "sheet", kind.alias("kind"), "headers", F.array_union(first, rest).alias("categories"), *[c.alias(n) for n, c in at.items()])


def question_rows(rows: DataFrame) -> DataFrame:
    """file, sheet, kind, id, row, raw_id and the other FIELDS, score_dimensions_raw, categories of each question.

    rows: those of question sheets (file, sheet, row, cells), the first of each its header; every sheet is read by its own. Rows
    without a question go, a sheet without a question column has none; a blank category is NA, a blank id the row's number.
    """
    schemas = sheet_schemas(rows)
    joined = rows.join(schemas.select("file", "sheet", "kind", "headers", F.col("categories").alias("_cats"), *[f"at_{f}" for f in FIELDS]), ["file", "sheet"])
    joined = joined.withColumn("_n", F.min("row").over(Window.partitionBy("file", "sheet"))).filter("row > _n")
    cell = lambda i: strip(F.coalesce(F.get("cells", i), F.lit("")))
    field = lambda f: F.when(F.col(f"at_{f}").isNull(), "").otherwise(cell(F.col(f"at_{f}")))
    place = lambda h: F.size("headers") - F.array_position(F.reverse("headers"), h).cast("int")
    held = F.filter("_cats", lambda h: place(h) < F.size("cells"))
    categories = F.map_from_arrays(held, F.transform(held, lambda h: F.coalesce(F.nullif(cell(place(h)), F.lit("")), F.lit("NA"))))
    out = joined.withColumn("question", field("question")).filter("question <> ''")
    own = [f for f in FIELDS if f not in ("id", "question", "score_dimensions")]
    return out.select(
        "file", "sheet", "kind", question_id(field("id"), F.col("row") - F.col("_n")).alias("id"), "row", field("id").alias("raw_id"), "question", *[field(f).alias(f) for f in own],
        split_list(field("score_dimensions")).alias("score_dimensions"), field("score_dimensions").alias("score_dimensions_raw"), categories.alias("categories"),
    )
