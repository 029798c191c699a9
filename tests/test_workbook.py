"""The two labellers' workbook: real .xlsx files in, the rows of the CSV sheets out."""

import zipfile

from pyspark.sql import functions as F

from siteval.constants import SITES
from siteval.sources import readers, workbook

HEAD = [workbook.HEADERS[c] for c in workbook.HEADERS]
OTHER = {"LUE": "RUE", "RUE": "LUE", "LLE": "RLE", "RLE": "LLE"}


def row(n, usable, classes, url="u & <v>"):
    return [n, usable, "full body", "sure", url, *(v for s in SITES for v in (classes.get(s), "x"))]


A = [HEAD, row(1, "yes", {"LUE": "wound", "RUE": "no_injury", "LLE": "unsure", "RLE": "amputation"}), row(2, "yes", dict.fromkeys(SITES, "wound")), row(3, "no", dict.fromkeys(SITES, "wound")),
     [None] * 5, row(4, "yes", {"LUE": "no_injury"})]
B = [HEAD, row(1, "yes", {"LUE": "no_injury", "RUE": "wound", "LLE": "unsure", "RLE": "amputation"}), row(2, "yes", dict.fromkeys(SITES, "amputation")), row(3, "yes", dict.fromkeys(SITES, "wound"))]


def written(tmp_path, name="labels.xlsx", sheets=None):
    (tmp_path / name).write_bytes(workbook.workbook_bytes(sheets or {"Notes": [["x"]], "Labels_A": A, "Labels_B": B}))
    return str(tmp_path)


def test_workbook_gives_the_rows_of_the_csv_pair(spark, tmp_path):
    (tmp_path / "x").mkdir()
    agreed, summary = workbook.read_workbook_labels(spark, written(tmp_path / "x"))
    for name, rows in (("a", A), ("b", B)):
        kept = [r for r in rows[1:] if r[0] is not None]
        spark.createDataFrame(kept, ", ".join(f"`{c}` {'int' if c == 'n' else 'string'}" for c in workbook.HEADERS)).select(*[F.col(c) for c in readers.S.READER_SHEET.replace(" int", "").replace(" string", "").split(", ")]) \
            .coalesce(1).write.option("header", True).csv(str(tmp_path / name))
    want = readers.read_labels_two_reader(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(map(str, agreed.collect())) == sorted(map(str, want.collect()))
    assert {(r.photo, r.site): r["class"] for r in agreed.collect() if r["class"]} == {(1, "RLE"): "amputation"}
    got = {r.photo: (r.usable, r.kept, r.disagree, r.swap_only) for r in summary.collect()}
    assert got == {1: (True, 1, 2, 1), 2: (True, 0, 4, 0), 3: (False, 0, 0, 0), 4: (False, 0, 0, 0)}


def test_cells_of_every_kind(spark, tmp_path):
    path = tmp_path / "kinds.xlsx"
    path.write_bytes(workbook.workbook_bytes({"S": [["#", "v"], [1, "a"], [2.0, "b"]]}))
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    cells = ('<row r="4"><c r="B4" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row><row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="str"><v>formula</v></c></row>'
             '<row r="6"><c t="e"><v>#N/A</v></c><c><v>2.5</v></c><c r="AB6"><v>9</v></c></row><row r="7"/>')
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"</sheetData>", cells.encode() + b"</sheetData>")
    with zipfile.ZipFile(path, "w") as z:
        for n, v in parts.items():
            z.writestr(n, v)
    rows = workbook.read_workbook(spark, str(tmp_path), "S", {"n": "#", "v": "v", "none": "absent"}).orderBy("row").collect()
    assert [(r.row, r.n, r.v, r.none) for r in rows] == [(1, "1", "a", None), (2, "2", "b", None), (3, None, "inline", None), (4, "true", "formula", None), (5, None, "2.5", None)]


def test_damaged_and_foreign_files_are_named(spark, tmp_path):
    written(tmp_path)
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 not a workbook")
    with zipfile.ZipFile(tmp_path / "other.xlsx", "w") as z:
        z.writestr("readme.txt", "x")
    found = {r.file.rsplit("/", 1)[1]: r.problem for r in workbook.quarantined(spark, str(tmp_path)).collect()}
    assert set(found) == {"broken.xlsx", "other.xlsx"} and found["broken.xlsx"].startswith("BadZipFile")
    assert workbook.read_labeller(spark, str(tmp_path), "Labels_A").select("photo").distinct().count() == 4
    assert workbook.read_labeller(spark, str(tmp_path), "No such sheet").count() == 0
