import zipfile

import pytest
from pyspark.sql import functions as F

from cellweave.sources import records, workbook


def test_columns_have_letters():
    assert [workbook.letters_of(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.column_of(f"{workbook.letters_of(i)}7") == i for i in range(2000))


def test_written_rows_come_back(spark, tmp_path):
    rows = [("a.xlsx", "one", 1, ["x", None, " y & <z> "]), ("a.xlsx", "one", 4, ["é\n中", ""]), ("a.xlsx", "two \"q\"", 1, []), ("b.xlsx", "one", 1200, ["far"])]
    df = spark.createDataFrame(rows, workbook.SCHEMA)
    paths = workbook.write_workbooks(df, str(tmp_path))
    got = workbook.workbook_rows(spark, paths)
    assert got.rdd.getNumPartitions() == 3  # a sheet each
    found = [tuple(r) for r in got.orderBy("file", "sheet", "row").collect()]
    assert found[:5] == [("a.xlsx", "one", 1, ["x", None, " y & <z> "]), ("a.xlsx", "one", 2, []), ("a.xlsx", "one", 3, []), ("a.xlsx", "one", 4, ["é\n中", ""]), ("a.xlsx", "two \"q\"", 1, [])]
    assert len(found) == 1205 and found[-1][2:] == (1200, ["far"])
    assert workbook.workbook_rows(spark, []).count() == 0
    with pytest.raises(Exception, match="fit a sheet"):
        workbook.write_workbooks(df.withColumn("row", F.lit(0)), str(tmp_path))


def test_shared_strings_numbers_and_phonetic_hints(spark, tmp_path):
    path = str(tmp_path / "s.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbook.MAIN}" xmlns:r="{workbook.PARTS}"><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}/relationships"><Relationship Id="x" Type="t" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook.MAIN}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>hint</t></rPh></si></sst>')
        cells = '<c r="A2" t="s"><v>1</v></c><c r="C2"><v>4.5</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="str"><f>A1</f><v>made</v></c><c r="F2"/>'
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{workbook.MAIN}"><sheetData><row r="2">{cells}</row><row><c t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert [tuple(r)[2:] for r in workbook.workbook_rows(spark, [path]).orderBy("row").collect()] == [(1, []), (2, ["rich", None, "4.5", "TRUE", "made", None]), (3, ["plain"])]


def test_a_workbook_is_filled_like_a_sheet(spark, tmp_path):
    cells = [(2, ["S1", "a"]), (3, [None, "b"]), (60, ["S2", "over"])]
    df = spark.createDataFrame([("w.xlsx", "x", n, c) for n, c in cells], workbook.SCHEMA)
    rows = workbook.workbook_rows(spark, workbook.write_workbooks(df, str(tmp_path)))
    sheet = rows.select("sheet", "row", F.get("cells", F.lit(0)).alias("study"), F.get("cells", F.lit(1)).alias("v"))
    assert [tuple(r) for r in records.spreadsheet_records(sheet, "row", "study", ["v"]).orderBy("row").collect()] == [("x", 2, "S1", "a"), ("x", 3, "S1", "b")]
