"""Workbooks: what is written is read back; what other programs write is read."""

import datetime
import io
import zipfile

import pytest

from forgeframe.sources import excel, files

MAIN, OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def foreign(rows, shared, styles='<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/>', first=""):
    """A workbook as other programs write it: shared strings, two sheets, own formats."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">{first}<sheets><sheet name="Data" sheetId="3" r:id="rId7"/><sheet name="More" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs>{styles}</cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row><row><c><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_a_foreign_workbook(spark, tmp_path):
    shared = "<si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si><si><t>x &amp; ü</t></si><si><t>name</t></si>"
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="str"><v>n</v></c><c r="D2" t="s"><v>3</v></c><c r="E2" t="inlineStr"><is><t>when</t></is></c><c r="F2" t="str"><v>f</v></c><c r="G2" t="str"><v>flag</v></c></row><row r="3"/>'
        '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>12</v></c><c r="C4" s="3"><v>2.5</v></c><c r="D4" t="e"><v>#DIV/0!</v></c><c r="E4" s="1"><v>45000</v></c><c r="F4"><f>1/2</f><v>0.5</v></c><c r="G4" t="b"><v>1</v></c></row>'
        '<row r="9"><c r="A9" t="s"><v>2</v></c><c r="B9"><v>-3</v></c><c r="E9" s="2"><v>45000.75</v></c><c r="F9"><v>1E-3</v></c><c r="G9" t="b"><v>0</v></c><c r="H9"><v>9</v></c></row>'
    )
    (tmp_path / "a.xlsx").write_bytes(foreign(rows, shared))
    df = excel.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert df.dtypes == [("name", "string"), ("n", "bigint"), ("Unnamed: 2", "double"), ("name.1", "string"), ("when", "timestamp_ntz"), ("f", "double"), ("flag", "boolean"), ("Unnamed: 7", "bigint")]
    day = datetime.datetime(2023, 3, 15)
    assert [tuple(r) for r in df.collect()] == [("rich text", 12, 2.5, None, day, 0.5, True, None), ("x & ü", -3, None, None, day + datetime.timedelta(hours=18), 0.001, False, 9)]
    assert [tuple(r) for r in excel.read_excel(spark, str(tmp_path / "a.xlsx"), "More").collect()] == [(7,)]
    with pytest.raises(Exception, match="no sheet 'Gone'; there are Data, More"):
        excel.read_excel(spark, str(tmp_path / "a.xlsx"), "Gone").collect()
    (tmp_path / "b.xlsx").write_bytes(foreign('<row><c s="1"><v>1</v></c></row><row><c s="1"><v>1</v></c></row>', "", first='<workbookPr date1904="1"/>'))
    assert excel.read_excel(spark, str(tmp_path / "b.xlsx")).first()[0] == datetime.datetime(1904, 1, 2)
    (tmp_path / "c.xlsx").write_bytes(foreign("", ""))
    assert excel.read_excel(spark, str(tmp_path / "c.xlsx")).collect() == []


def test_round_trip(spark, tmp_path, monkeypatch):
    d, t = datetime.date(2024, 2, 29), datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [(1, "a <b> & \"c\" ü\n x ", 0.1, True, d, t, [1, 2], 1 << 60), (2, None, None, False, None, None, None, 5), (3, "  ", 1e300, None, datetime.date(1900, 3, 1), datetime.datetime(1999, 12, 31), [], -(1 << 53)), (4, "x\x01y", float("nan"), True, d, t, [3], 0)]
    df = spark.createDataFrame(rows, "i int, s string, x double, b boolean, d date, t timestamp_ntz, a array<int>, big long").repartition(3)
    excel.write_excel(df, str(tmp_path / "out"))
    back = excel.read_excel(spark, str(tmp_path / "out"))
    got = {r.i: tuple(r)[1:] for r in back.collect() if r.i is not None}
    midnight = lambda v: datetime.datetime(v.year, v.month, v.day)
    assert got[1] == ("a <b> & \"c\" ü\n x ", 0.1, True, midnight(d), t, "[1,2]", str(1 << 60)) and got[2] == (None, None, False, None, None, None, "5")
    assert got[3][:3] == ("  ", 1e300, None) and got[4][0] == "xy" and got[4][1] is None
    assert len(got) == 4


def test_many_rows_and_loading(spark, tmp_path, monkeypatch):
    df = spark.range(250).selectExpr("id", "id * 0.5D AS half", "concat('t', id) AS text")
    names, content = df.columns, [list(r) for r in df.collect()]
    (tmp_path / "one.xlsx").write_bytes(excel.workbook(names, content))
    assert files.load(spark, str(tmp_path / "one.xlsx")).orderBy("id").collect() == df.withColumn("half", df.half.cast("double")).collect()
    excel.write_excel(spark.range(0).selectExpr("id"), str(tmp_path / "none"))
    assert excel.read_excel(spark, str(tmp_path / "none")).columns == ["id"]
    assert excel._name(0) == "A" and excel._name(27) == "AB" and excel._column("AB12") == 27 and excel._column("XFD1") == 16383
