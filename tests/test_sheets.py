import zipfile

from quartzfolio.sources import sheets

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, strings, rows, extra=""):
    """A small workbook: two sheets, shared strings and one date style."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet><sheetData>{extra}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"/><c r="AA1" t="inlineStr"><is><t>Flag</t></is></c></row><row r="2"/>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3" s="1"><v>45292</v></c><c r="C3"><v>7.5</v></c><c r="AA3" t="b"><v>1</v></c></row>'
    )
    workbook(tmp_path / "a.xlsx", ["Nome", "Start", "Anvil &amp; co"], rows, '<row r="2"><c r="B2" t="inlineStr"><is><t>Head</t></is></c></row><row r="4"><c r="B4"><v>3</v></c></row>')
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    c = sheets.read_cells(spark, str(tmp_path))
    got = {(r["sheet"], r["row"], r["col"]): r["text"] for r in c.collect()}
    assert got == {("One", 0, 0): "Nome", ("One", 0, 1): "Start", ("One", 0, 26): "Flag", ("One", 2, 0): "Anvil & co", ("One", 2, 1): "2024-01-01", ("One", 2, 2): "7.5", ("One", 2, 26): "true", ("Two", 1, 1): "Head", ("Two", 3, 1): "3"}
    rows = {(r["sheet"], r["row"]): r["fields"] for r in sheets.sheet_rows(c).collect()}
    assert rows == {("One", 2): {"Nome": "Anvil & co", "Start": "2024-01-01", "Column_3": "7.5", "Flag": "true"}, ("Two", 3): {"Head": "3"}}


def test_repeated_headers_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([("p", "s", 0, 0, "A"), ("p", "s", 0, 1, "A"), ("p", "s", 1, 0, "x"), ("p", "s", 1, 1, "y")], sheets.CELLS)
    assert [r["fields"] for r in sheets.sheet_rows(df).collect()] == [{"A": "x"}]
    assert sheets.sheet_rows(df.limit(0)).count() == 0
