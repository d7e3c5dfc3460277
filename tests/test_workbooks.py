import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store
from tidemark.sources import workbooks as W

ODD = ["", " ", "a & <b> \"c\" 'd'", "_x0041_", "__x000D__", "a\r\nb\tc\rd", "\x00\x01\x1f￾￿", "𝄞" * 5, "ß ﬁ Å", "_x005F_x0041_", "_x0041\x00", "]]>"]


def test_cells_hold_every_text():
    for t in ODD:
        cell = W.cell_xml(0, 1, t)
        node = W.ElementTree.fromstring(cell.replace("<c ", f'<c xmlns="{W.MAIN}" '))
        assert W._string(node.find(W._tag("is"))) == t


def test_column_names():
    for i in [0, 25, 26, 51, 701, 702, 16383]:
        assert W.column_at(W.column_name(i) + "7") == i
    assert W.column_name(16383) == "XFD"


def test_dates_by_number():
    assert W.serial(dt.date(2026, 1, 2)) == 46024
    assert W.serial_text(46024.0) == "2026-01-02"
    assert W.serial_text(61.0) == "1900-03-01" and W.serial_text(1.0) == "1900-01-01"
    assert W.serial_text(46024.5) == "2026-01-02 12:00:00"
    assert W.serial_text(0.75) == "18:00:00"
    assert W.serial_text(0.0, True) == "1904-01-01"


def test_round_trip_of_types_and_texts(spark, tmp_path):
    rows = [(i, t, 1.5 * i, dt.date(1899, 1, 1) + dt.timedelta(400 * i), i % 2 == 0) for i, t in enumerate(ODD)]
    rows.append((2**60, None, None, None, None))
    df = spark.createDataFrame(rows, "id long, t string, x double, d date, b boolean").repartition(3)
    path = f"{tmp_path}/books"
    W.write_workbooks(df, path, "A & B")
    back = W.read_workbooks(spark, path, df.columns, "A & B", strip=False)
    got = {r.id: (r.t, r.x and float(r.x), r.d, r.b) for r in back.collect()}
    assert got == {str(i): (t, x, d and d.isoformat(), None if b is None else str(b).lower()) for i, t, x, d, b in rows}


@pytest.mark.parametrize("limit", [3, 5])
def test_long_texts_go_on_in_rows_without_a_key(spark, tmp_path, limit):
    texts = ["", "abc", "𝄞𝄞𝄞𝄞x", "abcdefghijk", None, "\r" * 11]
    df = spark.createDataFrame([(i, f"u{i}", t, t and t[::-1]) for i, t in enumerate(texts)], "k long, u string, t string, v string").repartition(2)
    cut = W.split_texts(df, "k", ("t", "v"), limit)
    assert cut.filter(F.length("t") > limit).isEmpty()
    path = f"{tmp_path}/books"
    W.write_workbooks(cut, path, key="k", rows=2)  # records are never parted by the end of a workbook
    assert len(W.committed(path)) > 2
    back = W.read_workbooks(spark, path, df.columns, strip=False, key="k", texts=("t", "v"))
    assert sorted(map(tuple, back.drop("path", "row").collect())) == sorted((str(i), f"u{i}", t, t and t[::-1]) for i, t in enumerate(texts))


def test_a_long_cell_is_refused_and_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/books"
    with pytest.raises(Exception, match="longer than"):
        W.write_workbooks(spark.createDataFrame([("x" * 40_000,)], "t string"), path)
    assert W.committed(path) == []
    with pytest.raises(Exception, match="k is null"):
        W.split_texts(spark.createDataFrame([(None, "a")], "k long, t string"), "k", ("t",)).collect()


def test_written_once_or_overwritten(spark, tmp_path):
    path = f"{tmp_path}/books"
    one, two = spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([("b",)], "t string")
    W.write_workbooks(one, path)
    with pytest.raises(FileExistsError):
        W.write_workbooks(two, path)
    assert [r.t for r in W.read_workbooks(spark, path, ["t"]).collect()] == ["a"]
    W.write_workbooks(two, path, overwrite=True)
    assert [r.t for r in W.read_workbooks(spark, path, ["t"]).collect()] == ["b"]
    assert len([n for n in store.listed(path) if n.endswith(".xlsx")]) == 1
    W.write_workbooks(one.limit(0), f"{tmp_path}/none")
    assert W.read_workbooks(spark, f"{tmp_path}/none", ["t"]).count() == 0


def foreign(sheet: str, shared: str = "", styles: str = "", settings: str = "") -> bytes:
    """A workbook as other programs write them: shared strings, styles, cells without names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.LINKS}">{settings}<sheets><sheet name="Notes" sheetId="1" r:id="a"/><sheet name="Review" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{W.PACKAGE}/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{W.MAIN}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{W.MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{W.MAIN}">{shared}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{W.MAIN}">{styles}</styleSheet>')
    return out.getvalue()


HEADER = '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'
SHARED = "<si><t>host</t></si><si><r><t>da</t></r><r><t>te</t></r><rPh><t>no</t></rPh></si><si><t> x.de </t></si>"
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def read(spark, tmp_path, data):
    path = f"{tmp_path}/given.xlsx"
    store.write_bytes(path, data)
    return [tuple(r)[1:] for r in W.read_workbooks(spark, path, ["host", "date"], "Review").collect()]


def test_workbooks_of_other_programs(spark, tmp_path):
    rows = '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>46024</v></c></row><row r="3"><c r="A3" t="str"><v> </v></c></row><row r="5"><c r="B5" s="2"><v>7</v></c></row><row r="6"><c r="A6" t="e"><v>#N/A</v></c><c r="B6"><f>1/4</f><v>0.25</v></c></row>'
    got = read(spark, tmp_path, foreign(HEADER + rows, SHARED, STYLES))
    assert got == [(2, "x.de", "2026-01-02"), (5, None, "7"), (6, "#N/A", "0.25")]
    row = '<row r="2"><c r="B2" s="1"><v>1</v></c></row>'
    assert read(spark, tmp_path, foreign(HEADER + row, SHARED, STYLES, '<workbookPr date1904="1"/>')) == [(2, None, "1904-01-02")]


@pytest.mark.parametrize("sheet,error", [
    ('<row><c t="s"><v>0</v></c></row>', "row 1 must be"),
    ('<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c></row>', "row 1 must be"),
    (HEADER + '<row r="2"><c r="D2"><v>1</v></c></row>', "beyond column B"),
    ("<row>", "given.xlsx"),
])
def test_other_sheets_are_refused(spark, tmp_path, sheet, error):
    with pytest.raises(Exception, match=error):
        read(spark, tmp_path, foreign(sheet, SHARED))


def test_what_is_no_workbook_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="given.xlsx"):
        read(spark, tmp_path, b"no zip")
    with pytest.raises(Exception, match="no worksheet"):
        store.write_bytes(f"{tmp_path}/b.xlsx", foreign(HEADER, SHARED))
        W.read_workbooks(spark, f"{tmp_path}/b.xlsx", ["host"], "Other").collect()


def test_continuation_rows_carry_texts_only():
    rows = lambda *cells: iter([(1, {0: "k", 1: "t", 2: "n"}), *[(i + 2, c) for i, c in enumerate(cells)]])
    read = lambda *cells: list(W.records(rows(*cells), ["k", "t", "n"], False, "k", ["t"]))
    assert read({0: "1", 1: "a", 2: "5"}, {1: "b"}, {}, {0: "2"}) == [[2, "1", "ab", "5"], [5, "2", None, None]]
    for bad in ([{1: "b"}], [{0: "1"}, {1: "b", 2: "5"}]):
        with pytest.raises(W.WorkbookRefused):
            read(*bad)
