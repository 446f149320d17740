import base64
import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions.order import Pages
from plumbline.sources import readers, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def encoded(content):
    return base64.b64encode(content).decode()


def test_a_workbook_comes_back(spark, tmp_path):
    moment = dt.datetime(2024, 3, 1, 12, 30)
    columns = ["id", "na me", "score", "ok", "at", "mixed", "none"]
    rows = [(1, "a<&>\"é ", 1.5, True, moment, 1, None), (2, None, 2, False, None, "x", None), (3, "  b", None, None, moment, 2.5, None)]
    content = workbook.workbook_bytes({"one": (columns, rows), "two & more": (columns, [(9, "z", 0.25, True, moment, "y", None)])})
    (tmp_path / "book.xlsx").write_bytes(content)
    df = readers.read_xlsx(spark, str(tmp_path / "book.xlsx"), dates=False)
    assert df.rdd.getNumPartitions() == 2
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "timestamp_ntz", "string"][: len(df.columns)]
    got = {r["id"]: tuple(r)[1:6] for r in df.collect()}
    assert got == {1: ("a<&>\"é ", 1.5, True, moment, "1"), 2: (None, 2.0, False, None, "x"), 3: ("  b", None, None, moment, "2.5"), 9: ("z", 0.25, True, moment, "y")}
    assert readers.read_xlsx(spark, content=encoded(content), sheet="two & more").count() == 1


def hand_made(sheet, strings="", date1904=False):
    """A workbook as other programs write it: shared strings, references, gaps."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as files:
        files.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                       f'<workbookPr date1904="{int(date1904)}"/><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        files.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="r"><Relationship Id="x" Target="/xl/sheets/a.xml"/></Relationships>')
        files.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        files.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/>'
                       '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        files.writestr("xl/sheets/a.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
    return encoded(out.getvalue())


def test_shared_strings_gaps_and_styles(spark):
    strings = "<si><t>key</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"
    sheet = ('<row r="1"/><row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="s"><v>0</v></c><c r="E3" t="str"><v>day</v></c><c r="F3" t="str"><v>n</v></c></row>'
             '<row r="5"><c r="B5"><v>1e3</v></c><c r="C5"><v>8</v></c><c r="D5" t="s"><v>1</v></c><c r="E5" s="1"><v>45352.5</v></c><c r="F5" s="2"><v>3</v></c></row>'
             '<row r="6"><c r="D6" t="e"><v>#REF!</v></c><c r="F6"><v>4.5</v></c></row>')
    df = readers.read_xlsx(spark, content=hand_made(sheet, strings), dates=False)
    assert df.columns == ["key", "key.1", "day", "n"]
    assert [tuple(r) for r in df.collect()] == [(1000, "rich", dt.datetime(2024, 3, 1, 12), 3.0), (None, None, None, 4.5)]
    late = readers.read_xlsx(spark, content=hand_made(sheet, strings, True), dates=False)
    assert late.first()["day"] == dt.datetime(2028, 3, 2, 12)


def test_what_is_no_workbook_is_refused(spark):
    for content in (encoded(b"a,b\n1,2"), hand_made("")):
        with pytest.raises(Exception, match="workbook"):
            readers.read_xlsx(spark, content=content).collect()
    with pytest.raises(Exception, match="no sheet"):
        readers.read_xlsx(spark, content=hand_made('<row><c><v>1</v></c></row>'), sheet="T").collect()


def test_pages_tile_the_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.pmod(F.xxhash64("id"), F.lit(20)).alias("group"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    pages = Pages(df, [F.desc("group"), F.asc("k")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wanted = [tuple(r) for r in df.orderBy(F.desc("group"), "k").collect()]
    assert pages.total == 1000 and [n for _, n in pages.sizes] != [1000]
    got = [tuple(r) for n in range(1, 9) for r in pages.page(n, 137).collect()]
    assert got == wanted and pages.page(9, 137).count() == 0
    read = lambda n: pages.page(n, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in read(1) and len(read(100)) < 1.5 * len(read(1))
    assert Pages(df.limit(0), [F.asc("k")]).page(1, 10).count() == 0
