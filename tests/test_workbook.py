"""Workbook uploads, from small hand-made archives."""

import zipfile
from decimal import Decimal

from deskloom.operators.ingest import split_valid, validate_workbook
from deskloom.operators.schema_ops import normalize_headers
from deskloom.sources.workbook import read_ticket_workbooks

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(ref, value, shared):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value[7:]}</t></is></c>'
    shared.append(value)
    return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'


def workbook(path, rows, active=0):
    """Two sheets; the rows are on the active one."""
    shared = []
    body = "".join(
        f'<row r="{n}">' + "".join(cell(f"{chr(65 + i)}{n}", v, shared) for i, v in enumerate(values)) + "</row>"
        for n, values in rows.items()
    )
    sheets = {0: f'<worksheet xmlns="{NS}"><sheetData/></worksheet>', 1: f'<worksheet xmlns="{NS}"><sheetData/></worksheet>'}
    sheets[active] = f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{NS}" xmlns:r="{REL}"><bookViews><workbookView activeTab="{active}"/></bookViews>'
            '<sheets><sheet name="A" sheetId="1" r:id="rId1"/><sheet name="B" sheetId="2" r:id="rId2"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/one.xml"/><Relationship Id="rId2" Target="/xl/worksheets/two.xml"/></Relationships>',
        )
        z.writestr("xl/worksheets/one.xml", sheets[0])
        z.writestr("xl/worksheets/two.xml", sheets[1])
        strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{strings}</sst>')


HEADER = ["Store Name", "Contact Number", "Email", "Subject", "Concern", "Assigned To", " Status ", "Service Done", "Labor Fee", "Date"]


def test_workbooks(spark, tmp_path):
    workbook(
        tmp_path / "a.xlsx",
        {
            1: HEADER,
            2: ["Uno", 9171234567, None, " Printer ", "broken", "Ann", "Complete", "fixed", 12.5, 45000],
            3: [None, None, None, None, None, None, None, None, 0, None],
            4: ["Dos", None, "inline:d@x.y", "Printer", "broken", None, None, None, "free", None],
            5: ["Tres", None, None, "Printer", "no contact", None, "Weird Thing", None, None, None],
            7: ["Siete", "1", None, "Printer", "c", None, "Weird Thing", None, 0, None],
        },
        active=1,
    )
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    workbook(tmp_path / "wide.xlsx", {1: HEADER, 2: ["W" * 46, "1", None, "s", "c"], 3: ["Ok", "1", None, "s", "c"]})
    (tmp_path / "skipped.txt").write_text("no workbook")

    rows = read_ticket_workbooks(spark, str(tmp_path))
    accepted, rejected = split_valid(validate_workbook(rows))
    got = {r["row_num"]: r for r in accepted.collect()}
    assert sorted(got) == [2, 4, 7]
    assert got[2]["contact_number"] == "9171234567" and got[2]["subject"] == " Printer "
    assert got[2]["status"] == "completed" and got[4]["status"] == "pending" and got[7]["status"] == "weird thing"
    assert (got[2]["labor_fee"], got[4]["labor_fee"], got[7]["labor_fee"]) == (Decimal("12.50"), None, None)
    errors = {(r["file"].rsplit("/", 1)[1], r["row_num"]): r["error"] for r in rejected.collect()}
    assert errors["wide.xlsx", 2] == errors["wide.xlsx", 3] == "Data too long for column store_name"
    assert errors["broken.xlsx", 0].startswith("Error reading Excel file")


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Store Name", "concern", "Reported Concern ", "Foo Bar"])
    assert normalize_headers(df).columns == ["store_name", "reported_concern", "reported_concern", "foo_bar"]
