"""The workbook source: ranges of any size give each row once, texts survive, retried tasks leave nothing, foreign dialects are read."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparktab.sources import tables, workbook

ODD = ["", " a ", "a<b>&\"c'", "line\nbreak\ttab", "\x01bell\r", "_x0041_", "_x005F_", "\U0001f600 ünïcode", "<row r='1'>", "007", None]


def frame(spark, n=500):
    return spark.createDataFrame([(i, ODD[i % len(ODD)], i / 7, i % 3 == 0) for i in range(n)], "id long, t string, d double, b boolean")


@pytest.mark.parametrize("size", [64, 1000, 4097, 1 << 25])
def test_ranges_give_every_row_once(spark, tmp_path, size):
    df = frame(spark).repartition(3)
    path = str(tmp_path / "out.xlsx")
    workbook.register(spark)
    df.write.format("workbook").option("rowsPerFile", 120).mode("append").save(path)
    got = spark.read.format("workbook").option("rangeBytes", size).load(path)
    assert got.columns == ["id", "t", "d", "b"]
    want = {(r["id"], r["t"], r["d"], r["b"]) for r in df.collect()}
    rows = got.collect()
    assert len(rows) == 500 and {(int(r["id"]), r["t"], float(r["d"]), r["b"] == "true") for r in rows} == want
    assert len(workbook.files_of(path)) >= 5


def test_hidden_files_are_not_read_and_overwriting_replaces(spark, tmp_path):
    path = tmp_path / "out.xlsx"
    tables.write_table(frame(spark, 20), str(path), "xlsx")
    one = sorted(path.glob("part-*.xlsx"))[0]
    (path / "_part-lost.xlsx").write_bytes(one.read_bytes())
    assert tables.read_any(spark, str(path)).count() == 20
    tables.write_table(frame(spark, 7), str(path), "xlsx")
    assert tables.read_any(spark, str(path)).count() == 7


def test_prefixes_shared_texts_and_gaps(spark, tmp_path):
    sheet = (f'<x:worksheet xmlns:x="{workbook.MAIN}" xmlns:y="urn:y"><x:cols/><x:sheetData><x:row r="1" y:s="2"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="C1" t="s"><x:v>1</x:v></x:c></x:row>'
             '<x:row r="2"/><x:row r="3"><x:c r="C3"><x:v>5</x:v></x:c><x:c r="E3"><x:v>9</x:v></x:c></x:row></x:sheetData><x:tail/></x:worksheet>')
    shared = f'<sst xmlns="{workbook.MAIN}"><si><r><t>i</t></r><r><t>d</t></r><rPh><t>no</t></rPh></si><si><t>v</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet10.xml", "<worksheet/>")
        z.writestr("xl/worksheets/sheet2.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    got = tables.read_any(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["id", "Unnamed: 1", "v"] and sorted(map(str, (tuple(r) for r in got.collect()))) == ["(None, None, 5)", "(None, None, None)"]


def test_empty_tables_and_sheets(spark, tmp_path):
    tables.write_table(frame(spark, 3).where("id < 0").coalesce(1), str(tmp_path / "none.xlsx"), "xlsx")
    got = tables.read_any(spark, str(tmp_path / "none.xlsx"))
    assert got.columns == ["id", "t", "d", "b"] and got.count() == 0
    with zipfile.ZipFile(tmp_path / "blank.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbook.MAIN}"><sheetData/></worksheet>')
    with pytest.raises(ValueError):
        tables.read_any(spark, str(tmp_path / "blank.xlsx"))


def test_row_pieces_over_chunk_borders(monkeypatch):
    rows = [f'<row r="{i}"><c><v>{"9" * (i % 50)}</v></c></row>'.encode() for i in range(300)]
    whole = b'<worksheet xmlns="u"><sheetData>' + b"".join(rows) + b"</sheetData></worksheet>"
    for chunk in (1, 7, 64, 4096):
        monkeypatch.setattr(workbook, "CHUNK_BYTES", chunk)
        for size in (33, 1000, len(whole)):
            if chunk == 1 and size == 33:
                continue
            got = [p for low in range(0, len(whole), size) for _, ps in workbook.row_pieces(io.BytesIO(whole), low, low + size) for p in ps]
            assert got == rows
