"""Names, dates, categories, files."""

import datetime
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from sparktab.functions import dates, numbers, text
from sparktab.operators import encode, schema
from sparktab.sources import ontology, tables


def test_names_are_cleaned_and_numbered():
    names = ["T1", "T 2", "a.b", "a-b", "__x__", "CVD.event", "T_3"]
    assert schema.clean_names(names, "CVD.event") == ["T", "T_1", "a_b", "a_b_1", "x", "CVD.event", "T_2"]
    assert schema.clean_names(["a.b1", "c d"], None, "simple") == ["a_b1", "c_d"]
    with pytest.raises(ValueError):
        text.sanitize_name("a", "other")


def one(spark, expr_fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr_fn(F.col("s"))).collect()]


def test_jalali_anchors(spark):
    got = one(spark, lambda c: dates.parse_jalali(c).cast("date"), "1399/12/30", "1400/01/01", "1403/01/01", "1400/12/30", "1400/13/01", "x/1/1", None, "1357/11/22")
    d = datetime.date
    assert got == [d(2021, 3, 20), d(2021, 3, 21), d(2024, 3, 20), None, None, None, None, d(1979, 2, 11)]


def test_calendars_and_bad_dates(spark):
    assert one(spark, dates.calendar_type, "1400/01/01", "2020-01-01", "1700/1/1", "20200101", None) == ["jalali", "gregorian", "unknown", "unknown", "unknown"]
    assert one(spark, dates.is_pure_date_string, "2020/01/02", "2020-1-2", "a/b/c", "2020/1", None) == [True, True, False, False, False]
    assert one(spark, lambda c: dates.parse_gregorian(c).cast("date"), "2020-02-30", "2020-02-29")[0] is None


def test_date_columns_skip_empty_and_mixed(spark):
    df = spark.createDataFrame([("2020-01-01", "1400/01/01", None, "x"), (None, "1400/12/29", None, "2020-01-01")], "a string, b string, c string, d string")
    assert schema.date_columns(df) == {"a": "gregorian", "b": "jalali"}


def test_missing_date_is_not_a_weekend(spark):
    df = spark.createDataFrame([("2024-06-01",), (None,)], "d string")
    rows = encode.expand_dates(df, {"d": "gregorian"}).collect()
    assert rows[0]["d_is_weekend"] == 1.0 and rows[0]["d_day_of_week"] == 5.0
    assert rows[1]["d_is_weekend"] == 0.0 and rows[1]["d_year"] is None


@pytest.mark.parametrize("literal_rows", [0, 100])
def test_unseen_and_missing_categories(spark, literal_rows):
    train = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None)], "row_id long, k string")
    mapping = encode.category_map(train, ["k"], "row_id", target_rows=1)
    assert {(r["category"], r["code"]) for r in mapping.collect()} == {("a", 0), ("b", 1)}
    new = spark.createDataFrame([(1, "b"), (2, "z"), (3, None), (4, "7")], "row_id long, k string")
    null = {r["row_id"]: r["k"] for r in encode.encode_categories(new, mapping, ["k"], "null", literal_rows).collect()}
    keep = {r["row_id"]: r["k"] for r in encode.encode_categories(new, mapping, ["k"], "keep", literal_rows).collect()}
    assert null == {1: 1.0, 2: None, 3: None, 4: None} and keep == {1: 1.0, 2: None, 3: None, 4: 7.0}


def test_delimited_file(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a;b;c d;e\n1;x;NA;2020-01-01\n2; ;3.5;\nNaN;z;4;2021-05-05\n")
    df = tables.read_any(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c d": "double", "e": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, "x", None, "2020-01-01"), (2, None, 3.5, None), (None, "z", 4.0, "2021-05-05")]
    with pytest.raises(ValueError):
        tables.read_any(spark, "data.parquet")


def workbook(rows) -> bytes:
    shared, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            ref = f"{'ABCDEF'[j]}{i}"
            if v is None:
                continue
            if isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook([["id", "name", "v"], [1, "x", 2.5], [2, None, "NA"]]))
    (tmp_path / "two.xlsx").write_bytes(workbook([["id", "name", "v"], [3, "y", 7]]))
    df = tables.read_any(spark, str(tmp_path / "*.xlsx"))
    assert sorted(map(tuple, df.collect())) == [(1, "x", 2.5), (2, None, None), (3, "y", 7.0)]


def test_workbooks_are_read_by_their_own_heading(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook([["id", "name", "v"], [1, "x", 2.5]]))
    (tmp_path / "two.xlsx").write_bytes(workbook([["v", "id", "name"], [7, 3, "y"]]))
    assert sorted(map(tuple, tables.read_any(spark, str(tmp_path / "*.xlsx")).select("id", "name", "v").collect())) == [(1, "x", 2.5), (3, "y", 7.0)]
    (tmp_path / "three.xlsx").write_bytes(workbook([["id", "other", "v"], [3, "y", 7]]))
    with pytest.raises(ValueError, match="other columns"):
        tables.read_any(spark, str(tmp_path / "*.xlsx"))


def test_unicode_names(spark):
    got = one(spark, lambda c: text.normalize_text(c, unicode=True), "  ﻗﻨﺪ_ﺧﻮﻥ ۱۲", "Straße.NAME-3", "Ａge", None)
    assert got == ["قند خون", "strasse name", "age", ""]


def test_similarity_levels():
    assert text.name_similarity("a b", "a b") == 1.0 and text.name_similarity("ab", "a b") == 0.985 and text.name_similarity("", "a") == 0.0
    # ratio 8/9 on characters; one of three tokens shared, half of the shorter name.
    assert 0.5 < text.name_similarity("blood sugar", "blood test") < 0.9


def test_p_values():
    def by_integration(r, n):
        """Tail area of Student's t by the midpoint rule on the angle: t = sqrt(df) tan(a)."""
        df = n - 2
        start = math.atan(abs(r) / math.sqrt(1 - r * r))
        step = (math.pi / 2 - start) / 100_000
        tail = sum(math.cos(start + (i + 0.5) * step) ** (df - 1) for i in range(100_000)) * step
        whole = sum(math.cos((i + 0.5) * math.pi / 200_000) ** (df - 1) for i in range(100_000)) * math.pi / 200_000
        return tail / whole

    for r, n in ((0.5, 30), (0.1, 100), (-0.3, 12), (0.02, 5000), (0.9, 5)):
        assert numbers.correlation_p(r, n) == pytest.approx(by_integration(r, n), rel=1e-6)
    assert numbers.correlation_p(0.0, 10) == 1.0 and numbers.correlation_p(1.0, 10) == 0.0


def test_normal_cdf(spark):
    df = spark.createDataFrame([(0.0, 0.5), (1.96, 0.9750021), (-1.0, 0.1586553)], "z double, p double")
    assert df.select(F.max(F.abs(numbers.normal_cdf(F.col("z")) - F.col("p")))).first()[0] < 1e-6


def test_ontology_without_concepts(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"name": 1}')
    with pytest.raises(ValueError):
        ontology.read_ontology(spark, str(tmp_path / "o.json"))


def test_single_text_aliases_and_value_maps(spark, tmp_path):
    (tmp_path / "o.json").write_text(
        '{"ontology_name": "t", "concepts": {"AGE": {"data_type": "numeric", "range": [0, 120], "aliases": {"en": "age", "fa": ["سن", " "]}},'
        ' "SEX": {"values": {"m": ["male", "M"], "f": "female"}, "aliases": {"en": ["sex", "gender"]}}}}')
    concepts, aliases = ontology.read_ontology(spark, str(tmp_path / "o.json"))
    rows = {r["concept_id"]: r for r in concepts.collect()}
    assert (rows["AGE"]["low"], rows["AGE"]["high"]) == (0.0, 120.0) and sorted(rows["SEX"]["allowed"]) == ["M", "female", "male"]
    assert [(r["concept_id"], r["language"], r["text"]) for r in aliases.orderBy("position").collect()] == [
        ("AGE", "en", "age"), ("AGE", "fa", "سن"), ("SEX", "en", "sex"), ("SEX", "en", "gender")]
