"""Text files as spreadsheets and exports write them, and the other sources."""

import pytest

from gapwise import EngineError, load_dataset, read_csv_table, read_table
from gapwise.functions.missing import numeric_columns
from gapwise.sources.tables import with_row_id


def put(folder, text, name="orders.csv"):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def code_of(call):
    with pytest.raises(EngineError) as caught:
        call()
    return caught.value.code


def test_quoted_cells(spark, tmp_path):
    df = read_csv_table(spark, put(tmp_path, 'part,remark\n7,"say ""hi"", ok"\n8,"ends in \\"\n9,"two, or ""three"""\n'))
    assert [r["remark"] for r in df.orderBy("part").collect()] == ['say "hi", ok', "ends in \\", 'two, or "three"']


def test_line_breaks_in_quotes_need_multiline(spark, tmp_path):
    path = put(tmp_path, 'part,remark\n7,"first\nsecond"\n8,plain\n')
    assert code_of(lambda: read_csv_table(spark, path)) == "parse_error"
    assert {r["remark"] for r in read_csv_table(spark, path, multiline=True).collect()} == {"first\nsecond", "plain"}


def test_quotes_inside_a_cell_are_text(spark, tmp_path):
    df = read_csv_table(spark, put(tmp_path, 'n,part,__broken_row\n1,5" pipe,a\n2,3" and 4" pipes,"b, ""c"""\n3, "quoted" ,d"\n'))
    rows = df.orderBy("n").collect()
    assert [r["part"] for r in rows][:2] == ['5" pipe', '3" and 4" pipes'] and [r["__broken_row"] for r in rows] == ["a", 'b, "c"', 'd"']


@pytest.mark.parametrize("line", ['1,"open', '5" pipe,"open', '"a ""b"", c,2'])
def test_cells_that_stay_open_are_refused(spark, tmp_path, line):
    assert code_of(lambda: read_csv_table(spark, put(tmp_path, f"n,part\n7,8\n{line}\n"))) == "parse_error"


@pytest.mark.parametrize("row", ["3,4,5", "3"])
def test_rows_that_do_not_fit_the_header(spark, tmp_path, row):
    assert code_of(lambda: read_csv_table(spark, put(tmp_path, f"price,tax\n1,2\n{row}\n"))) == "parse_error"


def test_codes_with_type_suffixes_stay_text(spark, tmp_path):
    df = read_csv_table(spark, put(tmp_path, "shelf,price\n12d,1e3\n3f,-.5\n7D,2.\n"))
    assert dict(df.dtypes) == {"shelf": "string", "price": "double"} and {r["shelf"] for r in df.collect()} == {"12d", "3f", "7D"}


def test_files_of_one_path_must_agree(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    put(folder, "price,tax\n1,2\n", "a.csv")
    put(folder, "price,tax\n3,4\n", "b.csv")
    assert read_csv_table(spark, str(folder)).count() == 2
    put(folder, "tax,price\n5,6\n", "c.csv")
    assert code_of(lambda: read_csv_table(spark, str(folder))) == "parse_error"


def test_blank_tokens_are_missing_with_blanks_around_them(spark, tmp_path):
    df = read_csv_table(spark, put(tmp_path, "price|flag|note\n 1.5|TRUE|NA \n n/a|false|kept\n2|<NA>|None\n"))
    assert dict(df.dtypes) == {"price": "double", "flag": "boolean", "note": "string"}
    assert df.toPandas().isna().sum().to_dict() == {"price": 1, "flag": 1, "note": 2}


def test_unusable_files_have_codes(spark, tmp_path):
    for text, code in (("\n \n", "empty_file"), ("price\n", "empty_table"), ("price,price\n1,2\n", "duplicate_columns"),
                       ("price,\n1,2\n", "missing_header"), ("who\nme\n", "no_numeric_column")):
        assert code_of(lambda text=text: read_csv_table(spark, put(tmp_path, text))) == code
    wide = put(tmp_path, "p,q,r\n" + "1,2,3\n" * 4)
    assert code_of(lambda: read_csv_table(spark, wide, max_columns=2)) == "too_many_columns"
    assert code_of(lambda: read_csv_table(spark, wide, max_rows=3)) == "too_many_rows"


def test_other_formats_and_row_ids(spark, tmp_path):
    frame = spark.range(40).selectExpr("id AS part", "id / 4 AS price")
    for kind in ("parquet", "orc", "json"):
        frame.write.format(kind).save(str(tmp_path / kind))
        df = load_dataset(spark, {"kind": kind, "path": str(tmp_path / kind)})
        assert df.count() == read_table(spark, str(tmp_path / kind), kind).count() == 40 and "price" in numeric_columns(df)
    frame.createOrReplaceTempView("priced")
    numbered = with_row_id(load_dataset(spark, {"kind": "table", "name": "priced"}))
    assert numbered.select("row_id").distinct().count() == 40
    assert {code_of(lambda s=s: load_dataset(spark, s)) for s in ({"kind": "table"}, {"kind": "paper"})} == {"unknown_dataset"}
