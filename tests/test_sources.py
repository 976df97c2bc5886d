import pytest
from pyspark.sql import functions as F

from millrace.operators.routing import split_errors
from millrace.plans.staging_load import load_staging
from millrace.session import new_shared_dir
from millrace.sinks import writers
from millrace.sinks.writers import StepFailed
from millrace.sources import delimited, files
from millrace.sources.tables import jdbc_options


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def records(df):
    return sorted(r[0] for r in df.collect())


def test_staging_file(spark, tmp_path):
    path = put(tmp_path / "in.txt", '﻿one\n\n "two^2" \n esc\\"z\nbad^row\n"qu\\"ote"\n')
    good, bad = split_errors(delimited.parse_delimited(spark, path))
    assert records(good) == ['esc\\"z', "one", 'qu"ote', "two^2"]
    assert [tuple(r) for r in bad.collect()] == [("bad", "bad^row")]


def test_empty_file_is_allowed(spark, tmp_path):
    assert delimited.parse_delimited(spark, put(tmp_path / "none.txt", "")).count() == 0


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_binary(spark, str(tmp_path / "absent"))


@pytest.mark.parametrize("options, want", [
    ({"header": True}, ["b", "c"]),
    ({"skip_lines": 1}, ["b", "c"]),
    ({"skip_lines": 1, "header": True}, ["c"]),
    ({"skip_lines": 3}, []),
    ({"trim": False}, ["a", "b", "c "]),
])
def test_top_lines(spark, tmp_path, options, want):
    for name in ("x.txt", "y.txt"):
        put(tmp_path / "in" / name, "a\nb\nc \n")
    good, _ = split_errors(delimited.parse_delimited(spark, str(tmp_path / "in"), **options))
    assert records(good) == sorted(want * 2)


@pytest.mark.parametrize("content", [
    "ä\nb^c\n".encode(), b"\xef\xbb\xbf" + "ä\nb^c\n".encode(), "ä\nb^c\n".encode("utf-16"),
    b"\xfe\xff" + "ä\nb^c\n".encode("utf-16-be"),
])
def test_charset_by_mark(spark, tmp_path, content):
    path = put(tmp_path / "f.txt", content)
    good, bad = split_errors(delimited.parse_delimited(spark, path, charset="auto-bom"))
    assert records(good) == ["ä"] and records(bad) == ["b"]


def test_undecodable_bytes_are_null(spark):
    rows = spark.createDataFrame([(bytearray(b"\xff\xfe\x41"),), (bytearray(b"a\x80"),), (bytearray(b""),)], "content binary")
    assert [r.text for r in delimited.decode_bytes(rows).collect()] == [None, None, ""]


def test_inventory_skips_working_copies(spark, tmp_path):
    for name in ("a.json", "temp_sanitized_a.json", "b.json"):
        put(tmp_path / name, "{}")
    assert records(files.list_files(spark, str(tmp_path))) == ["a.json", "b.json"]
    assert files.find_file(spark, str(tmp_path), "a.json").count() == 1
    assert files.find_file(spark, str(tmp_path), "none").count() == 0
    plan = files.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_csv_types(spark, tmp_path):
    path = put(tmp_path / "t.csv", "a,b\n1,x\n")
    assert [f.dataType.simpleString() for f in files.read_csv(spark, path).schema] == ["string", "string"]
    assert [f.dataType.simpleString() for f in files.read_csv(spark, path, infer=True).schema] == ["int", "string"]


def test_load_staging_keeps_old_rows_when_a_file_cannot_be_read(spark, tmp_path):
    target = new_shared_dir(spark, "staging-test")
    name = "staging_" + target[-32:]
    spark.sql(f"CREATE TABLE {name} (FileRecord STRING) USING parquet LOCATION '{target}'")
    bad = str(tmp_path / "bad")
    assert load_staging(spark, put(tmp_path / "1.txt", "a\nb\nc^d\n"), name, bad) == 2
    assert spark.read.csv(bad, header=True).count() == 1
    with pytest.raises(Exception):
        load_staging(spark, str(tmp_path / "absent.txt"), name)
    assert records(spark.table(name)) == ["a", "b"]
    assert load_staging(spark, put(tmp_path / "2.txt", "z\n"), name) == 1
    assert records(spark.table(name)) == ["z"]
    with pytest.raises(StepFailed, match="load staging|does not exist"):
        load_staging(spark, put(tmp_path / "3.txt", "z\n"), "no_such_table")


def test_database_reads_can_be_split():
    assert jdbc_options("jdbc:x", "select 1", {"user": "u"}) == {"url": "jdbc:x", "user": "u", "query": "select 1"}
    split = jdbc_options("jdbc:x", "select id from t", None, ("id", 0, 100, 4))
    assert split["dbtable"] == "(select id from t) q" and split["numPartitions"] == "4" and "query" not in split


def test_parse_text_keeps_line_numbers(spark):
    rows = spark.createDataFrame([("f", "x\n\n y \n\nz^1")], "path string, text string")
    parsed = delimited.parse_text(rows, "text", ("r",)).orderBy("line_no")
    assert [tuple(r) for r in parsed.select("path", "line_no", "r", F.col("_corrupt")).collect()] == [
        ("f", 1, "x", None), ("f", 3, "y", None), ("f", 5, "z", "z^1")
    ]


@pytest.mark.parametrize("content, options, want", [
    ("\nfirst\nsecond\n", {"skip_lines": 1}, ["first", "second"]),
    ("\nfirst\nsecond\n", {"skip_lines": 1, "charset": "utf-8"}, ["first", "second"]),
    ("\nfirst\nsecond\n", {"skip_lines": 1, "header": True}, ["second"]),
    ("\nfirst\nsecond\n", {"header": True}, ["first", "second"]),
    ("a\nb\n".encode("utf-16"), {"header": True}, ["b"]),
    ("\nfirst\nsecond\n".encode("utf-16"), {"skip_lines": 2}, ["second"]),
])
def test_top_lines_count_alike_on_every_path(spark, tmp_path, content, options, want):
    good, bad = split_errors(delimited.parse_delimited(spark, put(tmp_path / "f.txt", content), **options))
    assert records(good) == want and bad.count() == 0


def test_files_of_several_charsets(spark, tmp_path):
    put(tmp_path / "in" / "a", "eins\nä\n")
    put(tmp_path / "in" / "b", "zwei\nö\n".encode("utf-16"))
    put(tmp_path / "in" / "c", b"drei\nbad \x80 byte\nvier\n")
    put(tmp_path / "in" / "d", b"\xff\xfe\x00\xd8")
    good, bad = split_errors(delimited.parse_delimited(spark, str(tmp_path / "in")))
    assert records(good) == ["drei", "eins", "vier", "zwei", "ä", "ö"]
    assert sorted(r["_corrupt"][:12] for r in bad.collect()) == ["bad � byte", "undecodable "]


def test_only_the_starts_of_files_tell_the_charset(spark, tmp_path):
    for name, content in [("a [1] ä%20.txt", "eins\n".encode("utf-16")), ("b {2}.txt", "zwei\n"), ("c.txt", ""), ("d.txt", "x")]:
        put(tmp_path / "in" / name, content)
    starts = dict(files.file_starts(spark.read.format("binaryFile").load(str(tmp_path / "in")), 2))
    assert sorted(starts.values()) == [b"", b"x", b"zw", b"\xff\xfe"]
    parsed = delimited.parse_delimited(spark, str(tmp_path / "in"))
    good, bad = split_errors(parsed)
    assert records(good) == ["eins", "x", "zwei"] and bad.count() == 0
    # one scan of lines, without the file that is read whole; that file alone is read for its rows and for its error
    scans = [line for line in parsed._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert sum("FileScan text" in line for line in scans) == 1 and all("file_path" in line for line in scans)
    put(tmp_path / "plain" / "f.txt", "eins\n")
    plan = delimited.parse_delimited(spark, str(tmp_path / "plain"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_multi_line_records(spark, tmp_path):
    path = put(tmp_path / "f.txt", 'x\n"a\nb"\nc\n')
    good, bad = split_errors(delimited.parse_delimited(spark, path, header=True, multi_line=True, charset="utf-8"))
    assert records(good) == ["a\nb", "c"] and bad.collect() == []
    with pytest.raises(ValueError):
        delimited.parse_delimited(spark, path, skip_lines=1, multi_line=True, charset="utf-8")


@pytest.mark.parametrize("raw, text", [
    (b"\xff\xfe\x00\xd8", None), (b"\xff\xfe\x00\xdc", None), (b"\xfe\xff\xd8\x00\x00a", None), (b"\xff\xfea", None),
    ("😀a".encode("utf-16"), "😀a"), (b"\xfe\xff" + "😀é".encode("utf-16-be"), "😀é"), (b"\xff\xfe", ""),
])
def test_malformed_utf16_is_null(spark, raw, text):
    rows = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert delimited.decode_bytes(rows).first().text == text


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    rows = [("a\nb", "x"), ('b"', 'say ""no""'), ("c,d", "e\\"), (" f", "g ")]
    frame = spark.createDataFrame(rows, "p string, q string")
    writers.write_csv(frame, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), "p string, q string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted((p.strip(" "), q.strip(" ")) for p, q in rows)
