"""Delimited text with an error view, and charset detection by byte-order mark (SRC2, SRC3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import lines
from millrace.sources.files import file_starts

# Format of the staging files.
SEPARATOR = "^"
QUOTE = '"'
ESCAPE = "\\"
STAGING_COLUMNS = ("FileRecord",)

CORRUPT = "_corrupt"

# Byte-order marks in hexadecimal digits.
MARK_UTF8 = "EFBBBF"
MARK_UTF16_LE = "FFFE"
MARK_UTF16_BE = "FEFF"
#: The charset is told by the mark.
AUTO = "auto-bom"

# UTF-16 in hexadecimal digits, by byte order: units outside the surrogates, or pairs of them.
_PAIRED = {
    MARK_UTF16_BE: r"(?:[0-9A-CEF][0-9A-F]{3}|D[0-7][0-9A-F]{2}|D[89AB][0-9A-F]{2}D[CDEF][0-9A-F]{2})*+",
    MARK_UTF16_LE: r"(?:[0-9A-F]{2}[0-9A-CEF][0-9A-F]|[0-9A-F]{2}D[0-7]|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[CDEF])*+",
}


def text_schema(columns: Sequence[str]) -> T.StructType:
    """The declared columns as texts, and the column that receives rows which do not fit."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])


def parse_options(sep: str, quote: str, escape: str, trim: bool) -> dict[str, str]:
    return {
        "sep": sep,
        "quote": quote,
        "escape": escape,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "ignoreLeadingWhiteSpace": str(trim).lower(),
        "ignoreTrailingWhiteSpace": str(trim).lower(),
    }


def parse_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] = STAGING_COLUMNS,
    sep: str = SEPARATOR,
    quote: str = QUOTE,
    escape: str = ESCAPE,
    header: bool = False,
    skip_lines: int = 0,
    trim: bool = True,
    charset: str = AUTO,
    multi_line: bool = False,
) -> DataFrame:
    """Files -> declared columns plus `_corrupt`; part it with `operators.routing.split_errors`.

    The first `skip_lines` lines of each file, blank ones too, and then one more for a `header` are left
    out; blank lines further on are no records. Lines with bytes that are no text have `_corrupt`.

    UTF-8 files are scanned by lines, so large files are split among tasks. With `auto-bom`, the default, two
    bytes of each file are read when this is called, to find those with a UTF-16 mark. These, and files of any
    other charset, are read whole, one row each: for files below 2 GB. The mark of a compressed file is
    not seen. The top lines are looked for in the first split of a file.

    `multi_line` takes quoted fields with line breaks: each file then goes through one task, and lines
    cannot be skipped but for a header.
    """
    top = skip_lines + int(header)
    paths = [path] if isinstance(path, str) else list(path)
    if multi_line:
        if skip_lines or charset.lower() == AUTO:
            raise ValueError("multi_line needs a charset and takes no skip_lines")
        reader = spark.read.schema(text_schema(columns)).options(**parse_options(sep, quote, escape, trim))
        return reader.options(header=header, multiLine=True, encoding=charset).csv(paths)
    if charset.lower() == "utf-8":
        return _parse_scanned(spark, paths, columns, sep, quote, escape, top, trim)
    if charset.lower() != AUTO:
        files = spark.read.format("binaryFile").load(paths).select("path", F.decode("content", charset).alias("text"))
        return _parse_whole(files, columns, sep, quote, escape, top, trim)
    files = spark.read.format("binaryFile").load(paths)
    wide = [name for name, start in file_starts(files, 2) if start.hex().upper() in (MARK_UTF16_LE, MARK_UTF16_BE)]
    scanned = _parse_scanned(spark, paths, columns, sep, quote, escape, top, trim, without=wide)
    if not wide:
        return scanned
    texts = decode_bytes(files.filter(F.col("_metadata.file_path").isin(wide)).select("path", "content"))
    return _parse_whole(texts, columns, sep, quote, escape, top, trim).unionByName(scanned)


def _numbered_lines(spark: SparkSession, paths: list[str], without: Sequence[str] = ()) -> DataFrame:
    """`_file, _start, _id, _line`: lines as they are, with the start of their split and numbers that rise by one
    from line to line within a split. Files of the names in `without` are left out of the scan."""
    lines_ = spark.read.text(paths)
    meta = F.col("_metadata")
    if without:
        lines_ = lines_.filter(~meta["file_path"].isin(list(without)))
    return lines_.select(
        meta["file_path"].alias("_file"),
        meta["file_block_start"].alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("_line"),
    )


def _parse_scanned(spark, paths, columns, sep, quote, escape, top, trim, without=()) -> DataFrame:
    rows = _numbered_lines(spark, paths, without)
    if top:
        first = rows.filter("_start = 0").groupBy("_file").agg(F.min("_id").alias("_first"))
        rows = rows.join(first, "_file", "left")
        rows = rows.filter((F.col("_start") > 0) | (F.col("_id") >= F.col("_first") + top))
    mark = F.substring(F.col("_line").cast("binary"), 1, 3) == F.unhex(F.lit(MARK_UTF8))
    raw = F.col("_line").cast("binary")
    line = F.when((F.col("_start") == 0) & mark, F.substring(raw, 4, 2**31 - 1)).otherwise(raw).cast("string")
    valid = F.is_valid_utf8("_line")
    rows = rows.select(line.alias("_line"), valid.alias("_valid"))
    rows = rows.select("_valid", F.make_valid_utf8("_line").alias("_line")).filter(F.trim("_line") != "")
    parsed = with_parsed_line(rows, "_line", columns, sep, quote, escape, trim)
    bad = F.when(~F.col("_valid"), F.col("_line")).otherwise(F.col(CORRUPT))
    kept = [F.when(F.col("_valid"), F.col(f"`{c}`")).alias(c) for c in columns]
    return parsed.select(*kept, bad.alias(CORRUPT))


def _parse_whole(texts: DataFrame, columns, sep, quote, escape, top, trim) -> DataFrame:
    """Rows of decoded files; a file that could not be decoded is one bad row with its path."""
    good = parse_text(texts.filter("text is not null"), "text", columns, sep, quote, escape, skip_lines=top, trim=trim)
    none = [F.lit(None).cast("string").alias(c) for c in columns]
    bad = texts.filter("text is null").select(*none, F.concat(F.lit("undecodable file "), "path").alias(CORRUPT))
    return good.select(*columns, CORRUPT).unionByName(bad)


def parse_text(
    df: DataFrame,
    text: str,
    columns: Sequence[str] = STAGING_COLUMNS,
    sep: str = SEPARATOR,
    quote: str = QUOTE,
    escape: str = ESCAPE,
    skip_lines: int = 0,
    trim: bool = True,
) -> DataFrame:
    """Texts held in a column -> one row per line that is not blank; other columns stay, `line_no` counts from 1."""
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.posexplode(lines(F.col(text))).alias("line_no", "_line"))
    rows = rows.filter((F.col("line_no") >= skip_lines) & (F.trim("_line") != ""))
    return with_parsed_line(
        rows.withColumn("line_no", F.col("line_no").cast("bigint") + 1), "_line", columns, sep, quote, escape, trim
    ).drop("_line")


def with_parsed_line(
    df: DataFrame,
    line: str,
    columns: Sequence[str] = STAGING_COLUMNS,
    sep: str = SEPARATOR,
    quote: str = QUOTE,
    escape: str = ESCAPE,
    trim: bool = True,
) -> DataFrame:
    """Parse one line per row in place: adds the declared columns and `_corrupt`."""
    schema = ", ".join(f"`{c}` string" for c in (*columns, CORRUPT))
    parsed = F.from_csv(F.col(line), schema, parse_options(sep, quote, escape, trim))
    return df.withColumn("_row", parsed).select(*df.columns, "_row.*")


def detected_charset(content: Column) -> Column:
    """Encoding named by the byte-order mark; UTF-8 without one."""
    start = F.hex(F.substring(content, 1, 3))
    return (
        F.when(start == MARK_UTF8, "UTF-8")
        .when(start.startswith(MARK_UTF16_LE) | start.startswith(MARK_UTF16_BE), "UTF-16")
        .otherwise("UTF-8")
    )


def decode_bytes(df: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """Bytes -> text without mark. Bytes that are no valid text give a null, for the error view."""
    raw = F.col(content)
    as_utf8 = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    digits = F.hex(raw)
    paired = F.when(digits.startswith(MARK_UTF16_LE), digits.rlike(rf"\A{_PAIRED[MARK_UTF16_LE]}\z")).otherwise(
        digits.rlike(rf"\A{_PAIRED[MARK_UTF16_BE]}\z")
    )
    as_utf16 = F.when(paired, F.decode(raw, "UTF-16"))
    decoded = F.when(detected_charset(raw) == "UTF-16", as_utf16).otherwise(as_utf8)
    return df.withColumn(text, F.regexp_replace(decoded, "\\A\ufeff", "")).drop(content)
