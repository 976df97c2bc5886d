"""Rows that every operator must take: nulls everywhere, blank and long texts, repeated rows, columns with clashing names."""

import re

EXTRA = "fingerprint text_hash shard mix h bytes kept root part copy place size target letter base found digest".split()
EXTRA += "id hash copies cell depth rates order at label key node __ID __hash __n __source __RATE __Cell __depth __LETTER".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = [
    (None, None, None, None),
    (None, "one two three four five six", "en", "a"),
    (1, None, "en", "a"),
    (2, "", "en", "b"),
    (3, " \t\n\r ", "de", "b"),
    (4, "word", None, "b"),
    (4, "word", None, "b"),
    (4, "another text under the same id", "de", None),
    (5, LONG, "en", "é"),
    (6, LONG + " end", "en", "é"),
    (7, "Zahl 12345 und mehr ___ !!!", "de", "a"),
    (8, "12345 67890", "en", "a"),
    (9, "word", "en", "z"),
]


def docs(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, lang, s, 0, *EXTRA) for i, t, lang, s in rows], SCHEMA)


def words(text):
    return WORD.findall(text or "")
