from millrace.llm import licenses
from tests.llm.odd import TEXTS, docs


def scan(spark, texts):
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    return {r.doc_id: r for r in licenses.scanned(docs(spark, rows)).collect()}


def test_spellings_case_and_copyright_lines_do_not_matter(spark):
    mit = licenses.MIT
    texts = [
        mit,
        "Copyright (c) 2019 Some One\n" + mit,
        mit.replace("MIT License\n", "The MIT License\n\nCopyright © 2001-2004, A. B. and others. All rights reserved.\n").replace("The MIT", "MIT"),
        mit.upper().replace(" ", "\n * "),
        mit.replace("sublicense", "sublicence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
        mit + " More text.",
        licenses.BSD_TOP + licenses.BSD_NAMES + licenses.BSD_END,
        licenses.ISC,
        "Some text.\nLicenced under the APACHE license, version 2.0\nReleased under the MIT Licence.\nlicensed under the Apache License, Version 2.0.",
    ]
    got = scan(spark, texts)
    assert [got[k].license_id for k in range(9)] == ["MIT", "MIT", "MIT", "MIT", "MIT", None, "BSD-3-Clause", "ISC", None]
    assert got[8].notices == ["Apache-2.0", "MIT"] and got[0].notices == []


def test_headers_of_any_form(spark):
    headers = [
        "Copyright (c) Microsoft Corporation.",
        "Copyright (c) Jane Doe 2019",
        "Copyright (c) Acme. All rights reserved.",
        "(c) the authors, 2004",
        "© Some One",
        "Copyright by the Board of Trustees",
        "# Copyright: 1999, 2003 A. B.\nAll Rights Reserved.",
        "Copyright Jane Doe 2019-2021",
    ]
    got = scan(spark, [f"{h}\n\n{licenses.MIT}" for h in headers])
    assert [got[k].license_id for k in range(len(headers))] == ["MIT"] * len(headers)


def test_lines_of_a_licence_are_no_headers(spark):
    text = licenses.BSD_TOP + licenses.BSD_END
    wrapped = text.replace("above copyright notice", "above\ncopyright notice").replace("THE COPYRIGHT HOLDERS", "THE\nCOPYRIGHT HOLDERS")
    assert wrapped.count("\n") > text.count("\n") + 2
    got = scan(spark, [wrapped, text + "\ncopyright is kept by others"])
    assert [got[0].license_id, got[1].license_id] == ["BSD-2-Clause", None]


def test_spellings_beside_each_other(spark):
    got = scan(spark, ["licence licence sublicence", "License, license (sublicense)", "license license sublicence licence"])
    assert got[0].digest == got[1].digest != got[2].digest


def test_odd_rows(spark):
    rows = licenses.scanned(docs(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.license_id for r in rows} == {None}
    assert len({r.digest for r in rows if r.doc_id in (1, 2, 3)}) == 1
    twice = [(1, "Released under the MIT License.", "en", "a")] * 2
    assert [r.notices for r in licenses.scanned(docs(spark, twice)).collect()] == [["MIT"]] * 2
    assert licenses.scanned(docs(spark, [])).count() == 0
