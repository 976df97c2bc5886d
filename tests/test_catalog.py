import json

import pytest
from pyspark.sql import functions as F

from millrace.catalog import exports, strip
from millrace.operators.graph import step_depth
from millrace.operators.routing import triage
from millrace.plans.intake import catalog, files_with_text, quarantine_names, steps_in_order
from millrace.sources.exports import read_pipeline_exports
from millrace.sources.files import read_binary


def step(i, cls, label, settings, **more):
    properties = {"info": {"label": {"value": label}}, "settings": settings, "view_serial": 100}
    return {"class_id": f"com-example-{cls}", "instance_id": i, "instance_version": 1, "property_map": properties, **more}


#: A survey's answers are scored, the weak ones set apart, and both kinds written: steps in no order, one of them without a link.
SURVEY = {
    "class_fqid": "com-example-pipeline_9",
    "link_map": {
        f"edge-{a}{b}": {"src_view_id": "output0", "dst_view_id": "input0", "src_id": a, "dst_id": b, "isGoto": a == "sift"}
        for a, b in [("sift", "weak"), ("ask", "score"), ("rates", "score"), ("score", "sift"), ("sift", "keep"), ("weak", "mail"), ("keep", "mail")]
    },
    "property_map": {
        "info": {"label": {"value": "score  answers?"}},
        "settings": {"param_table": {"value": [
            {"key": {"value": "Region"}, "value": {"value": "north"}, "required": {"value": True},
             "data_type": {"value": "string"}, "description": {"value": None}, "capture": {"value": False}},
            {"key": {"value": "since"}, "value": {"value": "$since"}, "data_type": {"value": "date"}},
        ]}},
    },
    "render_map": {"detail_map": {"ask": {"grid_x_int": 7}}},
    "snap_map": {
        "mail": step("mail", "notify-post", "Post letter", {"copies": {"value": 2}, "bcc": {"value": None}}),
        "score": step("score", "transform-datatransform mapper", "Points", {"rules": {"value": {"list": {"value": [{"x": 1, "by": {"y": 2, "z": None}}]}}}}),
        "ask": step("ask", "web-form", "Answers", {"url": {"expression": True, "value": "_host + '/form'"}}, view={"x": 1}),
        "weak": step("weak", "sqlserver-insert", " Weak ones", {}),
        "note": step("note", "canvas-note", "Remark", {"lines": {"value": []}, "deep": {"color": "red", "kept": {"height": 1}}}),
        "rates": step("rates", "csvparser", "Rates", {"delimiter": {"value": ";"}, "width": {"value": 3}}),
        "sift": step("sift", "flow-sieve", "Sieve", {"least": {"value": 0.5}}),
        "keep": step("keep", "flow-heap", "Heap", {"passThrough": {"value": True}}),
    },
}

ODD = {
    "info": {"title": "", "label": {"value": "In/ner"}},
    "job_stats": {"n": 1},
    "snaps": [
        {"name": "Named", "class_id": "c1", "settings": {"a": 1, "b": {"value": "x"}}, "view": {"x": 1}},
        {"name": "Unknown", "instance_id": "id1", "settings": {"not": "used"}, "property_map": {"settings": {"y": {"value": 2}}}},
        {"property_map": {"info": {"label": "text"}}},
        {"property_map": {"info": {"label": {"value": None}}}},
        {"instance_id": "id2"},
        {},
        {"name": "", "property_map": {}},
    ],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "score_sanitized.json").write_text(json.dumps(SURVEY))
    (tmp_path / "odd.json").write_text(json.dumps(ODD))
    (tmp_path / "bare_sanitized.json").write_text('{"snaps": []}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "cut.json").write_text(json.dumps(SURVEY)[:-1])
    (tmp_path / "bytes.json").write_bytes(b'{"snaps": "\xff"}')
    (tmp_path / "temp_sanitized_x.json").write_text(json.dumps(ODD))
    return str(tmp_path)


def by_file(rows):
    return sorted((r[0].rsplit("/", 1)[1], *r[1:]) for r in rows)


def test_intake(spark, folder):
    found = catalog(files_with_text(read_binary(spark, folder)))
    assert by_file(found.pipelines.collect()) == [
        ("bare_sanitized.json", "bare"), ("odd.json", "In_ner"), ("score_sanitized.json", "score_answers_")
    ]
    assert by_file(found.junk.select("path").collect()) == [("bytes.json",), ("cut.json",), ("list.json",)]
    named = by_file(found.steps.select("path", "position", "name", "kind").collect())
    assert [r[1:] for r in named if r[0].startswith("score")] == [
        (0, "Post letter", None), (1, "Points", "mapper"), (2, "Answers", None), (3, " Weak ones", "sqlserver-insert"),
        (4, "Remark", None), (5, "Rates", "csvparser"), (6, "Sieve", None), (7, "Heap", None),
    ]
    assert sorted(named, key=lambda r: r[:2]) and [
        r[2] for r in sorted((x for x in named if x[0] == "odd.json"), key=lambda r: r[1])
    ] == ["Named", "id1", "Unknown", None, "id2", "Snap", ""]
    ordered = steps_in_order(found).filter(F.col("path").contains("score"))
    levels = {"ask": 0, "rates": 0, "note": 0, "score": 1, "sift": 2, "weak": 3, "keep": 3, "mail": 4}
    assert {r.step_id: r.depth for r in ordered.collect()} == levels
    apart = step_depth(found.links, graph="path", steps=found.steps).filter(F.col("path").contains("score"))
    assert {r.step_id: r.depth for r in apart.collect()} == levels
    within = exports.levels(found.docs).filter(F.col("path").contains("score"))
    assert {r.step_id: r.depth for r in within.collect()} == levels
    assert found.links.count() == 7
    assert by_file(found.parameters.drop("path").select(F.lit("/p"), "*").collect()) == [
        ("p", 0, "Region", "north", "string", None, True, False), ("p", 1, "since", "$since", "date", None, None, None)
    ]


def test_triage_loses_nothing(spark, folder):
    files = files_with_text(read_binary(spark, folder))
    valid, junk = triage(files)
    assert valid.count() == 3 and valid.count() + junk.count() == files.count()


def test_settings(spark, folder):
    found = catalog(read_pipeline_exports(spark, folder, "*.json").filter(~F.col("path").contains("bytes")))
    rows = {(r.step_id, r.setting): (r.is_expression, r.value) for r in found.settings.collect()}
    assert rows[("ask", "url")] == (True, "_host + '/form'")
    assert rows[("mail", "copies")] == (False, "2") and rows[("sift", "least")] == (False, "0.5")
    assert rows[("note", "lines")] == (False, "[]")
    assert rows[(None, "a")] == (False, "1")
    assert ("id1", "not") not in rows and rows[("id1", "y")] == (False, "2")


def test_layout(spark, folder):
    files = read_pipeline_exports(spark, folder, "*d.json")
    rows = {r.path.rsplit("/", 1)[1]: r for r in exports.step_layout(files).collect()}
    assert rows["odd.json"].layout == "list" and rows["odd.json"].n_steps == 7
    assert rows["odd.json"].first_step_keys == "name,class_id,settings,view"
    load = rows["score_sanitized.json"]
    assert (load.layout, load.n_steps, load.property_keys) == ("map", 8, "info,settings")


def pruned(node):
    if isinstance(node, dict):
        return {k: pruned(v) for k, v in node.items() if k not in strip.DEEP_KEYS}
    return [pruned(v) for v in node] if isinstance(node, list) else node


def test_strip(spark):
    plain = {"snaps": [{"view": 1, "x": 2, "settings": {"view": 3}}], "x": 4, "view": 5}
    texts = [json.dumps(d) for d in (SURVEY, ODD, plain, [1], "ä")] + ["{", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = [r.text and json.loads(r.text) for r in strip.strip_layout(rows).orderBy("i").collect()]
    want = {k: v for k, v in SURVEY.items() if k != "render_map"}
    want["snap_map"] = {k: pruned(v) for k, v in SURVEY["snap_map"].items()}
    assert out[0] == want and list(out[0]["snap_map"]) == list(SURVEY["snap_map"])
    assert out[1]["snaps"][0] == {k: v for k, v in ODD["snaps"][0].items() if k != "view"} and "job_stats" not in out[1]
    assert out[2] == {"snaps": [{"x": 2, "settings": {"view": 3}}], "x": 4, "view": 5}
    assert out[3:] == [None] * 4
    assert "view_serial" in out[0]["snap_map"]["mail"]["property_map"]


def innermost(node, place=""):
    if isinstance(node, dict) and node:
        for k, v in node.items():
            yield from innermost(v, f"{place}.{k}" if place else k)
    elif isinstance(node, list) and node:
        for i, v in enumerate(node):
            yield from innermost(v, f"{place}[{i}]")
    else:
        yield place


def test_inner_values(spark):
    rows = spark.createDataFrame([("f", json.dumps(SURVEY))], "path string, text string")
    steps = exports.minimised_steps(exports.parse_exports(rows, fields=exports.STEP_FIELDS))
    found = strip.layout_free_values(steps).collect()
    for name, source in SURVEY["snap_map"].items():
        have = {r.place for r in found if r.step_id == name} - {""}
        want = set(innermost(pruned(source["property_map"]["settings"]))) - {""}
        # An object whose keys were all canvas data has no inner value left.
        assert have == {w for w in want if w != "deep.kept"}
    assert sorted(map(str, strip.layout_free_values(steps, levels=1).collect())) == sorted(map(str, found))


def test_quarantine_names(spark):
    junk = spark.createDataFrame([("/in/a.txt", 1), ("/in/b/a.txt", 2), ("/in/c.txt", 3)], "path string, at int")
    taken = spark.createDataFrame([("a.txt",), ("a_2.txt",)], "file_name string")
    named = quarantine_names(junk, ["at"], taken).orderBy("at")
    assert [r.unique_name for r in named.collect()] == ["a_1.txt", "a_3.txt", "c.txt"]


def test_odd_documents_are_null(spark):
    deep = '{"snap_map":' + '{"a":' * 30000
    texts = ['{"snaps":[{"name":"\\ud800"}]}', deep + "1" + "}" * 30000, "[1]", None, '{"snaps":[],"job_stats":1}', "[" * 5000 + "]" * 5000]
    texts += [deep + t + "}" * 30001 for t in ('"\\ud800"', "1,", '1,"b"', '1,"b":', "[1,]", "[1 2]", "01", "tru", '"a', "")]
    texts += [deep + "1" + "}" * 30001 + "}", deep + "1" + "}" * 30001 + " {}"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: r.text for r in strip.strip_layout(files).collect()}
    assert got.pop("4") == '{"snaps":[]}' and set(got.values()) == {None}


@pytest.mark.parametrize("levels", [10, 3000, 60000])
def test_strip_at_any_depth(spark, levels):
    inner = '[1, 2.50 ,{"z" : "\\u00e4\\n", "x":[{}], "a":[ ] , "t": {"view":1}}, null, true, -1e3]'
    text = '{"job_stats":{}, "snap_map":{"s":' + '{"b":0, "color":[[1]], "a":[' * levels + inner + "] }" * levels + "}}\n"
    want = '{"snap_map":{"s":' + '{"b":0,"a":[' * levels + '[1,2.5,{"z":"ä\\n","a":[],"t":{}},null,true,-1000.0]' + "]}" * levels + "}}"
    files = spark.createDataFrame([("p", text)], "path string, text string")
    assert strip.strip_layout(files).first().text == want


def test_values_at_any_depth(spark):
    deep = '{"a":' * 25 + "[[1,{\"x\":5}],[]]" + "}" * 25
    files = spark.createDataFrame([("p", '{"snaps":[{"name":"s","settings":' + deep + "}]}")], "path string, text string")
    steps = exports.minimised_steps(exports.parse_exports(files, fields=exports.STEP_FIELDS))
    want = [(".".join("a" * 25) + "[0][0]", "1"), (".".join("a" * 25) + "[1]", "[]")]
    for levels in (3, 6, 40):
        got = sorted((r.place, r.value) for r in strip.layout_free_values(steps, levels=levels).collect())
        assert got == want


def test_levels_are_planned_alike_for_every_depth(spark):
    scans = []
    for n in (3, 30):
        links = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}") for i in range(n)] + [("short", "a", "b")], "pipeline string, src_id string, dst_id string")
        levels = step_depth(links)
        assert {r.step_id: r.depth for r in levels.collect() if r.pipeline == "g"} == {f"n{i}": i for i in range(n + 1)}
        scans.append(levels._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert scans[0] == scans[1] <= 4


def test_documents_are_tested_where_they_are_dealt_to(spark, tmp_path):
    """A filter on rendered documents does not go below the step that deals out the rows of a small file."""
    from queries.catalog import key_profile

    rows = [(k, f"name {k}", f"Brand#{k}", "TIN", k % 50) for k in range(200)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = key_profile(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Repartition" not in plan
    assert {r.key: r.n_files for r in got.collect()} == dict.fromkeys(
        ["class_fqid", "instance_id", "instance_version", "link_map", "link_serial", "property_map", "render_map", "snap_map", "info", "job_stats", "snaps"], 100
    )
