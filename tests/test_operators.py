import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, graph, joins, mapping, routing, sets, updates


def test_routes_reconcile(spark):
    rows = spark.createDataFrame([(1, 5), (2, 0), (3, -1), (4, None)], "id int, n int")
    n = F.col("n")
    routes = [(n > 0, "up"), (n <= 0, "down"), (n >= 0, "both")]
    every = routing.route(rows, routes, otherwise="rest")
    assert {k: sorted(r.id for r in df.collect()) for k, df in every.items()} == {
        "up": [1], "down": [2, 3], "both": [1, 2], "rest": [4]
    }
    first = routing.route(rows, routes, first_match=True, otherwise="rest")
    assert sum(df.count() for df in first.values()) == rows.count()
    assert first["both"].count() == 0
    for first_match in (False, True):
        routed = routing.route(rows, routes, first_match, "rest")
        labelled = routing.with_route(rows, routes, first_match, "rest")
        assert sorted((r.route, r.id) for r in labelled.collect()) == sorted(
            (k, r.id) for k, df in routed.items() for r in df.collect()
        )
    assert "rest" not in routing.route(rows, routes)


def test_a_null_route_does_not_hide_later_ones(spark):
    rows = spark.createDataFrame([(None, 1)], "a int, b int")
    routed = routing.route(rows, [(F.col("a") > 0, "x"), (F.col("b") > 0, "y")], first_match=True)
    assert routed["y"].count() == 1


def test_errors_split_and_fail(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    error = F.col("t").try_cast("int").isNull() & F.col("t").isNotNull()
    good, bad = routing.split_errors(rows, error)
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(Exception, match="not a number"):
        routing.fail_on_errors(rows, error, "not a number").collect()
    assert routing.fail_on_errors(good, error, "not a number").count() == 2


def test_copy_is_kept_once(spark):
    first, second = routing.copy(spark.range(5), keep=True)
    assert first is second and first.storageLevel.useMemory and first.count() == 5
    first.unpersist()


def test_mapper_paths(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    mapped = mapping.mapper(rows, [("$x.y.z", F.col("id")), ("$x.w", F.col("name"))], root="$doc")
    assert mapped.columns == ["doc"]
    assert mapped.first().asDict(recursive=True) == {"doc": {"x": {"y": {"z": 1}, "w": "a"}}}
    with pytest.raises(ValueError):
        mapping.mapper(rows, [("$x", F.col("id")), ("$x.y", F.col("id"))])
    assert mapping.mapper(rows, [("$id", F.lit(2))], pass_through=True).first().asDict() == {"id": 2, "name": "a"}


def test_increment_overflow(spark):
    rows = spark.createDataFrame([(2**31 - 1,)], "n int")
    assert mapping.increment(rows, "n", "m", tolerant=True).first().m is None
    with pytest.raises(Exception, match="OVERFLOW"):
        mapping.increment(rows, "n", "m").collect()


def test_columns_with_spaces(spark):
    rows = spark.createDataFrame([("1", "A", "P", "2")], "`Order ID` string, `Customer Name` string, `Product Name` string, Quantity string")
    named = mapping.select_columns(rows, ["Order ID", "Quantity"])
    assert mapping.add_constant(named, "Status", "Fulfilled").first().asDict() == {"Order ID": "1", "Quantity": "2", "Status": "Fulfilled"}


def test_empty_flow_has_no_count(spark):
    assert aggregates.row_count(spark.range(0)).collect() == []
    assert aggregates.row_count(spark.range(3)).first().rowCount == 3


def test_assemble_in_parts(spark):
    rows = [("a", i, f"l{i}") for i in range(50)] + [("b", 7, ""), ("b", 3, "x")]
    df = spark.createDataFrame(rows, "doc string, n int, text string").repartition(7)
    for size in (4096, 8, 1):
        got = {r.doc: r.text for r in aggregates.assemble(df, ["doc"], "n", "text", rows_per_part=size).collect()}
        assert got == {"a": "\n".join(f"l{i}" for i in range(50)), "b": "x\n"}


def test_union_fills_missing_fields(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    assert sorted(map(tuple, sets.union(a, b).collect()), key=str) == [(1, 2, None), (4, None, 3)]


def test_update_and_move_keep_all_rows(spark):
    queue = spark.createDataFrame([(1, "new"), (2, "new"), (None, "new")], "id int, status string")
    done = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    updated = updates.update_matched(queue, done, ["id"], {"status": F.lit("complete"), "note": F.lit("n")})
    assert sorted(map(tuple, updated.collect()), key=str) == [(1, "complete", "n"), (2, "new", None), (None, "new", None)]
    log, rest = updates.move_matched(queue, done, ["id"])
    assert log.count() + rest.count() == queue.count() and log.count() == 1


def depths(spark, edges, steps=None):
    links = spark.createDataFrame([("p", a, b) for a, b in edges], "pipeline string, src_id string, dst_id string")
    extra = spark.createDataFrame([("p", s) for s in steps], "pipeline string, step_id string") if steps else None
    found = {r.step_id: r.depth for r in graph.step_depth(links, steps=extra).collect()}
    listed = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in edges])
    within = spark.range(1).select(graph.levels_within(listed, F.array(*map(F.lit, steps or [])).cast("array<string>")).alias("m")).first().m
    assert within == found
    return found


def test_longest_path_levels(spark):
    edges = [("seed", "sprout"), ("water", "sprout"), ("sprout", "leaf"), ("leaf", "bloom"), ("sprout", "root"), ("root", "bloom"), ("bloom", "fruit")]
    levels = {"seed": 0, "water": 0, "sprout": 1, "leaf": 2, "root": 2, "bloom": 3, "fruit": 4}
    assert depths(spark, edges) == levels
    assert depths(spark, edges, ["stone", "fruit"]) == {**levels, "stone": 0}
    assert depths(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b")]) == {"a": 0, "b": 1, "c": 2}


def test_cycles_have_no_level(spark):
    found = depths(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "e"), ("f", "f")])
    assert found == {"a": 0, "e": 1, "b": None, "c": None, "d": None, "f": None}


def test_levels_within_a_record(spark):
    """A long chain, a long cycle, no links at all, links without an end, a step named twice: one job for all."""
    chain = [(f"n{k}", f"n{k + 1}") for k in range(200)]
    rows = [(1, chain, ["n0", "n0", "x"]), (2, [*chain, ("n200", "n0")], ["x"]), (3, [], ["a", None]), (4, None, None), (5, [("a", None), (None, "b"), ("a", "b")], [])]
    table = spark.createDataFrame(rows, "id int, links array<struct<src: string, dst: string>>, steps array<string>")
    got = {r.id: r.m for r in table.select("id", graph.levels_within(F.col("links"), F.col("steps")).alias("m")).collect()}
    assert got[1] == {**{f"n{k}": k for k in range(201)}, "x": 0}
    assert got[2] == {**{f"n{k}": None for k in range(201)}, "x": 0}
    assert (got[3], got[4], got[5]) == ({"a": 0}, {}, {"a": 0, "b": 1})


def plain_kind(text, patterns):
    fits = [(p, w, k) for w, p, k in patterns if w is not None and text is not None and w.lower() in text.lower()]
    return min(fits)[2] if fits else None


def test_classify_by_patterns(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("abcD .%_\nä中") for _ in range(rng.randrange(60)))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "A" * 50_000 + "bcd")]
    patterns = [("".join(rng.choice("abcd .%_ä中") for _ in range(rng.randrange(1, 7))), rng.randrange(5), f"k{n}") for n in range(200)]
    patterns = list({p[0]: p for p in patterns}.values()) + [(None, 0, "none"), ("abcdabcdabcdabcd", 0, "long")]
    table = spark.createDataFrame(texts, "id long, text string").withColumn("priority", F.lit(1)).withColumn("piece", F.lit("x"))
    for some in (patterns, [p for p in patterns if p[0] and len(p[0]) > 3], [("", 9, "all"), ("Dd", 1, "two")], []):
        known = spark.createDataFrame(some, "pattern string, priority int, kind string")
        got = {r.id: r.kind for r in joins.classify_by_patterns(table, F.col("text"), known, "id").collect()}
        assert got == {k: plain_kind(t, some) for k, t in texts}
    plan = joins.classify_by_patterns(table, F.col("text"), known, "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_are_searched_in_different_words(spark):
    """Whole texts are searched only for patterns of several runs, so the work does not grow with texts times patterns."""
    texts = [(k, f"Pre{k % 7}fixed words-{k % 5} und Größe\n{'中文' * (k % 3)}") for k in range(60)] + [(3, "other text, same key: xword"), (None, "words")]
    table = spark.createDataFrame(texts, "id long, text string")
    words = [("fixed", 2, "a"), ("6fix", 1, "b"), ("größe", 9, "c"), ("xword", 0, "d"), ("nowhere", 0, "e"), ("文中", 1, "f")]
    for some, whole in ((words, False), ([*words, ("s-3 und", 0, "g"), ("-", 3, "h"), ("e\n", 1, "i")], True)):
        got = joins.classify_by_patterns(table, F.col("text"), spark.createDataFrame(some, "pattern string, priority int, kind string"), "id")
        want = {(k, plain_kind("\0".join(t for i, t in texts if i == k) if k is not None else None, some)) for k, _ in texts}
        assert {tuple(r) for r in got.select("id", "kind").collect()} == want
        assert whole == ("Contains(_text" in got._jdf.queryExecution().optimizedPlan().toString())


def test_same_result_for_any_partitioning(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    one, many = rows.coalesce(1), rows.repartition(8)
    for op in (
        lambda df: aggregates.conditional_count(df, ["k"], "id", {"n": 3}),
        lambda df: aggregates.distinct_rows(df.select("k")),
        lambda df: aggregates.first_value(df, "id", ["k", "id"], "f"),
    ):
        assert sorted(map(tuple, op(one).collect())) == sorted(map(tuple, op(many).collect()))


def test_mapper_leaves_siblings_of_a_nested_target(spark):
    rows = spark.createDataFrame([(1, (2, (3, 4)), None), (5, None, "x")], "id int, home struct<a: int, b: struct<c: int, d: int>>, t string")
    mapped = mapping.mapper(rows, [("$home.b.c", F.col("id")), ("$home.e", F.lit("new")), ("$extra.deep", F.col("t"))], pass_through=True)
    assert [r.asDict(recursive=True) for r in mapped.orderBy("id").collect()] == [
        {"id": 1, "home": {"a": 2, "b": {"c": 1, "d": 4}, "e": "new"}, "t": None, "extra": {"deep": None}},
        {"id": 5, "home": {"a": None, "b": {"c": 5, "d": None}, "e": "new"}, "t": "x", "extra": {"deep": "x"}},
    ]


def test_mapper_paths_below_a_null(spark):
    rows = spark.createDataFrame([(1, (2,)), (5, None)], "id int, home struct<a: int>")
    safe = mapping.mapper(rows, [("$a", "$home.a")], null_safe=True)
    assert sorted(r.a or 0 for r in safe.collect()) == [0, 2]
    with pytest.raises(Exception, match="below a null"):
        mapping.mapper(rows, [("$a", "$home.a")]).collect()
    assert mapping.mapper(rows.limit(1), [("$a", "$home.a"), ("$id", "$id")]).first().asDict() == {"a": 2, "id": 1}
