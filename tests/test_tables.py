"""SELECTs and table functions that run for each row, against plain loops."""

import pytest

from millrace.sources.tables import TableFunction, literal_rows, same_key, sql_query

PEOPLE = [(1, "ann", 10), (2, "bob", 0), (3, "cy", 5), (None, "dee", 0), (2, "bob", 0)]
PAID = [(1, 5, "a"), (1, 15, "b"), (1, 20, "c"), (2, 1, "d"), (2, 1, "e"), (2, 7, "f"), (None, 9, "g"), (4, 9, "h")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, least int")


@pytest.fixture
def paid(spark):
    return spark.createDataFrame(PAID, "id int, amount int, what string")


def most_of(person, n=2):
    own = [p for p in PAID if p[0] is not None and p[0] == person[0] and p[1] > person[2]]
    return sorted(own, key=lambda p: (-p[1], p[2]))[:n]


SQL = f"SELECT amount, what FROM {{paid}} AS p WHERE {same_key('p.id', 'input.id')} AND amount > input.least ORDER BY amount DESC, what LIMIT 2"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_for_each_row(spark, people, paid):
    """Repeated rows, null keys, rows without a result; order and limit hold for each row."""
    got = sql_query(spark, SQL, input=people, pass_through=True, paid=paid)
    assert got.columns == ["id", "name", "least", "amount", "what"]
    want = [(*p, *(m[1:])) for p in PEOPLE for m in most_of(p) or [(None, None, None)]]
    assert rows(got) == sorted(want, key=repr)
    got = sql_query(spark, SQL, input=people, pass_through=True, keep_empty=False, paid=paid)
    assert rows(got) == sorted(((*p, *m[1:]) for p in PEOPLE for m in most_of(p)), key=repr)
    got = sql_query(spark, SQL, input=people, keep_empty=False, paid=paid)
    assert got.columns == ["amount", "what"] and rows(got) == sorted((m[1:] for p in PEOPLE for m in most_of(p)), key=repr)
    assert sql_query(spark, SQL, input=people.limit(0), pass_through=True, paid=paid).count() == 0


def test_result_takes_the_place_of_a_field(spark, people, paid):
    sql = f"SELECT count(*) AS NAME FROM {{paid}} AS p WHERE {same_key('p.id', 'input.id')} AND amount >= :least"
    got = sql_query(spark, sql, {"least": 7}, input=people, pass_through=True, paid=paid)
    assert got.columns == ["id", "least", "NAME"]
    assert rows(got) == sorted([(1, 10, 2), (2, 0, 1), (2, 0, 1), (3, 5, 0), (None, 0, 0)], key=repr)


def test_all_pairs_are_refused(spark, people, paid):
    with pytest.raises(ValueError, match="same_key"):
        sql_query(spark, "SELECT what FROM {paid} WHERE amount > input.least", input=people, paid=paid)
    # a plain equality beside another condition makes Spark try that one on all pairs first
    with pytest.raises(ValueError, match="same_key"):
        sql_query(spark, SQL.replace(same_key("p.id", "input.id"), "p.id = input.id"), input=people, paid=paid)


def test_table_function(spark, people, paid):
    best = TableFunction(
        spark, "best_paid", "person INT, least INT", "amount INT, what STRING",
        f"SELECT amount, what FROM {{paid}} WHERE {same_key('id', 'person')} AND amount > least ORDER BY amount DESC, what LIMIT 2", paid=paid,
    )
    assert rows(best(1, 10)) == [(15, "b"), (20, "c")] and rows(best(9, 0)) == [] and rows(best(None, 0)) == []
    got = best.for_each(people, "input.id", "input.least")
    assert rows(got) == sorted([(*p, *m[1:]) for p in PEOPLE for m in most_of(p) or [(None, None, None)]], key=repr)
    total = TableFunction(spark, "best_total", "person INT", "total BIGINT", "SELECT sum(amount) FROM best_paid(person, 0)")
    got = total.for_each(people.select("id").distinct(), "input.id", pass_through=True)
    assert rows(got) == sorted([(1, 35), (2, 8), (3, None), (None, None)], key=repr)
    assert rows(spark.sql("SELECT n.id, f.* FROM VALUES (1), (2) AS n(id), LATERAL best_total(n.id) AS f")) == [(1, 35), (2, 8)]
    for function in (total, best):
        function.drop()


def test_no_literal_rows(spark):
    empty = literal_rows(spark, [], "a int, b array<string>")
    assert empty.collect() == [] and empty.dtypes == [("a", "int"), ("b", "array<string>")]
