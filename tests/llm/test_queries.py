"""The queries of the text part against their SQL, and the pipeline stage by stage against plain versions."""

import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language
from millrace.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm import odd
from tests.llm.test_decontamination import expected
from tests.llm.test_mixing import targets
from tests.llm.test_near_dups import print_of, roots
from tests.llm.test_similar import check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, FOLDER)
    table = "pages" if name.startswith("op2_") else "documents"
    if name in ORACLES:
        assert difference(result, connect(FOLDER), ORACLES[name]) is None
    else:
        assert result.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_fingerprints_of_the_table(spark):
    rows = QUERIES["op1_simhash"](spark, FOLDER).collect()
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    prints = {k: print_of(t) for k, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    own = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in rows} == roots(pairs, own)


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "12 34 ...", "en", "a", 9)], docs.schema))
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert kept[-1].columns == columns if name != "sharding" else set(columns) < set(kept[-1].columns)
    rows = [[(r.doc_id, r.text, r.lang, r.source) for r in k.select(columns[:4]).collect()] for k in kept]
    ids = [{r[0] for r in k} for k in rows]
    # language: what has no letter goes
    assert ids[1] == ids[0] - {10**6, 10**6 + 1}
    # near copies: by brute force, no two that stay are alike, and what goes is like one that stays
    check({i: t for i, t, *_ in rows[1]}, ids[2])
    assert len(rows[2]) == len(ids[2]) < len(rows[1])
    # decontamination
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    assert ids[3] == ids[2] - {i for i, _ in expected(rows[2], items)} < ids[2]
    # mixing: sources come near their targets
    sizes, taken = {}, {}
    for _, t, _, s in rows[3]:
        sizes[s] = sizes.get(s, 0) + len(odd.words(t))
    for _, t, _, s in rows[4]:
        taken[s] = taken.get(s, 0) + len(odd.words(t))
    want = targets(sizes)
    assert sum(taken.values()) == pytest.approx(float(sum(want.values())), rel=0.25)
    assert all(taken.get(s, 0) <= 3 * sizes[s] for s in sizes)
    # sharding keeps every row
    assert sorted(rows[5], key=repr) == sorted(rows[4], key=repr)


def test_pipeline_of_odd_documents(spark, tmp_path):
    odd.docs(spark).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 4, 5, 7}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_clean_documents_stay(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50)) + "x" for _ in range(120)), "en", "a") for k in range(150)]
    table = odd.docs(spark, rows)
    assert language.keep_identified(table, language.train(table), corpus_pipeline.MIN_SCORE).count() == 150
    assert corpus_pipeline.drop_near_copies(spark, table, "").count() == 150


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """A driver that knows the repository, and workers that don't."""
    script = tmp_path / "away.py"
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    script.write_text(
        "import sys\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"sys.path.insert(0, {repo!r})\n"
        "from millrace.llm.queries import QUERIES\n"
        f"print([QUERIES[n](spark, {FOLDER!r}).count() for n in ('op2_main_text', 'op5_token_counts', 'op10_quality')])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    pages, docs = (spark_free_count(t) for t in ("pages", "documents"))
    assert str([pages, docs, docs]) in done.stdout, done.stderr[-2000:]


def spark_free_count(name):
    return duckdb.connect().execute(f"SELECT count(*) FROM '{FOLDER}/{name}.parquet'").fetchall()[0][0]
