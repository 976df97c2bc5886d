"""Connected components against union-find, and how many tasks they take."""

import random

import pytest

from millrace.llm.components import components
from tests.llm.test_near_dups import roots


@pytest.mark.parametrize("task_links", [1 << 17, 100, 0])
def test_components(spark, task_links):
    rng = random.Random(7)
    some = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(250)]
    for links in ([], [(1, 1), (None, 2)], [(k + 1, k) for k in range(60)], some):
        table = spark.createDataFrame(links, "a long, b long")
        whole = [(a, b) for a, b in links if a is not None and b is not None]
        want = {k: r for k, r in roots(whole, sorted({x for pair in whole for x in pair})).items() if k != r}
        assert {r.node: r.root for r in components(table, task_links=task_links).collect()} == want


def test_few_links_take_few_tasks(spark):
    """The rounds over few links are not dealt out over all shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("few links", "components")
        assert components(spark.range(100).selectExpr("id AS a", "id + 1 AS b")).count() == 100
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
        assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 8 * 64
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
