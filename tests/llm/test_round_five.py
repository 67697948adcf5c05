"""How many tasks linking takes: with many shuffle partitions their overhead outgrows a small table."""

import random

from riskloom.llm import graph


def counted(spark, run):
    """What ``run`` returns, and the tasks it took."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"count-{random.random()}", name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds}
    return out, sum(x.numCompletedTasks for x in map(status.getStageInfo, stages) if x)


def paths(n, long):
    """Links of n paths of ``long`` nodes whose numbers are shuffled, and each node's root."""
    r, edges, root = random.Random(n), [], {}
    numbers = r.sample(range(-(10**6), 10**6), n * long)
    for k in range(n):
        nodes = numbers[k * long : (k + 1) * long]
        edges += zip(nodes, nodes[1:])
        root |= dict.fromkeys(nodes, min(nodes))
    return edges, root


def test_components_take_few_tasks(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    edges, root = paths(30, 12)
    links = spark.createDataFrame(edges, "a long, b long").repartition(40)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got, tasks = counted(spark, lambda: {r.node: r.root for r in graph.components(links).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == root
    assert tasks < 1500
