"""Jobs and rounds of the near-duplicate join."""

import uuid

import numpy as np

from plantwatch.llm import components
from plantwatch.llm.ngram_join import near_duplicates


def jobs(spark, partitions, docs):
    group = uuid.uuid4().hex
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, "near duplicates")
        rows = sorted(map(tuple, near_duplicates(docs).collect()))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), rows
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_jobs_do_not_grow_with_the_partitions(spark):
    words = [" ".join(f"w{d}x{i}" for i in range(60)) for d in range(6)]
    docs = spark.createDataFrame([(k, words[k % 6] + (f" end{k}" if k > 5 else "")) for k in range(18)], "doc_id long, text string").coalesce(2)
    few, rows = jobs(spark, 4, docs)
    many, same = jobs(spark, 60, docs)
    assert rows == same and [r[3] for r in rows] == [k % 6 for k in range(18)]
    assert many <= few + 20


def test_components_of_stars_take_no_round(spark):
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 9), (5, 8), (8, 5), (4, 4), (None, 7)], "u long, v long")
    stars = sorted(map(tuple, components.connected_components(edges).collect()))
    assert stars == [(1, 1), (2, 1), (3, 1), (5, 5), (8, 5), (9, 1)]
    assert components._stars_apart(edges.where("u > v and u = 3"))
    for pairs in ([(3, 2), (2, 1)], [(3, 1), (3, 2)], [(3, 2), (2, 1), (9, 8)]):
        assert not components._stars_apart(spark.createDataFrame(pairs, "u long, v long"))
    assert components._stars_apart(edges.where("false")) and components.connected_components(edges.where("false")).isEmpty()


def test_components_of_long_paths_and_random_edges(spark):
    rng = np.random.default_rng(3)
    path = rng.permutation(40).tolist()
    pairs = list(zip(path, path[1:], strict=False)) + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    up = {x: x for e in pairs for x in e}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    joined = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: up[x] for x in joined}
