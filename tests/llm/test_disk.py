"""What joins leave on the disk, and how often they write."""

import random
import time

from tickloom.llm import common, ngram_join


def kept(spark) -> int:
    return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))


def test_shuffles_go_when_their_action_ends(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    before = kept(spark)
    rows = spark.range(1000).repartition(7, "id")
    held = [rows, done := common.cut(rows), common.bit_filter(done, "id", 15)]  # held, so that no collection of garbage removes anything
    until = time.time() + 10
    while kept(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert kept(spark) <= before and held[1].count() == 1000 and rows.count() == 1000
    assert spark.conf.get(key) == setting


def test_stars_take_one_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: cuts.append(1) or cut(df))
    got = common.components(spark.createDataFrame([(i, i % 3) for i in range(40)], "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, i % 3) for i in range(40)]
    assert len(cuts) <= 4


def test_chunks_link_to_the_least(spark):
    import numpy as np

    rng, base = random.Random(2), np.arange(100, dtype=np.uint64)
    hashes = rng.sample(range(-1000, 1000), 30)
    members = [(h, np.concatenate([base[: 95 if k % 3 else 40], base[:5] + np.uint64(1000 * (k % 5))])) for k, h in enumerate(hashes)]
    got = ngram_join.chunk_links(members)
    assert len({a for a, _ in got}) == len(got) and not {a for a, _ in got} & {b for _, b in got}
    assert all(a > b for a, b in got)
