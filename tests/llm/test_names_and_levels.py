"""Columns of callers survive working columns of the same name; simhash links are whole at unequal thresholds and crowded keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.llm import common, mixing, simhash, similar


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"text number {i % 5} of some words {i % 5}", "ab"[i % 2], "own", 6, 7) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_src string, mix_slot int, _near_id int")


def test_mixed_keeps_columns(named):
    assert sorted(map(tuple, mixing.mixed(named).collect())) == sorted(map(tuple, named.collect()))


def test_mix_replaces_columns_of_its_names(named):
    got = mixing.mix(named)
    assert got.columns == ["doc_id", "text", "source", "mix_src", "_near_id", "mix_slot", "mix_block", "mix_order"]
    assert {r.mix_src for r in got.collect()} == {"own"}


@pytest.mark.parametrize("keep", [simhash.keep_first, similar.keep_first])
def test_near_dedup_keeps_columns(named, keep):
    got = keep(named).collect()
    assert got and keep(named).columns == named.columns and {(r._near_id, r.mix_slot) for r in got} == {(7, 6)}


def _classes(fps, limit):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in fps}


@pytest.mark.parametrize(("ts", "hot"), [((1, 0, 1), 2048), ((-1, 3, 0), 8)])
def test_links_at_unequal_thresholds(spark, ts, hot):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 25).tolist()
    fps = {b ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 6), replace=False)) for b in base for _ in range(8)}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    parts = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    assert sum(ts) == 4 - 3 + 1
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, hot=hot, plan=(parts, list(ts)))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    plain = _classes([x & (1 << 64) - 1 for x in fps], 4)
    sets = {}
    for x, c in plain.items():
        sets.setdefault(c, set()).add(x)
    mine = {}
    for x in fps:
        mine.setdefault(got.get(x, x), set()).add(x & (1 << 64) - 1)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, sets.values()))


def test_joins_to_one_row_per_key(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1900).alias("k"), "id")
    one = many.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    got = common.join_one(many, one, "k", 5000)
    want = many.join(one.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_no_machine_local_folder_on_a_cluster():
    class Fake:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        common.shared_folder(Fake)
