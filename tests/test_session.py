"""Sizing of shuffles and the scratch folder."""

import pytest

from fareloom import session
from fareloom.plans.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


def test_one_setting_sizes_every_shuffle(spark, capsys):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert session.SETTINGS[key] == str(session.INITIAL_PARTITIONS)
    assert session.cluster_settings(7)[key] == "7"
    before = spark.conf.get(key)
    spark.conf.set(key, "37")
    try:
        for name in ("check_duplicates", "int_trips"):
            capsys.readouterr()
            all_queries()[name](spark, FOLDER).explain()
            assert "hashpartitioning(trip_id" in (plan := capsys.readouterr().out)
            assert ", 37)" in plan[plan.index("hashpartitioning(trip_id") :][:60]
    finally:
        spark.conf.set(key, before)


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two
    assert shared is None or one.startswith(shared)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster, "x")
