"""Stored tables as folders of several files: live sources read them like single files."""

import os

import oracle
import pytest

from threadloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    for name in oracle.TABLES:
        if name in ("conversations", "documents", "events"):
            spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
        else:
            os.symlink(f"{SF}/{name}.parquet", f"{root}/{name}.parquet")
    return str(root)


def same_as_sql(spark, folders, name):
    queries, sql = catalog.load()
    return oracle.compare(spark, oracle.connect(SF), queries[name], sql[name], folders)


def test_fan_out_live_reads_a_folder(spark, folders):
    assert same_as_sql(spark, folders, "fan_out_live") is None


def test_log_sink_reads_a_folder(spark, folders):
    assert same_as_sql(spark, folders, "stream_log_sink") is None


def test_incremental_corpus_reads_a_folder(spark, folders):
    assert same_as_sql(spark, folders, "incremental_corpus") is None


def test_notify_observers_live_reads_a_folder(spark, folders):
    assert same_as_sql(spark, folders, "notify_observers_live") is None
