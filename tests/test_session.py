from types import SimpleNamespace

import pytest

from sortament import session


def stub(master, **conf):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: {}, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(stub(master))
    assert session.ensure_checkpoint_dir(stub("yarn", **{"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"


def test_one_process_gets_one_folder():
    for master in ("local", "local[4]", "local[*]"):
        assert session.ensure_checkpoint_dir(stub(master)) == session.ensure_checkpoint_dir(stub(master))


def test_tables_can_be_discarded(spark):
    table = session.materialise(spark.range(5))
    assert session.is_table(table) and not session.is_table(table.select("id")) and table.count() == 5
    session.discard(table)
    with pytest.raises(Exception, match="(?i)not exist|no such|FILE_NOT"):
        spark.read.parquet(table._sortament_path).count()
