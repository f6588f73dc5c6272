import pytest

from bandwright import session
from bandwright.plans import base


def test_cut_and_release(spark):
    t = session.cut(spark.range(3))
    assert t.count() == 3 and session.exists(spark, t._cut)
    session.release(t, spark.range(1))
    assert not session.exists(spark, t._cut)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077", "applicationId": "a"})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())


def test_kept_is_made_anew_when_a_table_changes(spark, tmp_path):
    d, made = str(tmp_path), []

    def make():
        made.append(1)
        return session.load(spark, d, "t")

    for n in (2, 2, 5):
        if n != len(made) + 1 or not made:
            spark.range(n).write.mode("overwrite").parquet(f"{d}/t.parquet")
        assert base.kept(spark, d, "x", make).count() == n
    assert len(made) == 2
