import pytest

from tessella import session


class Other:
    """A session elsewhere."""

    def __init__(self, master, named):
        self.sparkContext, self.conf, self.named = self, self, named
        self.master = master

    def get(self, key, default):
        return self.named if key == "spark.checkpoint.dir" else default


def test_shared_dir(spark):
    assert session.shared_dir(Other("yarn", "hdfs:///x/")) == "hdfs:///x" and session.shared_dir(Other("local[2]", "")).startswith("file://")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(Other(master, ""))
    assert session.shared_path(spark, "a") != session.shared_path(spark, "a")
