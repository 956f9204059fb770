import pytest

from martloom.sources import storage
from martloom.sources.storage import Folder


class FakeConf:
    def get(self, key, default=None):
        return default


class FakeSession:
    """A session on a cluster, without a checkpoint folder."""

    conf = FakeConf()

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Context:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            isDefined = staticmethod(lambda: False)
                        return Nothing
                return Context


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(FakeSession(), "x")
    assert storage.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_new_files_are_written_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert folder.write_new("a/1", "first") and not folder.write_new("a/1", "second")
    assert folder.read_text("a/1") == "first" and [n for n, _ in folder.list() if not n.endswith(".crc")] == ["a"]
