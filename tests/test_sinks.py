import pytest

from tidemill.operators import members
from tidemill.sources import files
from tidemill.streaming import runs


def test_local_copies_and_console(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\xff" * 1000)
    files.save_locally(spark, str(tmp_path / "a.bin"), str(tmp_path / "copy"))
    assert (tmp_path / "copy").read_bytes() == b"\x00\xff" * 1000
    with pytest.raises(FileExistsError):
        files.save_locally(spark, str(tmp_path / "a.bin"), str(tmp_path / "copy"))
    spark.createDataFrame([("k", "printed")], "key string, value string").write.parquet(str(tmp_path / "in"))
    runs.run_to_console(spark.readStream.schema("key string, value string").parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == 1  # the JVM prints the batch


def test_configurations_and_traffic(spark, tmp_path):
    known = [(2, "b.x", "1.2", "b.log"), (1, "a.x", "1.1", None)]
    files.write_machines(spark.createDataFrame(known, "vm int, hostname string, ip string, log_file string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.machines(spark, str(tmp_path / "c")).collect()) == sorted(known)
    messages = spark.createDataFrame([("a", "b", 5), ("a", "a", None), (None, "b", 2)], "sender string, receiver string, bytes long")
    assert sorted(map(tuple, members.traffic(messages).collect())) == [("a", 2, 5, 1, 0), ("b", 0, 0, 2, 7)]
