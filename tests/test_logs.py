"""A log cut at every byte, read in ranges of any size, and polled as a stream while it grows."""

import pytest

from scholia.streaming import logs as L

LOG = "start\r\nIter 1: Train loss 2.5, Peak mem 1.5 GB\nIter 1: Train loss 9.9\n\nIter 2: Train loss nan\nIter 10: Saved adapter weights to x\nMất điện — Peak memory (GB): 900 MB\nIter 2: Train loss 1.25\nIter 3: Train lo".encode()


def poll(path, start, size, final=False):
    r = L.LogReader({"path": str(path), "bytes": size, "final": final})
    end = r.latestOffset()
    return end, [row for p in r.partitions(start, end) for row in r.read(p)]


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1 << 20])
def test_cut_at_every_byte(tmp_path, size):
    want = [line.removesuffix("\r") for line in LOG.decode().split("\n")]
    for cut in range(len(LOG) + 1):
        path = tmp_path / f"log-{size}-{cut}"
        path.write_bytes(LOG[:cut])
        offset, first = poll(path, {}, size)
        path.write_bytes(LOG)
        offset, second = poll(path, offset, size)
        assert [r[2] for r in first + second] == want[:-1]
        assert all(LOG[r[1] :].decode("utf-8", "replace").startswith(r[2]) for r in first + second)
        assert poll(path, offset, size)[1] == [] and [r[2] for r in poll(path, offset, size, final=True)[1]] == want[-1:]


def test_long_lines_and_folders(tmp_path):
    folder = tmp_path / "logs" / "run=1"
    folder.mkdir(parents=True)
    (folder / "a.log").write_bytes(b"x" * 200_000 + b"\ny\n" + b"z" * 70_000)
    (folder / "_hidden").write_bytes(b"no\n")
    (folder / ".crc").write_bytes(b"no\n")
    assert [len(r[2]) for r in poll(tmp_path / "logs", {}, 1000)[1]] == [200_000, 1]
    assert poll(tmp_path / "missing", {}, 10)[1] == []


def test_a_growing_log_as_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    path, out = tmp_path / "log", str(tmp_path / "out")
    for n, cut in enumerate((10, 60, 61, 150, len(LOG))):
        path.write_bytes(LOG[:cut])
        stream = L.first_losses(L.reports(L.tail(spark, str(path))), F.lit("r"))
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        query.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("r", 1, 2.5, 1.5), ("r", 2, 1.25, None)]
    whole = spark.createDataFrame([("f", i, x) for i, x in enumerate(LOG.decode().split("\n"))], L.SCHEMA)
    assert tuple(L.progress(L.reports(whole), F.lit("r")).first()) == ("r", 1.5, 2, 10)
