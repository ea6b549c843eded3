"""Growing logs as a stream: whole lines by byte offset, an unfinished last line held back, the first report of a step kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, begin long, line string"
BLOCK = 1 << 16
# What training reports in its log.
PEAK = r"(?i)Peak mem(?:ory)?(?:\s*\(GB\))?\s*:?\s*([0-9.]+)\s*(GB|MB)?"
LOSS = r"Iter\s+(\d+):\s+Train\s+loss\s+([0-9.eE+-]+)"
SAVED = r"Iter\s+(\d+):\s+Saved adapter weights to"


@dataclass
class Bytes(InputPartition):
    """Lines that begin in [begin, end); ``stop`` is where the file's whole lines end."""

    file: str
    begin: int
    end: int
    stop: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def whole_lines(system: fs.FileSystem, file: str, size: int, known: int) -> int:
    """The offset behind the last line break before ``size``, at least ``known``: read from the end, block by block."""
    with system.open_input_file(file) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


class LogReader(DataSourceStreamReader):
    """Offsets: a file's name to the bytes that are over. A line is handed out once, when its line break is there."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("bytes", 16 << 20))
        self.final = str(options.get("final", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, path = _system(self.path)
        one = system.get_file_info(path)
        infos = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = {i.path: i.size for i in infos if i.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in i.path[len(path) :].split("/"))}
        return {f: n if self.final else whole_lines(system, f, n, 0) for f, n in sorted(files.items())}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        out = []
        for file, stop in end.items():
            begin = start.get(file, 0)
            out += [Bytes(file, at, min(at + self.size, stop), stop) for at in range(begin, stop, self.size)]
        return out

    def read(self, partition: Bytes) -> Iterator[tuple]:
        system, _ = _system(self.path)
        with system.open_input_file(partition.file) as f:
            at = partition.begin
            if at:  # a line that begins before this range is another's: the byte before tells
                f.seek(at - 1)
                while f.read(1) != b"\n":
                    at += 1
                    if at >= partition.end:
                        return
            f.seek(at)
            held = b""
            while at < partition.end:
                block = f.read(min(BLOCK, partition.stop - at - len(held)))
                held += block
                lines = held.split(b"\n")
                held = lines.pop()
                for line in lines:
                    if at < partition.end:
                        yield partition.file, at, line.decode("utf-8", "replace").removesuffix("\r")
                    at += len(line) + 1
                if not block:
                    if held and at < partition.end:
                        yield partition.file, at, held.decode("utf-8", "replace").removesuffix("\r")
                    return


class LogTail(DataSource):
    """``log_tail``: options path (a file or folder), bytes (of a task), final (also the last line without a break)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


def tail(spark: SparkSession, path: str, final: bool = False, bytes_: int = 16 << 20) -> DataFrame:
    """The lines of growing logs as a stream: file, begin (the line's byte offset), line. Lines end at a line feed."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("bytes", bytes_).option("final", final).load()


def reports(lines: DataFrame) -> DataFrame:
    """file, begin, step, loss, peak_gb and saved of each line that reports anything; what is no finite number is left out."""
    part = lambda p, i: F.regexp_extract("line", p, i)
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    number = lambda c: finite(F.when(c != "", c.try_cast("double")))
    peak = number(part(PEAK, 1)) / F.when(F.upper(part(PEAK, 2)) == "MB", 1000.0).otherwise(1.0)
    loss = number(part(LOSS, 2))
    step = lambda c: F.when(c != "", c.try_cast("long"))
    rows = lines.select("file", "begin", F.when(loss.isNotNull(), step(part(LOSS, 1))).alias("step"), loss.alias("loss"), F.when(peak > 0, peak).alias("peak_gb"), step(part(SAVED, 1)).alias("saved"))
    return rows.where("step IS NOT NULL OR peak_gb IS NOT NULL OR saved IS NOT NULL")


def first_losses(found: DataFrame, run: Column) -> DataFrame:
    """run, step, loss, peak_gb: what the first line about each step says, by file and offset, whatever batch brought it. One row of state a step."""
    first = F.min(F.struct("file", "begin", "loss", "peak_gb")).alias("x")
    return found.where("step IS NOT NULL").groupBy(run.alias("run"), "step").agg(first).select("run", "step", "x.loss", "x.peak_gb")


def progress(found: DataFrame, run: Column) -> DataFrame:
    """run, peak_gb (the highest so far), latest_loss_step, saved_step."""
    return found.groupBy(run.alias("run")).agg(F.max("peak_gb").alias("peak_gb"), F.max("step").alias("latest_loss_step"), F.max("saved").alias("saved_step"))
