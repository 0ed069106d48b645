"""Requests of the application's clients as a stream source, and as rows of the log.

A front end appends every request to a journal, a JSON object a line, in files of one folder. The
source `framewise_requests` reads that folder: an offset is how many bytes of each file are taken, so
a micro-batch is a set of byte ranges, which can be read again after a failure and always hold the
same requests. Ranges end behind a line, long ones are split, and each is a task of its own; a
half-written last line waits. Lines that are no request are counted as rejected, not lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from framewise.functions import replies

SCHEMA = "file string, at long, key long, ts string, seq long, route string, form map<string, string>, has_image boolean, bad boolean"
#: Bytes of a task, about; bytes of a file looked through at once for the end of a line.
SPLIT, BLOCK = 32 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def line_end(f, start: int, end: int) -> int:
    """The place behind the last line end in a range of a file; start if there is none."""
    while end > start:
        a = max(start, end - BLOCK)
        f.seek(a)
        i = f.read(end - a).rfind(b"\n")
        if i >= 0:
            return a + i + 1
        end = a
    return start


def parsed(line: bytes) -> tuple:
    """A line as the columns of SCHEMA from key on."""
    try:
        r = json.loads(line)
        form = {str(k): str(v) for k, v in (r.get("form") or {}).items() if v is not None}
        return int(r["client"]), str(r["at"]), int(r["n"]), str(r["route"]), form, bool(r.get("image")), False
    except (ValueError, KeyError, TypeError, AttributeError):
        return None, None, None, None, None, None, True


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.split = int(options.get("split", SPLIT))

    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of each file up to the end of its last whole line."""
        files, root = self._fs()
        out = {}
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if info.type == fs.FileType.File and name.endswith(".jsonl") and info.size:
                with files.open_input_file(info.path) as f:
                    out[name] = line_end(f, 0, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """What end has beyond start. A split of a file begins behind the line that the split before goes into."""
        out = []
        for name in sorted(end):
            a = start.get(name, 0)
            out += [Range(name, s, min(s + self.split, end[name])) for s in range(a, end[name], self.split)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that start in a range; the last of them may end beyond it."""
        files, root = self._fs()
        with files.open_input_file(f"{root}/{partition.file}") as f:
            at, held = partition.start, b""
            skip = False
            if at:
                f.seek(at - 1)
                skip = f.read(1) != b"\n"
            f.seek(at)
            while at < partition.end:
                i = held.find(b"\n")
                if i < 0:
                    more = f.read(BLOCK)
                    if not more:
                        return
                    held += more
                    continue
                line, held = held[: i + 1], held[i + 1 :]
                if not skip and line.strip():
                    yield partition.file, at, *parsed(line)
                skip, at = False, at + len(line)

    def commit(self, end: dict) -> None:
        pass


class Requests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framewise_requests"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def read_requests(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The journal in a folder (a URI) as a stream of SCHEMA rows."""
    spark.dataSource.register(Requests)
    return spark.readStream.format("framewise_requests").option("path", path).option("split", split).load()


# What a request to each route is in the log.
ROUTES = {
    "/report_wrong": "report", "/capture": "capture", "/trigger_matrix": "trigger", "/pause_auto_switch": "pause",
    "/resume_auto_switch": "resume", "/auto_switch": "auto", "/enable_debounce": "debounce",
}


def branch() -> Column:
    """Kind of a request: frame for images; seeking or paused without one; the command of other routes; reject."""
    form = lambda k: F.coalesce(replies.truthy(F.col("form")[k]), F.lit(False))
    bare = F.when(form("is_seeking"), "seeking").when(form("is_paused"), "paused")
    received = F.when(F.col("has_image"), "frame").otherwise(F.coalesce(bare, F.lit("reject")))
    state = F.when(form("is_paused"), "paused").when(form("is_seeking"), "seeking").otherwise("resumed")
    known = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    kind = F.when(F.col("bad"), "reject").when(F.col("route") == "/receive", received).when(F.col("route") == "/video-state", state)
    return kind.otherwise(F.coalesce(known[F.col("route")], F.lit("reject")))


def log_rows(requests: DataFrame) -> DataFrame:
    """Rows of the log (key, ts, seq, kind, result, source, flag) from requests; seeking, paused, resumed and rejected ones are none.

    Frames bring their verdict in the form (result, source), as whoever classifies them writes it there.
    """
    form = F.col("form")
    kinds = ["frame", *ROUTES.values()]
    rows = requests.withColumn("kind", branch()).filter(F.col("kind").isin(*kinds))
    return rows.select(
        "key", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "kind", form["result"].alias("result"), form["source"].alias("source"), form["flag"].cast("boolean").alias("flag")
    )
