"""A Python data source over a Parquet log directory, for batch and streaming reads by offset.

``spark.read.format("logdir").option("path", ...)`` reads records of [startOffset, endOffset); the path has
topic=/part= directories in any file system that Arrow opens. A task reads row groups of one file, up to
``rowsPerTask`` rows, that can hold offsets of the range, so a large partition is many tasks.

As a stream each micro-batch takes what is there. ``maxOffsetsPerTrigger`` limits the offsets of every
partition in one; it needs ``progress``, a file of the source's own, since Spark does not tell a source after a restart
how far it came: what is reported must never fall below the checkpoint, or records would come twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "event_id BIGINT, user_id BIGINT, value DOUBLE, off BIGINT, topic STRING, part INT"
COLUMNS = ["event_id", "user_id", "value", "off"]
END = 1 << 62


class Slice(InputPartition):
    def __init__(self, topic: str, part: int, uri: str, groups: list[int], start: int, end: int):
        self.topic, self.part, self.uri, self.groups, self.start, self.end = topic, part, uri, groups, start, end


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class Log:
    """Row groups of the files below a path: (rows, least and greatest offset). Footers are read once for each file."""

    def __init__(self, uri: str):
        self.uri, self.known = uri.rstrip("/"), {}

    def files(self) -> dict[tuple[str, int], list[tuple[str, list[tuple[int, int, int]]]]]:
        system, root = _open(self.uri)
        out: dict = {}
        for f in sorted(system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            m = re.search(r"topic=([^/]*)/part=(\d+)/[^/._][^/]*\.parquet$", f.path)
            if m and f.is_file and "/_" not in f.path[len(root) :]:
                key = (f.path, f.size, f.mtime_ns)
                if key not in self.known:
                    self.known[key] = self._groups(system, f.path)
                out.setdefault((m[1], int(m[2])), []).append((f.path, self.known[key]))
        return out

    @staticmethod
    def _groups(system: fs.FileSystem, path: str) -> list[tuple[int, int, int]]:
        with system.open_input_file(path) as data:
            file = pq.ParquetFile(data)
            at = file.schema_arrow.get_field_index("off")
            out = []
            for g in range(file.metadata.num_row_groups):
                group = file.metadata.row_group(g)
                stats = group.column(at).statistics
                if stats is None or not stats.has_min_max:
                    off = file.read_row_group(g, columns=["off"])["off"].to_pylist()
                    out.append((group.num_rows, min(off, default=0), max(off, default=-1)))
                else:
                    out.append((group.num_rows, stats.min, stats.max))
        return out

    def ends(self) -> dict[str, int]:
        return {f"{t}/{p}": 1 + max((g[2] for _, groups in files for g in groups), default=-1) for (t, p), files in self.files().items()}

    def slices(self, ranges: dict[tuple[str, int], tuple[int, int]] | None, start: int, end: int, rows: int) -> list[Slice]:
        out = []
        for (topic, part), files in self.files().items():
            lo, hi = (start, end) if ranges is None else ranges.get((topic, part), (0, 0))
            for path, groups in files:
                held, size = [], 0
                for i, (n, first, last) in enumerate(groups):
                    if first < hi and last >= lo:
                        held, size = [*held, i], size + n
                    if size >= rows:
                        out.append(Slice(topic, part, self._uri(path), held, lo, hi))
                        held, size = [], 0
                if held:
                    out.append(Slice(topic, part, self._uri(path), held, lo, hi))
        return out

    def _uri(self, path: str) -> str:
        """Arrow gives paths without their scheme."""
        return path if "://" not in self.uri or self.uri.startswith("file:") else f"{self.uri.split('://')[0]}://{path.lstrip('/')}"


def _read(s: Slice) -> Iterator[pa.RecordBatch]:
    if not s.groups:
        return
    system, path = _open(s.uri)
    with system.open_input_file(path) as data:
        for b in pq.ParquetFile(data).iter_batches(row_groups=s.groups, columns=COLUMNS):
            off = b.column("off").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((off >= s.start) & (off < s.end)))
            if n := b.num_rows:
                cols = [b.column(c) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([s.topic] * n), pa.array([s.part] * n, pa.int32())], names=[*COLUMNS, "topic", "part"])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.log, self.rows = Log(options["path"]), int(options.get("rowsPerTask", 1_000_000))
        self.start, self.end = int(options.get("startOffset", 0)), int(options.get("endOffset", END))

    def partitions(self):
        return self.log.slices(None, self.start, self.end, self.rows) or [Slice("", 0, "", [], 0, 0)]

    def read(self, partition):
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.log, self.rows = Log(options["path"]), int(options.get("rowsPerTask", 1_000_000))
        self.most, self.progress = int(options.get("maxOffsetsPerTrigger", 0)), options.get("progress")
        if self.most and not self.progress:
            raise ValueError("maxOffsetsPerTrigger needs the option progress")
        self.at: dict[str, int] = self._load()

    def _load(self) -> dict[str, int]:
        """What was committed last. The batch after it may be in the checkpoint too: it reached one limit further at most."""
        if not self.progress:
            return {}
        system, path = _open(self.progress)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with system.open_input_file(path) as data:
            return json.loads(data.read())

    def initialOffset(self):
        return {}

    def latestOffset(self):
        ends = self.log.ends()
        if self.most:
            ends = {k: min(e, self.at.get(k, 0) + self.most) for k, e in ends.items()}
        self.at = {k: max(ends.get(k, 0), self.at.get(k, 0)) for k in {*ends, *self.at}}
        return dict(self.at)

    def partitions(self, start, end):
        self.at = {k: max(end.get(k, 0), self.at.get(k, 0)) for k in {*end, *self.at}}  # a batch that is run again
        ranges = {}
        for k, e in end.items():
            topic, _, part = k.rpartition("/")
            if e > start.get(k, 0):
                ranges[topic, int(part)] = (start.get(k, 0), e)
        return self.log.slices(ranges, 0, 0, self.rows)

    def read(self, partition):
        return _read(partition)

    def commit(self, end):
        if self.progress:
            system, path = _open(self.progress)
            with system.open_output_stream(path + ".next") as out:
                out.write(json.dumps(end).encode())
            system.move(path + ".next", path)


class LogDirSource(DataSource):
    @classmethod
    def name(cls):
        return "logdir"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LogDirSource)
