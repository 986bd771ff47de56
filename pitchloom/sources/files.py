"""Many small files below a folder, listed and read by tasks.

Spark's readers keep every file they read in a list of the driver. Here the tasks list folder
by folder, the list is a stored table, and tasks read the files that it names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder, stored

# A task reads about this many files or bytes; a larger file is read in ranges of that size.
TASK_FILES = 2_000
TASK_BYTES = 64 * 2**20
# Bytes that are taken from a file at once, and lines or files that leave a task at once.
CHUNK = 2**20
BATCH_ROWS = 32_768

# File systems that tasks open by the settings that Spark has.
SCHEMES = ("file", "hdfs", "viewfs")

# What an URI writes as escapes: Java keeps other letters than those of ASCII.
_ESCAPED = re.compile(r"[^A-Za-z0-9\-_.!~*'();:@&=+$,/¡-\U0010ffff]|\s")


def location(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """Where tasks open the folder ``root``, and its URI; None where only Spark's readers open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if uri.getScheme() not in SCHEMES:
        return None
    local = uri.getScheme() == "file"
    opens = uri.getPath() if local else uri.toString()
    try:
        files, base = pfs.FileSystem.from_uri(opens)
        if files.get_file_info(base).type != pfs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    return opens, (f"file:{uri.getRawPath()}" if local else uri.toString()).rstrip("/")


def escaped(path: str) -> str:
    """``path`` as part of an URI, as Spark writes it."""
    return _ESCAPED.sub(lambda m: quote(m.group(), safe=""), path)


def _hidden(name: str, folder: bool) -> bool:
    """What Spark's readers leave out."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def listing(spark: SparkSession, root: str, exts: Sequence[str]) -> DataFrame | None:
    """``name, path, length`` of files below ``root`` with an extension of ``exts`` in any case.

    ``name`` is relative to ``root``, ``path`` is the URI that ``_metadata.file_path`` gives.
    Each pass lists the folders that the last one found, so there are as many passes as the tree
    is deep. None where only Spark's readers open ``root``.
    """
    where = location(spark, root)
    if where is None:
        return None
    opens, uri = where
    ends = tuple(e.lower() for e in exts)

    def batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["name", "path", "length"])

    def run(batches):
        files, base = pfs.FileSystem.from_uri(opens)
        rows = []
        for folder in (f for part in batches for f in part.column(0).to_pylist()):
            for info in files.get_file_info(pfs.FileSelector(f"{base.rstrip('/')}/{folder}")):
                last, is_folder = info.base_name, info.type == pfs.FileType.Directory
                if _hidden(last, is_folder) or not (is_folder or last.lower().endswith(ends)):
                    continue
                name = f"{folder}/{last}" if folder else last
                rows.append((name, None, None) if is_folder else (name, f"{uri}/{escaped(name)}", info.size))
                if len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    folder, levels = scratch_folder(spark, "listing"), []
    todo = spark.range(0, 1, 1, 1).select(F.lit("").alias("name"))
    while True:
        found = stored(todo.mapInArrow(run, "name string, path string, length long"), folder, str(len(levels)))
        levels.append(found.filter("length IS NOT NULL"))
        more = found.filter("length IS NULL").select("name")
        if more.isEmpty():
            break
        todo = more.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def lines_from(file, start: int, end: int, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """Lines that begin at bytes ``start`` to ``end`` of an open file, some at a time.

    Lines end as Spark's reader ends them. The one that holds byte ``start - 1`` belongs to the
    range before.
    """
    at = max(start - 1, 0)
    file.seek(at)
    rest, skip = b"", start > 0
    while at < end:
        read = file.read(chunk)
        data = rest + read
        # A return at the very end may be half of a line's end.
        cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, -1)) + 1 if read else len(data)
        block, rest = data[:cut], data[cut:]
        lines = block.splitlines()
        if at + cut > end:
            begins = accumulate(map(len, block.splitlines(keepends=True)), initial=at)
            lines = [line for line, begin in zip(lines, begins) if begin < end]
        if skip and lines:
            lines, skip = lines[1:], False
        elif at == 0 and lines:
            lines[0] = lines[0].removeprefix(b"\xef\xbb\xbf")
        if lines:
            yield lines
        at += cut
        if not read:
            return


def read_lines(spark: SparkSession, root: str, found: DataFrame, ext: str, whole: bool = False) -> DataFrame:
    """``recording_id, value`` of the lines of the listed files with ``ext``, or of files as a whole.

    The key is the name without ``ext``. Files of no bytes give no row.
    """
    opens, _ = location(spark, root)

    def run(batches):
        files, base = pfs.FileSystem.from_uri(opens)
        keys, counts, values, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            key = pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(len(keys)), counts), pa.int64()))
            return pa.record_batch([key, pa.array(values, pa.binary())], names=["recording_id", "value"])

        for part in batches:
            for name, start, end in zip(*(part.column(i).to_pylist() for i in range(3))):
                with files.open_input_file(f"{base.rstrip('/')}/{name}") as file:
                    for some in [[file.read()]] if whole else lines_from(file, start, end):
                        keys.append(name.removesuffix(ext))
                        counts.append(len(some))
                        values += some
                        size += sum(map(len, some))
                        if len(values) >= BATCH_ROWS or size >= 4 * CHUNK:
                            yield batch()
                            keys, counts, values, size = [], [], [], 0
        if keys:
            yield batch()

    wanted = found.filter(F.col("name").endswith(ext) & (F.col("length") > 0))
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(-(-n // TASK_FILES), -(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism), 1)
    step = F.lit(TASK_BYTES).cast("long")
    starts = F.array(F.lit(0).cast("long")) if whole else F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)
    ranges = wanted.select("name", F.explode(starts).alias("start"), F.col("length").alias("_length"))
    ranges = ranges.select("name", "start", F.least(F.col("start") + step, "_length").alias("end"))
    rows = ranges.repartition(tasks, "name", "start").mapInArrow(run, "recording_id string, value binary")
    return rows.select("recording_id", F.col("value").cast("string").alias("value"))
