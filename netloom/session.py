"""Session defaults and the shared folder that multi-step operators write to."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Settings the engine expects; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "netloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings use ``__`` for dots."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors share: ``spark.checkpoint.dir``.

    Where the cluster names none (tests, a laptop), a temporary folder is set once for the application;
    that is only right when driver and executors share one machine, so any other master is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    got = spark.sparkContext.getCheckpointDir()
    if got is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused URI under the shared folder."""
    return f"{shared_dir(spark)}/netloom/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders of the columns ``by``, and read it back: cuts lineage,
    survives lost executors."""
    at = scratch(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def local_path(uri: str) -> str:
    """The file-system path of a ``file:`` URI or plain path; other schemes are refused."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"not a mounted path: {uri}")
    return os.path.abspath(u.path if u.scheme else uri)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for what pyarrow writes; plain paths and ``file:`` are local or mounted."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(uri)


def publish(folder: str, number: int, what: dict) -> None:
    """Makes a small file ``number`` of a folder visible, whole or not at all: written beside it, then moved to its new name.

    Nothing is overwritten, so a file system whose moves refuse an existing target does as well as an object store.
    """
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    other = f"{path}/part-{uuid.uuid4().hex}"
    with files.open_output_stream(other) as f:
        f.write(json.dumps(what).encode())
    files.move(other, f"{path}/{number:012d}.json")


def _numbered(folder: str) -> tuple[fs.FileSystem, list[str]]:
    files, path = file_system(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return files, sorted(f.path for f in found if f.base_name.endswith(".json"))


def published(folder: str) -> list[dict]:
    """What ``publish`` made visible, in order of number."""
    files, paths = _numbered(folder)
    return [json.loads(files.open_input_stream(p).read()) for p in paths]


def newest(folder: str) -> dict | None:
    """What ``publish`` made visible under the greatest number; None if nothing yet."""
    files, paths = _numbered(folder)
    return json.loads(files.open_input_stream(paths[-1]).read()) if paths else None


def exists(uri: str) -> bool:
    files, path = file_system(uri)
    return files.get_file_info(path).type != fs.FileType.NotFound


def remove(uri: str) -> None:
    """Deletes a folder of intermediate data."""
    files, path = file_system(uri)
    files.delete_dir(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table; timestamps without zone stay TimestampNTZ."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_us(col):
    """Microseconds since 1970 of a timestamp, read as UTC whatever the session's zone is."""
    from pyspark.sql import functions as F

    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))
