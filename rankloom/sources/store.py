"""Materialised tables, datasets with a manifest, and models as folders of Parquet."""

from __future__ import annotations

import atexit
import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all tasks run on this machine (as in tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_RUN = f"run-{uuid.uuid4().hex}"
_USED: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The folder in the shared one for this process's intermediate tables, which are removed when the process ends."""
    path = f"{shared_folder(spark)}/rankloom/{_RUN}"
    _USED.add(path)
    return path


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


def remove(path: str) -> None:
    """Delete a folder; a store that is gone or that only Spark reaches keeps it."""
    try:
        disk, at = filesystem(path)
        disk.delete_dir(at)
    except Exception:
        pass


def _clean() -> None:
    for path in _USED:
        remove(path)


atexit.register(_clean)


def release(spark: SparkSession) -> None:
    """Spark removes shuffle files once the driver has collected what refers to them; without a collection they lie there to the end."""
    gc.collect()
    # a listener refers to its last event, and that to the plan of the last query, until it gets another one
    spark.sql("VALUES 1").collect()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(1_000)
    except Py4JError:
        pass  # events still wait; the next release finds what this one leaves
    spark.sparkContext._jvm.System.gc()


#: Folders stored in each open `scratch`.
_SCRATCH: list[list[str]] = []


def stored(folder: str) -> str:
    """Note a folder that is about to be written, for the innermost `scratch`."""
    if _SCRATCH:
        _SCRATCH[-1].append(folder)
    return folder


@contextmanager
def scratch() -> Iterator[Callable]:
    """Tables and packed matrices stored inside are removed at the end, except those given to what this yields; nothing that is read later may be lazy on the others."""
    own: list[str] = []
    stay: list[str] = []

    def keep(kept):
        stay.append(kept.folder)
        return kept

    _SCRATCH.append(own)
    try:
        yield keep
    finally:
        del _SCRATCH[next(k for k, x in enumerate(_SCRATCH) if x is own)]
        for folder in own:
            if folder in stay:
                stored(folder)
            else:
                remove(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; `folder` is where it lies."""
    path = stored(f"{run_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def _scalars(spark: SparkSession, path: str, values: dict | None) -> dict | None:
    if values is None:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return None


def save(spark: SparkSession, path: str, data: dict) -> None:
    """Write a dict of frames, nested dicts and JSON values; the manifest comes last and names what counts."""
    frames, nested, plain = {}, {}, {}
    for k, v in data.items():
        (frames if isinstance(v, DataFrame) else nested if isinstance(v, dict) and any(isinstance(x, (DataFrame, dict)) for x in v.values()) else plain)[k] = v
    for k, v in frames.items():
        v.write.mode("overwrite").parquet(f"{path}/{k}.parquet")
    for k, v in nested.items():
        save(spark, f"{path}/{k}", v)
    _scalars(spark, f"{path}/_manifest", {"frames": sorted(frames), "nested": sorted(nested), "values": plain})


def load(spark: SparkSession, path: str) -> dict:
    found = _scalars(spark, f"{path}/_manifest", None)
    out = dict(found["values"])
    out |= {k: spark.read.parquet(f"{path}/{k}.parquet") for k in found["frames"]}
    return out | {k: load(spark, f"{path}/{k}") for k in found["nested"]}


def cached(spark: SparkSession, path: str, compute) -> dict:
    """What is stored at path, else compute(), stored there."""
    try:
        return load(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    save(spark, path, compute())
    return load(spark, path)
