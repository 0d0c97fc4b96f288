"""Results that are written once to the folder all machines share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table as read

#: Bytes of an Arrow batch: executors hold one for each task, their Python workers some copies of its parts.
BATCH_BYTES = "8m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: list[tuple[SparkSession, str]] = []
_temporary: dict[str, str] = {}
_Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bound_batches(spark: SparkSession) -> None:
    """Long texts make short Arrow batches; a bound that the session has set itself stays."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def tidy(run: _Run) -> _Run:
    """`run` for mapInArrow. Python workers outlive their tasks; at its end the freed memory goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, one machine (tests) takes a temporary folder; a cluster has no
    folder that all its machines see, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        found = _temporary[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/veilspark-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            sc = spark.sparkContext
            if sc._jsc is not None:
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  this session has ended before; another may not have
            continue


atexit.register(_clean)
