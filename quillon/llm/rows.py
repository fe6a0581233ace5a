"""How the operators of this subpackage run numpy code over the rows of a table."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.bytesets import BLOCK, blocks

#: Arrow batches are cut after so many bytes, so that workers hold little of very long texts.
BATCH_BYTES = 8 << 20
#: Bytes that go to the JVM at once when a file is written.
PIECE = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers receive, by rows and bytes, where the session has no narrower bound."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(str(spark.conf.get(key)).rstrip("bB"))
        except Exception:  # the setting isn't known to this version
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def annotate(df: DataFrame, text: str, made: Callable, fields: str, keep: Iterable[str], out: str, block: int = BLOCK) -> DataFrame:
    """The columns ``keep`` and a struct ``out``, made from blocks of whole texts without a shuffle.

    made(off, data) gives an array for each of ``fields`` (a DDL string), one value a text.
    """
    bounded(df.sparkSession)
    keep = list(dict.fromkeys(keep))
    need = list(dict.fromkeys([*keep, text]))
    kind = T.StructType.fromDDL(fields)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])
    types = [to_arrow_type(f.dataType) for f in kind.fields]
    names = [f.name for f in kind.fields]

    def run(batches):
        for batch in batches:
            for part, off, data in blocks(batch, text, block):
                values = made(off, data)
                arrays = [v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)]
                struct = pa.StructArray.from_arrays(arrays, names=names)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), struct], names=[*keep, out])

    return df.select(*need).mapInArrow(run, schema)


def shared(spark: SparkSession) -> None:
    """Sees that checkpoints have a folder: the one in spark.checkpoint.dir, or (local sessions only) one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillon-checkpoints-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    sc.setCheckpointDir(at)
    # Spark keeps an application's checkpoints; ours go when the driver ends.
    atexit.register(_gone, sc, sc._jsc.sc().getCheckpointDir().get())


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared checkpoint folder; it goes when the driver ends."""
    shared(spark)
    made = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark.sparkContext, made)
    return made


def _gone(sc: SparkContext, path: str) -> None:
    """Removes a folder at the driver's end, if its session is still there."""
    with contextlib.suppress(Exception):  # nothing of a run that is over may fail it
        if sc._jsc is not None:
            remove(sc, path)


def remove(sc: SparkContext, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def put(sc: SparkContext, path: str, pieces: Iterable[bytes]) -> None:
    """Writes a file in the shared folder, piece by piece."""
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    try:
        for piece in pieces:
            for i in range(0, len(piece), PIECE):
                out.write(bytearray(piece[i : i + PIECE]))
    finally:
        out.close()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: its lineage ends and lost executors cost nothing.

    Spark removes the shuffle files behind it as soon as it is written; the session's own setting of that is put back.
    """
    spark = df.sparkSession
    shared(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df

