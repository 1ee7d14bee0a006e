"""What the text operators share: word rules, id hashing, lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes other than space and 0x09-0x0D; bytes.split() uses just these separators.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column called ``name``, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one set on the context.  Where neither is, a temporary folder in
    local mode, which has no other machine, and an error on a cluster."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if path is None and current.isDefined():
        path = current.get()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not current.isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later steps survive lost executors and don't compute ``df`` again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; columns can be pruned in later reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    text = F.coalesce(col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)).cast("int")


def ship(spark: SparkSession, value: object) -> Broadcast:
    """``value`` of bounded size for all executors; like functions, it travels with its classes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent: Broadcast):
    return pickle.loads(sent.value)


def rows_per_partition(spark: SparkSession, rows: int, each: int) -> int:
    return max(1, -(-rows // each), min(spark.sparkContext.defaultParallelism, -(-rows // 256)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, for work that holds Python objects of a whole batch."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def schema_of(df: DataFrame, *names: str, more: str) -> T.StructType:
    """The fields ``names`` of ``df`` followed by the fields of the DDL string ``more``."""
    fields = [df.schema[n] for n in names]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + T.StructType.fromDDL(more).fields)
