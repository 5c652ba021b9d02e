"""What the corpus operators share: tables, the shared folder, Arrow maps over documents."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="metrika-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing before it."""
    path = f"{shared_dir(spark)}/metrika/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the folders of stored() tables that nothing will read again."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are stored; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its task ends, as Python workers live on from task to task."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return own


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Append columns made from a text column, in one pass without a shuffle.

    make() runs once a task and gives a function from a list of texts (None for null) to one
    list or array for each of `fields` (name, DDL type). `keep`: columns of df that go on.
    A kept column whose name equals a new one's, in any case, is replaced by the new one.
    """
    new = {n.lower() for n, _ in fields}
    keep = [c for c in keep if c.lower() not in new]
    own = [f for f in df.schema.fields if f.name in keep]
    made = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in own] + made.fields)
    names = [f.name for f in own]
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias("__text"))

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches):
        f = make()
        for batch in batches:
            out = f(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(len(names))]
            columns += [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names + [n for n, _ in fields])

    return source.mapInArrow(lean(run), schema)


def crc_mod(column: str, n: int):
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def open_folder(uri: str):
    """(pyarrow file system, path) of a folder that the driver and the executors share."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/metrika/{name}-{uuid.uuid4().hex}"
