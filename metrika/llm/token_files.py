"""Token-ID output: documents' ids in ascending doc_id order, in files of id_codec's format.

Documents are dealt into ranges of doc_id; each task sorts its range and writes one file under
a temporary name, which it then renames, so a repeated task replaces its file. Reading takes
the files' list and counts (a row a file), cuts each file into ranges of blocks, a task each,
and gives every document from them; a range has the documents that start in it.

Defined cases: null text has the end id alone; null doc_ids come first; repeated doc_ids are
kept, in the order of their texts; an empty table gives no rows and no document in any file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_folder, open_folder, table
from .id_codec import BLOCK, LANES, FileWriter, read_file
from .token_ids import Encoder

MOST_TASKS = 50_000  # that read ranges; a task may have several
FILE = 64 << 20  # characters of the texts of a file, about
LEAST = 32 << 20  # below which there aren't more files for more tasks, as wide blocks are coded faster
PIECES = 500_000  # that an encoder keeps
SLICE = 4 << 20  # bytes of texts that are encoded at once, about; one text may be longer
END = b"\0\0\0\0"


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, text: str = "text", spaced: bool = True) -> list:
    """Write all documents; rows (part, name, n_ids, n_docs) in file order."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, encoder, out, docs_seen = context.partitionId(), Encoder(tokenizer, spaced, PIECES), None, 0
        system, path = open_folder(folder)
        name = f"part-{part:06d}.ids"
        trial = f"{path}/_{name}.{context.attemptNumber()}"
        with system.open_output_stream(trial) as stream:
            out = FileWriter(stream)
            for batch in batches:
                ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), batch.num_rows]
                for at, end in zip(cuts, cuts[1:]):
                    own = batch.slice(at, end - at)
                    for doc_id, ids in zip(own.column(0).to_pylist(), encoder.ids(own.column(1).to_pylist())):
                        out.add(doc_id, np.frombuffer(ids + END, "<u4"))
                        docs_seen += 1
            out.close()
        system.move(trial, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_ids": [out.n_ids], "n_docs": [docs_seen]})

    source = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string").alias("text"))
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST)), -(-size // FILE))
    ranged = source.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return sorted(ranged.mapInArrow(lean(run), "part int, name string, n_ids long, n_docs long").collect())


def read(spark: SparkSession, folder: str, parts: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    rows, start = [], 0
    for r in parts:
        rows += [(r["name"], start, at) for at in range(0, -(-r["n_ids"] // BLOCK), LANES)] if r["n_docs"] else []
        start += r["n_ids"]
    ranges = spark.createDataFrame(rows, "name string, start long, first int").repartition(min(max(1, len(rows)), MOST_TASKS))

    def run(batches):
        system, path = open_folder(folder)
        for batch in batches:
            for name, start, first in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{path}/{name}") as stream:
                    out: list = []
                    for doc_id, at, ids in read_file(stream, first, first + LANES):
                        out.append((doc_id, start + at, len(ids) // 4, zlib.crc32(ids)))
                        if len(out) == 10_000:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    return ranges.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "ids")
    parts = write(spark, table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, folder, parts)
