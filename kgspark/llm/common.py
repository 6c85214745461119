"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators define it: the inside of a regex class.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder, for a session of one machine alone."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in local tests, a temporary one."""
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or _own_folder(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder (see shared_folder)."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_own_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def number_of_parts(spark: SparkSession, size: int, part: int) -> list[int]:
    """Arguments of a repartition that keep a part to about `part` of `size`; none where the session's number of partitions does."""
    wanted = -(-size // part)
    return [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of one's own that df has no column of, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_array(text: Column) -> Column:
    """Words of a text as array<string>: maximal runs without ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 4, is 2.

    A null id is never learnt from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone, fine enough for any number of rows; to draw a share by."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 11) / float(1 << 53)


def string_list(column) -> list[str]:
    """Arrow strings as Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batches, text: str = "text", max_chars: int = 8_000_000):
    """Cut Arrow batches into parts of at most about max_chars bytes of text (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > max_chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
