"""Tables in hash buckets that can be changed in place: a change writes the buckets that it touches anew, and nothing else.

Under a path lie data/version=<n>/bucket=<b> (Parquet) and manifest/version=<n>, which says at what version each bucket is.
Version n is worked out from the last one before n, so a change that is run again, after a failure or by a stream that repeats a batch, leaves
what one run leaves. Readers take the newest manifest, which is written last. A table has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a manifest holds: a row for each bucket that has rows, and one for the table itself (bucket -1).
_MANIFEST = "bucket int, at long, about string"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _manifest(self, before: int | None = None) -> tuple[int, dict, dict[int, int]]:
        """(version, {keys, buckets, schema}, {bucket: version}) of the newest manifest, or of the newest one before a version."""
        rows = self.spark.read.schema(f"{_MANIFEST}, version long").parquet(f"{self.path}/manifest")
        if before is not None:
            rows = rows.where(F.col("version") < before)
        last = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == last).collect()  # a row for each bucket
        about = next(json.loads(r.about) for r in found if r.bucket < 0)
        return last, about, {r.bucket: r.at for r in found if r.bucket >= 0}

    def exists(self) -> bool:
        try:
            self._manifest()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _commit(self, version: int, about: dict, at: dict[int, int]) -> None:
        rows = [(-1, version, json.dumps(about)), *((b, v, None) for b, v in sorted(at.items()))]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _write(self, df: DataFrame, version: int, keys: Sequence[str], buckets: int) -> set[int]:
        out = f"{self.path}/data/version={version}"
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        return {r.bucket for r in self.spark.read.schema("bucket int").parquet(out).distinct().collect()}

    def create(self, df: DataFrame, keys: Sequence[str], buckets: int = 64) -> None:
        """Version 0: the rows of df, dealt by a hash of the keys. Choose so many buckets that one is a task's worth of rows."""
        written = self._write(df, 0, keys, buckets)
        self._commit(0, {"keys": list(keys), "buckets": buckets, "schema": df.schema.json()}, dict.fromkeys(written, 0))

    def _read(self, about: dict, at: dict[int, int]) -> DataFrame:
        schema = StructType.fromJson(json.loads(about["schema"]))
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(at.items())))

    def read(self) -> DataFrame:
        _, about, at = self._manifest()
        return self._read(about, at)

    @property
    def version(self) -> int:
        return self._manifest()[0]

    def change(self, touched: DataFrame, by: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        """Put by(old rows) in place of the buckets that hold the keys of touched (its columns are the keys). by may only add rows of such keys.

        version: the number of the change, to run it again under; by default the next one.
        """
        last, about, at = self._manifest(version)
        version = last + 1 if version is None else version
        bucket = F.pmod(F.xxhash64(*about["keys"]), F.lit(about["buckets"])).cast("int")
        hit = {r.bucket for r in touched.select(bucket.alias("bucket")).distinct().collect()}  # about["buckets"] at most
        new = by(self._read(about, {b: v for b, v in at.items() if b in hit}))
        written = self._write(new, version, about["keys"], about["buckets"]) if hit else set()
        at = {b: v for b, v in at.items() if b not in hit} | dict.fromkeys(written, version)
        old = StructType.fromJson(json.loads(about["schema"]))
        schema = StructType(old.fields + [f for f in new.schema.fields if f.name not in old.names])
        self._commit(version, about | {"schema": schema.json()}, at)
        return version

    def upsert(self, rows: DataFrame, version: int | None = None) -> int:
        """Add rows, or fill in those whose key is there: values that aren't null replace the old ones. rows holds each key once."""
        keys = self._manifest(version)[1]["keys"]

        def merged(old: DataFrame) -> DataFrame:
            columns = old.columns + [c for c in rows.columns if c not in old.columns]
            both = old.withColumn("_old", F.struct(*old.columns)).select(*keys, "_old").join(rows.withColumn("_new", F.struct(*rows.columns)).select(*keys, "_new"), keys, "full")
            value = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, has in (("_new", rows.columns), ("_old", old.columns)) if c in has])
            return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in columns])

        return self.change(rows.select(*keys), merged, version)

    def delete(self, gone: DataFrame, version: int | None = None) -> int:
        """Without the rows whose keys are in gone."""
        keys = self._manifest(version)[1]["keys"]
        gone = gone.select(*keys).distinct()
        return self.change(gone, lambda old: old.join(gone, keys, "left_anti").select(*old.columns), version)
