"""Exact dedup by composable polynomial fingerprints, confirmed by a chunkwise comparison."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, own_names, slices, string_list

CHUNK = 1 << 16
#: Two primes below 2**31 with a base each: 62 bits in all, and products stay within 64 bits.
MODULI = ((2147483647, 1315423911), (2147483629, 2654435769 % 2147483629))
#: Bits of the filter for each shared fingerprint, and the least and the most that the filter has.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 28
_SPACES = b" \t\n\v\f\r"


def _powers(prime: int, base: int) -> np.ndarray:
    out = np.empty(CHUNK, dtype=np.uint64)
    p = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = p
        p = p * base % prime
    return out


_POWERS: list[np.ndarray] = []


def chunk_hash(chunk: bytes) -> tuple[int, ...]:
    """Hash of at most CHUNK bytes: each byte plus one, times a falling power of the base."""
    if not _POWERS:
        _POWERS.extend(_powers(p, b) for p, b in MODULI)
    a = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(a, w[CHUNK - len(a) :])) % p for w, (p, _) in zip(_POWERS, MODULI))


def combine(left: tuple, right: tuple) -> tuple:
    """(hash, length) of two texts put together: the left hash moves up by the right length. Associative."""
    (h, n), (g, m) = left, right
    return tuple((x * pow(b, m, p) + y) % p for x, y, (p, b) in zip(h, g, MODULI)), n + m


def fingerprint(data: bytes) -> int:
    total = ((0,) * len(MODULI), 0)
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        total = combine(total, (chunk_hash(part), len(part)))
    return total[0][0] << 31 | total[0][1]


def _normal(text: str) -> bytes:
    return text.encode("utf-8").translate(None, _SPACES)


_META = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string())])


def _describe(batches):
    for batch in slices(batches):
        fps, sizes, chars, shas = [], [], [], []
        for text in string_list(batch.column("text")):
            data = _normal(text)
            fps.append(fingerprint(data))
            sizes.append(len(data))
            chars.append(len(text))
            shas.append(hashlib.sha256(data).hexdigest())
        yield batch_of(_META, batch.column("doc_id"), fps, sizes, chars, shas)


def describe(docs: DataFrame) -> DataFrame:
    """Fingerprint, normalised length and digest of each text, white space deleted; null is empty."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_describe, "doc_id long, fp long, n_bytes long, n_chars long, text_sha256 string")


def _filter_bit(fp: int, size: int) -> int:
    return (fp ^ fp >> 33) & size - 1


_CHUNKS = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary())])


def _chunks(sketch):
    def run(batches):
        bits = np.frombuffer(sketch.value, dtype=np.uint8)
        for batch in slices(batches):
            rows = []
            for text in string_list(batch.column("text")):
                data = _normal(text)
                bit = _filter_bit(fp := fingerprint(data), 8 * len(bits))
                if bits[bit >> 3] >> (bit & 7) & 1:
                    rows += [(fp, len(data), i, data[i * CHUNK : (i + 1) * CHUNK]) for i in range(-(-len(data) // CHUNK))]
            if rows:
                yield batch_of(_CHUNKS, *map(list, zip(*rows)))

    return run


def false_matches(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Keys (fp, n_bytes) under which texts differ, by comparing the chunks at the same place.

    shared: the keys that more than one document has. A bitmap of MOST_BITS at most, sized by their number, lets most other
    texts stay where they are; those that it lets through by chance are compared too, which changes nothing. Equal chunks meet before
    the shuffle (least and greatest chunk of a place), so a huge group costs no more than its tasks.
    """
    spark = docs.sparkSession
    size = LEAST_BITS
    wanted = BITS_A_KEY * shared.count()
    while size < wanted and size < MOST_BITS:
        size *= 2
    bit = F.col("fp").bitwiseXOR(F.shiftright("fp", 33)).bitwiseAND(F.lit(size - 1))
    words = shared.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    sketch = np.zeros(size // 64, dtype=np.int64)
    for row in words.toLocalIterator():  # MOST_BITS / 64 rows at most
        sketch[row.word] = row.bits
    held = spark.sparkContext.broadcast(sketch.tobytes())
    rows = docs.select("text").mapInArrow(_chunks(held), "fp long, n_bytes long, chunk_no long, chunk binary")
    ends = rows.groupBy("fp", "n_bytes", "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return ends.where(F.col("least") != F.col("most")).select("fp", "n_bytes").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document with the row of its group that stays.

    docs: doc_id (long) and text; other columns are left unread. Texts are equal when they are identical
    without ASCII white space; null counts as empty, so empty and null texts form one group. Of a group the row
    with the most code points in its original text stays, then the smallest doc_id (null last); of
    repeated rows exactly one. An empty table gives no rows.
    Returns doc_id, keep_id, group_size, kept, text_sha256, n_bytes.
    """
    meta = materialize(describe(docs).withColumn("row", F.monotonically_increasing_id()))
    key = ["fp", "n_bytes"]
    shared = meta.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    false = materialize(false_matches(docs, shared)).withColumn("false_match", F.lit(True))
    if false.isEmpty():
        # Nothing to tell apart, so no join that would leave copies unsummed in one task.
        split = meta.withColumn("own_sha", F.lit(""))
    else:
        split = meta.join(false, key, "left").withColumn("own_sha", F.when(F.col("false_match"), F.col("text_sha256")).otherwise(F.lit("")))
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not(F.col("doc_id")).alias("first"), F.bitwise_not(F.col("row")).alias("row")))
    groups = split.groupBy(*key, "own_sha").agg(best.alias("best"), F.count("*").alias("group_size"))
    return split.join(groups, [*key, "own_sha"]).select("doc_id", F.bitwise_not(F.col("best.first")).alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not(F.col("best.row"))).alias("kept"), "text_sha256", "n_bytes")


def keep_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops: same columns, of any names, and one row for each group."""
    sha, kept_id, kept_sha = own_names(docs, "_sha", "_kept_id", "_kept_sha")
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    numbered = docs.withColumn(sha, F.sha2(normal.cast("binary"), 256))
    joined = numbered.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return joined.dropDuplicates(["doc_id", sha]).select(*docs.columns)


#: DuckDB SQL for op9_exact_dedup.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, octet_length(encode(norm)) AS n_bytes,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_bytes FROM g
"""
