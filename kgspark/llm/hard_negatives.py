"""Hard negatives by exact integer scores from floating-point products: matrices are multiplied modulo small primes.

Components are integers. Modulo a prime p below 2**10 they are at most p / 2 in size, so a product of 64 of them stays below 2**24 and a
float32 matrix product is exact; longer vectors are multiplied in pieces of so many components. The residues of a score modulo
several primes, whose product exceeds twice the largest score there can be, give it back with its sign by Chinese remaindering.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialize
from .vector_codes import integers, longest, usable

#: Anchors that are sent to all tasks at once.
ANCHORS = 4096
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least and at most so many tenths of the positive's.
LEAST, MOST = 3, 9
#: Rows and columns of the score matrices that are worked on at once.
_TILE_ROWS, _TILE = 256, 4096
#: Vectors in a row of the packed table.
_SLICE = 1 << 14


# --- scores by residues -------------------------------------------------------------------------


def primes_for(bound: int) -> list[int]:
    """Primes from 1021 down whose product exceeds twice the bound."""
    out, product, p = [], 1, 1021
    while product <= 2 * bound:
        if all(p % d for d in range(2, 32)):
            out.append(p)
            product *= p
        p -= 1
    if product >= 1 << 62:
        raise ValueError("scores don't fit 62 bits")
    return out


def centred(matrix: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2 as float32."""
    r = matrix % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residues(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (0 to p - 1) for centred residues: exact, in pieces whose sums stay below 2**24."""
    piece = (1 << 24) // (p // 2) ** 2
    total = None
    for at in range(0, max(a.shape[1], 1), piece):
        part = np.rint(a[:, at : at + piece] @ b[:, at : at + piece].T).astype(np.int32) % p
        total = part if total is None else (total + part) % p
    return total


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The numbers, between minus and plus half the primes' product, with these residues: one digit of a mixed radix for each prime."""
    value, radix = parts[0].astype(np.int64), primes[0]
    for r, p in zip(parts[1:], primes[1:]):
        digit = (r - value) % p * pow(radix, -1, p) % p
        value = value + radix * digit
        radix *= p
    return np.where(value > radix // 2, value - radix, value)


class Scores:
    """Exact inner products of rows with anchors, for components of a known largest size."""

    def __init__(self, anchors: np.ndarray, largest: int):
        self.primes = primes_for(anchors.shape[1] * largest * largest)
        self.anchors = [centred(anchors, p) for p in self.primes]

    def rows(self, matrix: np.ndarray) -> list[np.ndarray]:
        return [centred(matrix, p) for p in self.primes]

    def of(self, anchors: slice, rows: list[np.ndarray]) -> np.ndarray:
        return remaindered([residues(a[anchors], r, p) for a, r, p in zip(self.anchors, rows, self.primes)], self.primes)


# --- the best of a window -----------------------------------------------------------------------


class Best:
    """The first `most` (score down, id up, null ids last) of each of n lists, fed in portions."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.slot = np.zeros(0, dtype=np.int64)
        self.score, self.id, self.nameless = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        #: What a further score must reach to get into a list.
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def add(self, slot, score, id, nameless) -> None:
        slot, score = np.concatenate((self.slot, slot)), np.concatenate((self.score, score))
        id, nameless = np.concatenate((self.id, id)), np.concatenate((self.nameless, nameless))
        order = np.lexsort((id, nameless, -score, slot))
        slot = slot[order]
        begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        kept = order[place < self.most]
        self.slot, self.score, self.id, self.nameless = slot[place < self.most], score[kept], id[kept], nameless[kept]
        full = place[place < self.most] == self.most - 1
        self.floor[self.slot[full]] = self.score[full]


# --- Spark --------------------------------------------------------------------------------------

_PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.binary()), ("numbers", pa.binary()), ("matrix", pa.binary())])


def _pack(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                matrix = integers(part.column("v"), width)
                labels, numbers = part.column("label").to_numpy(), part.column("number").to_numpy()
                order = np.argsort(labels, kind="stable")
                ids = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), part.column("id").take(pa.array(order)))
                yield batch_of(_PACKED, ids, [labels[order].astype("<i8").tobytes()], [numbers[order].astype("<i8").tobytes()], [matrix[order].tobytes()])

    return run


def _read(batches, width: int):
    """(ids, where there is none, labels, numbers, components) of packed rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            nameless = ids.is_null().to_numpy(zero_copy_only=False)
            columns = [np.frombuffer(batch.column(c)[i].as_py(), dtype="<i8") for c in ("labels", "numbers")]
            yield ids.fill_null(0).to_numpy(), nameless, *columns, np.frombuffer(batch.column("matrix")[i].as_py(), dtype="<i4").reshape(len(ids), width)


_FOUND = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
_FOUND_SQL = "anchor int, slot int, score long, id long"


def _found(best: Best, slots: int) -> pa.RecordBatch:
    return batch_of(_FOUND, (best.slot // slots).astype(np.int32), (best.slot % slots).astype(np.int32), best.score, pa.array(best.id, mask=best.nameless))


def _positives(block, most: int, largest: int):
    """Tasks' best of the same label: anchors are sorted by label, so are a row's vectors, and only runs of one label are multiplied."""

    def run(batches):
        labels, numbers, matrix = block.value
        scores, best = Scores(matrix, largest), Best(len(labels), most)
        for ids, nameless, own, own_numbers, components in _read(batches, matrix.shape[1]):
            for label in np.intersect1d(own, labels):
                a, b = np.searchsorted(labels, [label, label + 1]), np.searchsorted(own, [label, label + 1])
                for at in range(b[0], b[1], _TILE):
                    rows = slice(at, min(b[1], at + _TILE))
                    right = scores.rows(components[rows])
                    for top in range(a[0], a[1], _TILE_ROWS):
                        left = slice(top, min(a[1], top + _TILE_ROWS))
                        s = scores.of(left, right)
                        wanted = (s >= best.floor[left, None]) & (own_numbers[None, rows] != numbers[left, None])
                        i, j = np.nonzero(wanted)
                        best.add(i + top, s[i, j], ids[rows][j], nameless[rows][j])
        yield _found(best, 1)

    return run


def _negatives(block, most: int, slots: int, largest: int):
    """Tasks' best of other labels within each positive's window of scores."""

    def run(batches):
        labels, low, high, matrix = block.value  # low, high: (anchor, slot), empty windows where there is no positive
        scores, best = Scores(matrix, largest), Best(len(labels) * slots, most)
        floor = best.floor.reshape(len(labels), slots)
        for ids, nameless, own, _, components in _read(batches, matrix.shape[1]):
            step = 256  # little by little at first, until the floors have risen
            at = 0
            while at < len(own):
                rows = slice(at, min(len(own), at + step))
                right = scores.rows(components[rows])
                for top in range(0, len(labels), _TILE_ROWS):
                    left = slice(top, min(len(labels), top + _TILE_ROWS))
                    s = scores.of(left, right)
                    other = labels[left, None] != own[None, rows]
                    found = []
                    for k in range(slots):
                        least = np.maximum(low[left, k], floor[left, k])[:, None]
                        i, j = np.nonzero((s >= least) & (s <= high[left, k, None]) & other)
                        found.append(((i + top) * slots + k, s[i, j], ids[rows][j], nameless[rows][j]))
                    best.add(*map(np.concatenate, zip(*found)))
                at, step = rows.stop, min(2 * step, _TILE)
        yield _found(best, slots)

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each anchor and slot; a task sends no more than so many itself."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchor: str = "pmod(vec_id, 100) = 0", id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: SQL condition of the rows that are asked about; id and label are whole numbers. Rows with a null label, a null vector, or any
    null or non-finite component take no part. Components become floor(256 * x); a score is the integer inner product (an error says so if
    scores could pass 62 bits). Vectors shorter than the longest end in zeros. Higher scores come first, ties by smaller id, null ids last.
    An anchor's positives are its first other rows of the same label; its negatives, for a positive, the first rows of other labels whose
    score is from least to most tenths of the positive's. Each repeated row is a row of its own, also as an anchor. Other columns
    are left unread. Anchors without positives, and positives without negatives, give no rows; neither does an empty table.

    Every row is held against every anchor, in blocks: ANCHORS anchors at a time go to all tasks, two passes a block. Rows are packed once,
    and never shuffled; tasks send their own best alone.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(label).isNotNull() & usable(vector))
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(F.expr(anchor), F.lit(False)).alias("is_anchor"))
    rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()))
    width = longest(rows, "v")
    ends = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(F.floor(x.cast("double") * 256)))))).first()[0]
    largest = int(ends or 0)
    packed = materialize(rows.mapInArrow(_pack(width), "ids array<long>, labels binary, numbers binary, matrix binary"))
    asked = rows.where("is_anchor").select("id", "label", "v", "number")
    # Blocks by place: the partitions' counts, of which there are few, tell where each begins.
    inside = F.shiftright("number", 33)
    before = Window.partitionBy("part").orderBy("number")
    counts = asked.groupBy(inside.alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["part"], total))
        total += row["count"]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], schema)
    offsets = spark.createDataFrame(starts, "part long, start long")
    placed = asked.withColumn("part", inside).withColumn("own", F.row_number().over(before) - 1).join(F.broadcast(offsets), "part")
    placed = materialize(placed.withColumn("block", F.floor((F.col("start") + F.col("own")) / ANCHORS)).select("id", "label", "v", "number", "block"))
    out = []
    for k in range(-(-total // ANCHORS)):
        some = placed.where(F.col("block") == k).toArrow().sort_by("label")
        labels, numbers = some.column("label").to_numpy(), some.column("number").to_numpy()
        matrix = integers(some.column("v"), width)
        block = spark.sparkContext.broadcast((labels, numbers, matrix))
        near = packed.mapInArrow(_positives(block, positives, largest), _FOUND_SQL)
        near = _ranked(near, positives).select("anchor", "rank", "score", "id").toArrow()  # ANCHORS * positives rows at most
        low, high = np.ones((len(labels), positives), dtype=np.int64), np.zeros((len(labels), positives), dtype=np.int64)
        place = near.column("anchor").to_numpy(), near.column("rank").to_numpy() - 1
        score = near.column("score").to_numpy()
        low[place], high[place] = -(-score * least // 10), score * most // 10
        windows = spark.sparkContext.broadcast((labels, low, high, matrix))
        hard = _ranked(packed.mapInArrow(_negatives(windows, negatives, positives, largest), _FOUND_SQL), negatives)
        names = spark.createDataFrame(pa.table({"anchor": near.column("anchor"), "slot": pa.array((place[1]).astype(np.int32)), "anchor_id": some.column("id").take(near.column("anchor")), "positive_id": near.column("id"), "positive_score": near.column("score")}))
        hard = hard.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
        out.append(materialize(hard.join(F.broadcast(names), ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")))
        block.unpersist()
        windows.unpersist()
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def moved_labels(vectors: DataFrame) -> DataFrame:
    """vectors with label (label + 1) % 10 where vec_id is divisible by 7."""
    moved = (F.col("label").cast("long") + 1) % 10
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label").cast("long")))


#: DuckDB SQL for op13_hard_negatives.
ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
         n.other_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""
