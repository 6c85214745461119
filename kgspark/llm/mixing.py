"""Mixing sources to target weights by weighted fair queueing. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_names, word_array

WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MAX_EPOCHS = 3
#: Documents of one source in a bucket, on average: what one task sorts.
BUCKET_ROWS = 2048
#: Buckets of virtual time of one level of the search for the end of the mix.
GRID = 4096
SEED = "mix-1"


def _number(order: Column) -> Column:
    """0 <= u < 1 from the first 32 bits of a hex digest."""
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_docs, weight, target and rank of each source.

    The targets are least(max_epochs * source_size, level * weight) and add up to all words: sources are
    capped in the order of cap / weight, and the level is what the others share by weight.
    One row per source; the unpartitioned windows see only those.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = per.withColumn("rank", F.row_number().over(by_name) - 1)
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", share).withColumn("cap", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # The first source whose share stays within its cap sets the level for it and all after it.
    free_rank = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("place"), F.col("level")))).over(everything)
    out = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order)).withColumn("free", free_rank)
    capped = F.col("free").isNull() | (F.col("place") < F.col("free.place"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("weight"))
    return out.select("source", "source_size", "n_docs", "weight", "rank", target.alias("target"))


def _finish(epoch: int) -> Column:
    """Virtual finish time of a document's copy: the words of its source up to its end, over the target."""
    return (F.lit(epoch) * F.col("source_size") + F.col("upto")) / F.col("target")


def _cell(finish: Column, level: int) -> Column:
    """Place of a finish time in the grid of a level; times from 2 on share the last cell of level 0."""
    scaled = F.least(finish, F.lit(2.0)) * F.lit(float(GRID))
    if level:
        scaled = (scaled - F.floor(scaled)) * F.lit(float(GRID))
    return F.floor(scaled).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: what a mix of the sources at their target weights takes of it.

    docs: doc_id, text and source; other columns are left unread. size is the number of words (null text: 0).
    Each source's documents stand in the order of a keyed digest of doc_id, over and over, max_epochs times.
    A copy's virtual finish time is the source's words so far over its target; all copies are ordered by
    (time, source, digest of the id, doc_id, size, digest of the text) and the mix ends before the budget (all words) is passed. Sources rank by code point,
    null last. Sources without words have target 0, and documents without words are never taken (0 words either way).
    Rows with the same id stand by size, then by a digest of the text, so reruns agree; repeated rows are rows of their own, of which the mix may
    take some. An empty table gives no rows.
    Returns doc_id, source, size, source_size, target, copies, taken.

    A hot source is cut into buckets by the digest, a few thousand rows each; sums of buckets carry the
    running total across. The end of the mix is found on a grid of virtual time in two levels.
    """
    return _mixed(docs, weights, max_epochs, seed).drop("digest")


def _mixed(docs: DataFrame, weights, max_epochs: int, seed: str) -> DataFrame:
    """mix with the texts' digest."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = materialize(docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), _digest().alias("digest")))
    goals = materialize(targets(sizes, weights, max_epochs))
    same = sizes["source"].eqNullSafe(goals["source"])
    rows = sizes.join(goals, same).select("doc_id", sizes["source"], "size", "digest", "source_size", "n_docs", "rank", "target", order.alias("order"))
    rows = rows.withColumn("bucket", F.floor(_number(F.col("order")) * F.ceil(F.col("n_docs") / BUCKET_ROWS)))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("rank", "bucket").orderBy("order", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(within)).join(sums, ["rank", "bucket"])
    rows = materialize(rows.withColumn("upto", F.col("ahead") + F.col("inside")).drop("ahead", "inside", "bucket", "n_docs"))

    turns = rows.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    turns = turns.withColumn("finish", finish).select("finish", "rank", "order", "doc_id", "digest", "epoch", "size", _cell(F.col("finish"), 0).alias("c0"), _cell(F.col("finish"), 1).alias("c1"))
    left = goals.agg(F.sum("source_size")).first()[0] or 0
    cells: list[int | None] = []
    part = turns
    for level in range(2):
        # At most 2 * GRID + 1 sums; the first cell that passes what is left holds the end.
        running = part.groupBy(f"c{level}").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy(f"c{level}")))
        found = running.where(F.col("upto") > left).orderBy("upto").select(f"c{level}", "words", "upto").first()
        if found is None:
            break
        cells.append(found[0])
        left -= found["upto"] - found["words"]
        part = part.where(F.col(f"c{level}") == found[0])
    last = None
    if len(cells) == 2:
        place = F.struct("finish", "rank", "order", "doc_id", "size", "digest", "epoch")
        running = part.withColumn("place", place).withColumn("upto", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
        last = running.where(F.col("upto") <= left).agg(F.max("place")).first()[0]

    def taken(epoch: int) -> Column:
        f = _finish(epoch)
        if len(cells) < 2:
            # No cell passes the budget: everything is taken.
            return F.lit(1) if not cells else F.when(_cell(f, 0) <= cells[0], 1).otherwise(0)
        first, second = _cell(f, 0), _cell(f, 1)
        earlier = (first < cells[0]) | ((first == cells[0]) & (second < cells[1]))
        if last is None:
            return F.when(earlier, 1).otherwise(0)
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["order"]).alias("order"), F.lit(last["doc_id"]).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["digest"]).alias("digest"), F.lit(last["epoch"]).alias("epoch"))
        own = F.struct(f.alias("finish"), F.col("rank").alias("rank"), F.col("order").alias("order"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), F.col("digest").alias("digest"), F.lit(epoch).alias("epoch"))
        inside = (first == cells[0]) & (second == cells[1]) & (own <= end)
        return F.when(earlier | inside, 1).otherwise(0)

    live = (F.col("size") > 0) & (F.col("target") > 0)
    copies = sum((taken(e) for e in range(1, max_epochs)), taken(0))
    rows = rows.withColumn("copies", F.when(live, copies).otherwise(0))
    return rows.select("doc_id", "source", "size", "digest", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def take(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: docs' rows, each as often as the mix takes it. Same columns, of any names.

    Of rows with the same id, source and text the mix may take some more often than others; which of them is which makes no odds to it.
    """
    own = own_names(docs, "_id", "_source", "_digest", "_copies", "_same", "_nth", "_copy")
    id, source, digest, copies, same, nth, copy = own
    key = [F.col("doc_id").alias(id), F.col("source").alias(source), F.col("digest").alias(digest)]
    # Copies of each of the equal rows; nearly always one row.
    chosen = _mixed(docs, weights, max_epochs, seed).groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(copies)).where(F.col(copies)[0] > 0)
    on = F.col("doc_id").eqNullSafe(F.col(id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(same) == F.col(digest))
    found = docs.withColumn(same, _digest()).join(chosen, on)
    several = F.size(copies) > 1
    alone = found.where(~several).withColumn(nth, F.lit(1))
    equal = found.where(several).withColumn(nth, F.row_number().over(Window.partitionBy(id, source, digest).orderBy(F.lit(0))))
    drawn = alone.unionByName(equal).withColumn(copies, F.element_at(copies, F.col(nth))).where(F.col(copies) > 0)
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


#: DuckDB SQL for op10_mixing: the same order, as one running sum over all copies.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-1:' || doc_id) AS ord, md5(coalesce(text, '')) AS digest,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, ([5, 2, 1])[(rnk % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM per
), levels AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, rnk)
), free AS (
  SELECT place, lvl FROM levels WHERE lvl * weight <= cap ORDER BY place LIMIT 1
), goals AS (
  SELECT source, source_size, rnk,
         CASE WHEN free.place IS NULL OR levels.place < free.place THEN cap::DOUBLE ELSE free.lvl * weight END AS target
  FROM levels LEFT JOIN free ON true
), queued AS (
  SELECT s.doc_id, s.source, s.size, s.ord, s.digest, g.source_size, g.rnk, g.target,
         sum(s.size) OVER (PARTITION BY g.rnk ORDER BY s.ord, s.doc_id, s.size, s.digest ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), turns AS (
  SELECT *, (epoch * source_size + upto)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0 AND target > 0
), running AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rnk, ord, doc_id, size, digest, epoch ROWS UNBOUNDED PRECEDING) AS total FROM turns
), chosen AS (
  SELECT doc_id, count(*)::INT AS copies FROM running WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(c.copies, 0)::INT AS copies,
       coalesce(c.copies, 0)::BIGINT * q.size AS taken
FROM queued q LEFT JOIN chosen c USING (doc_id)
"""
