"""Compression of vectors to short codes: one codebook for each part of the vector, fitted by exact integer rounds.

A slice of the table is one row of flat blocks: for each part the slice's sub-vectors stand in the order of a Hilbert curve, cut into
blocks of BLOCK neighbours that carry their box (least and greatest component) and the sum of their components. In a round, the distances of
the codebook's entries from a box tell which entries can be nearest to anything in it: the block's shortlist. Where one entry is left, the
block's sum is all that is needed; else a small integer kernel looks at the block's points and its shortlist alone. The result is that of
comparing every point with every entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize

SCALE = 256
#: Scaled components are below this in size, so that squares and their sums stay within 64 bits.
LIMIT = 1 << 28
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors in a row of flat blocks, at most, and in a block.
SLICE, BLOCK = 1 << 14, 64
#: Numbers that a kernel works on at once.
_AT_ONCE = 1 << 21


# --- vectors as integers ------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """True where the vector is there and all its components are there and finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def longest(vectors: DataFrame, vector: str) -> int:
    return vectors.agg(F.max(F.size(vector))).first()[0] or 0


def integers(column, width: int) -> np.ndarray:
    """floor(SCALE * x) of a batch's vectors, a row each; vectors shorter than width end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component times {SCALE} is {LIMIT} or more")
    out = np.zeros((len(sizes), width), dtype=np.int32)
    out[np.arange(width) < sizes[:, None]] = scaled.astype(np.int32)
    return out


# --- flat blocks --------------------------------------------------------------------------------


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place of each point on a Hilbert curve through the points' box: bits by axis, turned round plane by plane, then interleaved."""
    n, axes = points.shape
    axes = min(axes, 62)
    if not n or not axes:
        return np.zeros(n, dtype=np.int64)
    bits = max(1, min(10, 62 // axes))
    low = points.min(axis=0)[:axes]
    span = np.maximum(points.max(axis=0)[:axes] - low, 1)
    x = ((points[:, :axes] - low).astype(np.float64) / span * ((1 << bits) - 1)).astype(np.int64)
    for bit in range(bits - 1, 0, -1):
        q = 1 << bit
        for i in range(axes):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(upper, q - 1, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> bit) & 1, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[:, i] >> bit) & 1
    return key


@dataclass
class Flat:
    """One part's sub-vectors of a slice: their order along the curve, the points in it, and each block's box and sum."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Flat:
        order = np.argsort(hilbert(points), kind="stable").astype(np.int32)
        points = points[order]
        begin = np.arange(0, len(points), BLOCK)
        return cls(order, points, np.minimum.reduceat(points, begin, axis=0), np.maximum.reduceat(points, begin, axis=0), np.add.reduceat(points.astype(np.int64), begin, axis=0))

    def to_bytes(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.order, self.points, self.low, self.high, self.sums))

    @classmethod
    def from_bytes(cls, data: bytes, n: int, width: int) -> Flat:
        blocks = -(-n // BLOCK)
        shapes = (((n,), "<i4"), ((n, width), "<i4"), ((blocks, width), "<i4"), ((blocks, width), "<i4"), ((blocks, width), "<i8"))
        out, at = [], 0
        for shape, kind in shapes:
            count = int(np.prod(shape))
            out.append(np.frombuffer(data, dtype=kind, count=count, offset=at).reshape(shape))
            at += count * np.dtype(kind).itemsize
        return cls(*out)


def shortlists(flat: Flat, book: np.ndarray) -> np.ndarray:
    """Flags (block, entry) of the entries that may be nearest to some point of the block.

    An entry that is farther from the whole box than another one is from the box's farthest corner is out; ties stay in.
    """
    low, high, book = flat.low[:, None].astype(np.int64), flat.high[:, None].astype(np.int64), book.astype(np.int64)
    gap = np.maximum(np.maximum(low - book, book - high), 0)
    reach = np.maximum(np.abs(book - low), np.abs(book - high))
    return (gap * gap).sum(axis=2) <= (reach * reach).sum(axis=2).min(axis=1)[:, None]


def nearest(flat: Flat, book: np.ndarray, want_error: bool):
    """(entry of each point in the curve's order, its squared distance or None).

    Blocks are taken together by the size of their shortlist. A shortlist holds its entries by index, filled up with its last one,
    so the first least distance is that of the lowest index.
    """
    n, width = flat.points.shape
    short = shortlists(flat, book)
    size = short.sum(axis=1)
    entry = np.zeros(len(size) * BLOCK, dtype=np.int64)
    error = np.zeros(len(size) * BLOCK, dtype=np.int64) if want_error else None
    points = np.zeros((len(size) * BLOCK, width), dtype=np.int64)
    points[:n] = flat.points
    points, most = points.reshape(len(size), BLOCK, width), int(max(abs(flat.low).max(initial=0), abs(flat.high).max(initial=0), abs(book).max(initial=0)))
    kind = np.int32 if 4 * most * most * max(width, 1) < 1 << 31 else np.int64
    classes = np.ceil(np.log2(size)).astype(np.int64)
    for c in np.unique(classes):
        blocks = np.flatnonzero(classes == c)
        listed = int(size[blocks].max())
        order = np.argsort(~short[blocks], axis=1, kind="stable")[:, :listed]
        place = np.minimum(np.arange(listed), size[blocks, None] - 1)
        listing = np.take_along_axis(order, place, axis=1)
        step = max(1, _AT_ONCE // (BLOCK * listed * max(width, 1)))
        for at in range(0, len(blocks), step):
            own, names = blocks[at : at + step], listing[at : at + step]
            rows = (own[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            if listed == 1 and not want_error:
                entry[rows] = np.repeat(names[:, 0], BLOCK)
                continue
            apart = points[own].astype(kind)[:, :, None, :] - book.astype(kind)[names][:, None, :, :]
            squares = np.einsum("bpew,bpew->bpe", apart, apart)
            best = squares.argmin(axis=2)
            entry[rows] = np.take_along_axis(names, best, axis=1).ravel()
            if want_error:
                error[rows] = np.take_along_axis(squares, best[:, :, None], axis=2).ravel()
    return entry[:n], error[:n] if want_error else None


def part_sums(flat: Flat, book: np.ndarray) -> np.ndarray:
    """(entry, component) sums of the points nearest to each entry, and their number as the last component."""
    n, width = flat.points.shape
    out = np.zeros((len(book), width + 1), dtype=np.int64)
    short = shortlists(flat, book)
    alone = short.sum(axis=1) == 1
    counts = np.minimum(BLOCK, n - np.arange(0, n, BLOCK))
    np.add.at(out, short.argmax(axis=1)[alone], np.concatenate((flat.sums, counts[:, None]), axis=1)[alone])
    rest = np.flatnonzero(~alone)
    if len(rest):
        rows = (rest[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rows = rows[rows < n]  # only the last block can be short
        some = Flat(flat.order[rows], flat.points[rows], flat.low[rest], flat.high[rest], flat.sums[rest])
        entry, _ = nearest(some, book, False)
        np.add.at(out, entry, np.concatenate((some.points, np.ones((len(rows), 1), dtype=np.int64)), axis=1))
    return out


# --- Spark --------------------------------------------------------------------------------------


def _blocks_of(ids, labels, matrix: np.ndarray, parts: int, schema: pa.Schema) -> pa.RecordBatch:
    n, width = matrix.shape[0], matrix.shape[1] // parts
    flat = [Flat.of(matrix[:, p * width : (p + 1) * width]).to_bytes() for p in range(parts)]
    one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a).cast(kind)
    return pa.RecordBatch.from_arrays([one(ids, schema.field(0).type), one(labels, schema.field(1).type), pa.array([n], pa.int32()), pa.array([flat], pa.list_(pa.binary()))], schema=schema)


def flat_blocks(vectors: DataFrame, id: str, vector: str, label: str, parts: int, width: int) -> DataFrame:
    """Rows ids, labels, n, flat: SLICE vectors each at most, with the flat blocks of each part. No shuffle: a task cuts what it reads."""
    kinds = dict(vectors.dtypes)

    def run(batches):
        held, schema = [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("ids", pa.list_(batch.schema.field(0).type)), ("labels", pa.list_(batch.schema.field(2).type)), ("n", pa.int32()), ("flat", pa.list_(pa.binary()))])
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held.append((part.column(0), part.column(2), integers(part.column(1), width * parts)))
                if sum(len(h[2]) for h in held) >= SLICE:
                    yield joined(held, schema)
                    held = []
        if held and sum(len(h[2]) for h in held):
            yield joined(held, schema)

    def joined(held, schema):
        ids, labels, matrices = zip(*held)
        return _blocks_of(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(matrices), parts, schema)

    schema = f"ids array<{kinds[id]}>, labels array<{kinds[label]}>, n int, flat array<binary>"
    return vectors.select(id, vector, label).mapInArrow(run, schema)


def _each_flat(batch, width: int):
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        yield i, n, [Flat.from_bytes(data, n, width) for data in batch.column("flat")[i].as_py()]


_CELLS = pa.schema([("cell", pa.int32()), ("total", pa.int64())])


def _round(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            for _, _, flats in _each_flat(batch, width):
                for p, flat in enumerate(flats):
                    total[p] += part_sums(flat, books[p])
        cells = np.flatnonzero(total)
        yield batch_of(_CELLS, cells.astype(np.int32), total.ravel()[cells])

    return run


def fit(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (part, entry, component) after so many rounds. A task sends one sum for each of their numbers, so does the driver get."""
    for _ in range(rounds):
        cells = blocks.mapInArrow(_round(books), "cell int, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
        parts, entries, width = books.shape
        total = np.zeros(parts * entries * (width + 1), dtype=object)
        for row in cells.collect():
            total[row.cell] = int(row.total)
        total = total.reshape(parts, entries, width + 1)
        books = books.copy()
        for p, e in zip(*np.nonzero(total[:, :, -1])):
            books[p, e] = [s // total[p, e, -1] for s in total[p, e, :-1]]
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _encode(books: np.ndarray):
    width = books.shape[2]
    digits = np.array([f"{e:02x}" for e in range(books.shape[1])])

    def run(batches):
        for batch in batches:
            for i, n, flats in _each_flat(batch, width):
                codes, errors = np.zeros((n, len(flats)), dtype=np.int64), np.zeros(n, dtype=np.int64)
                for p, flat in enumerate(flats):
                    entry, error = nearest(flat, books[p], True)
                    codes[flat.order, p] = entry
                    errors[flat.order] += error
                text = ["".join(row) for row in digits[codes].tolist()]
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(errors)], names=["id", "label", "code", "error"])

    return run


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector of flat_blocks."""
    kinds = dict(blocks.dtypes)
    return blocks.mapInArrow(_encode(books), f"id {kinds['ids'][6:-1]}, label {kinds['labels'][6:-1]}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """codes with a column vector: the entries that each code names, put together. Built-ins only; books is of a fixed, small size."""
    parts, entries, _ = books.shape
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in books[p, e]]) for e in range(entries)]) for p in range(parts)])
    piece = lambda p: F.element_at(F.element_at(table, p + 1), F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int") + 1)
    return codes.withColumn("vector", F.concat(*[piece(p) for p in range(parts)]))


def first_books(vectors: DataFrame, id: str, vector: str, parts: int, entries: int, width: int) -> np.ndarray:
    """The first codebooks: the parts of the vectors with the smallest ids (null last, ties by the vector)."""
    first = vectors.orderBy(F.col(id).asc_nulls_last(), vector).limit(entries).select(vector).toArrow()
    matrix = integers(first.column(0), width * parts)
    return matrix.reshape(len(matrix), parts, width).transpose(1, 0, 2).astype(np.int64)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code and error of each vector; the codebooks as integers by part, entry and component).

    Rows whose vector is null or holds null or non-finite components are left out. Components become floor(256 * x), which must be below
    2**28 in size (else an error says so). Vectors shorter than the longest, and a length that parts doesn't divide, are filled
    up with zeros. Each repeated row counts, also among the first entries; fewer rows than entries give a smaller codebook. Labels
    and ids of any type, null ones too, are carried along; other columns are left unread. An empty table gives no rows and codebooks
    without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    kept = vectors.select(id, vector, label).where(usable(vector))
    width = -(-longest(kept, vector) // parts)
    books = first_books(kept, id, vector, parts, entries, width)
    blocks = flat_blocks(kept, id, vector, label, parts, width)
    if not books.shape[1]:
        return encode(blocks, books), books
    blocks = materialize(blocks)
    books = fit(blocks, books, rounds)
    return encode(blocks, books), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256; see compress.

    label_error is the sum of error over the rows with the same label, nulls together: summed before any exchange, and joined back by
    label, so a label that holds most rows is no burden.
    """
    coded, books = compress(vectors)
    coded = materialize(coded)
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    return f"""
near{k} AS (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM pieces p JOIN book{k} b ON p.part = b.part) GROUP BY ALL
)"""


def _sql_book(k: int) -> str:
    return f"""
mean{k} AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT n.part, n.entry, s.place, CASE WHEN sum(p.v[s.place]) >= 0 THEN sum(p.v[s.place]) // count(*) ELSE -((-sum(p.v[s.place]) + count(*) - 1) // count(*)) END::BIGINT AS m
    FROM near{k} n JOIN pieces p USING (vec_id, part), (SELECT unnest(range(1, 5)) AS place) s GROUP BY ALL) GROUP BY ALL
), book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)
)"""


#: DuckDB SQL for op11_vector_codes: every point against every entry (vectors of 64 components, ids that don't repeat).
ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
  SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS v FROM kept, (SELECT unnest(range(16)) AS part)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (
  SELECT part, entry, v FROM pieces JOIN firsts USING (vec_id)
),{_sql_round(0)},{_sql_book(0)},{_sql_round(1)},{_sql_book(1)},{_sql_round(2)},
sha AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), sha
"""
