"""Token ids in compressed files: an adaptive context-mixing range coder over independent, checksummed blocks.

A block holds up to BLOCK_IDS ids as runs of RUN ids, coded side by side ("lanes") with one model, which takes in every step
of the lanes. The two ids before an id (order 2) and the one before it (order 1) propose two ids each, by what followed them;
order 0 counts the ids that no proposal met. What a proposal is worth is counted by how sure both orders are and
whether they agree, and the range coder takes the mix. The model starts anew in each block; reader and writer learn alike.

Block: magic, sizes, CRC-32 of the ids and of the rest, then the documents' ids and lengths and the lanes' words.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, number_of_parts, slices
from .tokens import tokenizer, vocabulary

MAGIC = b"IDC2"
BLOCK_IDS = 1 << 20
#: Bytes of text that a task encodes into its file.
FILE_BYTES = 1 << 28
RUN = 256
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
VOCABULARY_SIZE = 50_257
ID_BITS = 20  # of an id in a packed context; vocabularies are smaller
ID_MASK = (1 << ID_BITS) - 1
SUREST = 3
SLOTS = 1 << 18
#: What an id may be to its predictions: first of order 2, of order 1, second of order 2, of order 1, none of these.
KINDS = 5
MIXES = 2 * (SUREST + 1) ** 2
FIRST_MIX = (4, 4, 1, 1, 20)
OFTEN = 16  # steps after which counts and mix are worked into the ranges; in every step at first
GAIN = 24  # what one occurrence adds to an id's count
_HEADER = struct.Struct("<4sIIIIIII")  # magic, ids, vocabulary, lanes, documents' bytes, words, crc of ids, crc of the rest
_ONE = 1 << 2 * ID_BITS
_SURER = np.where(np.arange(SUREST + 1) < SUREST, _ONE, 0)
_HIT_BITS = np.arange(KINDS - 1, dtype=np.uint8)[:, None]
_FIRST_HIT = np.array([next((k for k in range(KINDS - 1) if bits >> k & 1), KINDS - 1) for bits in range(1 << KINDS - 1)])
_U = np.uint64
_WORD, _LOW = _U(32), _U(1 << 32)
SHARE = 1024  # what the kinds' shares add up to; times the counts' total it stays below 2**32
MOST = 1 << 20  # counts are halved when their total is over it, so readers can afford a table of it


# --- model --------------------------------------------------------------------------------------


class Context:
    """What followed each context: two ids and how sure the first is (0 to SUREST), packed in a word so one look-up has all."""

    def __init__(self, slots: int, none: int):
        self.packed = np.full(slots, none << ID_BITS | none, dtype=np.int64)

    def look(self, slot: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed words, how sure); the ids go to first and second."""
        p = self.packed.take(slot)
        np.bitwise_and(p, ID_MASK, out=first)
        np.right_shift(p, ID_BITS, out=second)
        second &= ID_MASK
        return p, p >> 2 * ID_BITS

    def learn(self, slot: np.ndarray, ids: np.ndarray, first: np.ndarray, p: np.ndarray, sure: np.ndarray) -> None:
        """A hit makes the first id surer. Another id makes a sure one less so and comes second; an unsure one makes way for it.

        Of equal contexts in one step the last one stays.
        """
        replaced = first << ID_BITS
        replaced += ids
        replaced += _ONE
        second = p & ~(ID_MASK << ID_BITS)
        second += (ids << ID_BITS) - _ONE
        out = np.where(sure < 2, replaced, second)
        np.copyto(out, p + _SURER.take(sure), where=ids == first)
        self.packed[slot] = out


class Mixer:
    """Predictions of a block; both sides look and learn in the same order.

    Order 2 and order 1 propose two ids each; order 0 has a count for every id, of the times that all proposals failed. How much of
    the range each proposal gets is counted by how sure the two orders are and whether they agree.
    """

    def __init__(self, size: int, lanes: int, reads: bool):
        self.size, self.steps, self.reads = size, 0, reads
        self.two, self.one = Context(SLOTS, size), Context(size + 1, size)
        self.counts = np.ones(size, dtype=np.int64)
        self.missed: list[np.ndarray] = []
        self.mix = np.tile(np.array(FIRST_MIX, dtype=np.int64), (MIXES, 1))
        self.proposed = np.empty((KINDS, lanes), dtype=np.int64)
        self.kinds = np.tile(np.arange(KINDS, dtype=np.int8), MIXES)
        self.ids = np.arange(size, dtype=np.uint16 if size <= 1 << 16 else np.uint32)
        self._settle_counts()
        self._settle_mix()

    def _settle_counts(self) -> None:
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))
        self.total = int(self.bounds[-1])
        if self.reads:
            self.id_at = np.repeat(self.ids, self.counts)

    def _settle_mix(self) -> None:
        share = 1 + self.mix * (SHARE - KINDS) // self.mix.sum(axis=1, keepdims=True)
        share[:, -1] += SHARE - share.sum(axis=1)
        # By context * KINDS + kind: width and start; for readers, by context * SHARE + place: the kind.
        self.share, self.start = share.ravel(), (np.cumsum(share, axis=1) - share).ravel()
        if self.reads:
            self.kind_at = np.repeat(self.kinds, self.share)

    def look(self, last: np.ndarray, before: np.ndarray):
        """(proposals by kind, mixing context, what learn() needs)."""
        slot = before * 2_654_435_761
        slot ^= last * 40_503_119
        slot >>= 9
        slot &= SLOTS - 1
        ids = self.proposed[:, : len(last)]
        two, sure_two = self.two.look(slot, ids[0], ids[2])
        one, sure_one = self.one.look(last, ids[1], ids[3])
        context = sure_two * (2 * SUREST + 2) + 2 * sure_one
        context += ids[0] == ids[1]
        return ids, context, (slot, two, sure_two, last, one, sure_one)

    def learn(self, ids: np.ndarray, proposed: np.ndarray, place: np.ndarray, missed: np.ndarray, seen: tuple) -> None:
        """Take in a step's ids; place: context * KINDS + kind of each."""
        slot, two, sure_two, last, one, sure_one = seen
        self.two.learn(slot, ids, proposed[0], two, sure_two)
        self.one.learn(last, ids, proposed[1], one, sure_one)
        self.mix += np.bincount(place, minlength=MIXES * KINDS).reshape(MIXES, KINDS)
        self.missed.append(missed)
        self.steps += 1
        if self.steps <= OFTEN or self.steps % OFTEN == 0:
            self._settle_mix()
            self.counts += GAIN * np.bincount(np.concatenate(self.missed), minlength=self.size)
            self.missed = []
            if self.counts.sum() > MOST:
                self.counts = (self.counts + 1) >> 1
            self._settle_counts()


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, ids in the last one)."""
    lanes = -(-n // RUN)
    return lanes, n - (lanes - 1) * RUN


# --- range coder --------------------------------------------------------------------------------


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose upper word is ready; where the range got narrow across a carry it is cut, so the word is ready too."""
    ready = (low ^ (low + span)) < _LOW
    narrow = span < _LOW
    out = np.flatnonzero(ready | narrow)
    if len(out):
        at = out[~ready[out]]
        span[at] = (~low[at] + _U(1)) & (_LOW - _U(1))
    return out


class Writer:
    """Carry-less range coders, one for each lane, that put out 32-bit words."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        # An id puts out one word at most.
        self.words = np.zeros((lanes, RUN + 4), dtype="<u4")
        self.used = np.zeros(lanes, dtype=np.int64)

    def put(self, n: int, start: np.ndarray, width: np.ndarray, total) -> None:
        """Code the interval [start, start + width) of total in the first n lanes."""
        low, span = self.low[:n], self.range[:n]
        unit = span // total
        low += start * unit
        np.multiply(unit, width, out=span)
        out = _settled(low, span)
        if len(out):
            self.words[out, self.used[out]] = (low[out] >> _WORD).astype(np.uint32)
            self.used[out] += 1
            low[out] <<= _WORD
            span[out] <<= _WORD

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all lanes, words per lane). One word does where it can be rounded up; readers take zeros after the end."""
        lanes = np.arange(len(self.low))
        lower = self.low & (_LOW - _U(1))
        up = (lower > 0) & (self.low < _U(0xFFFFFFFF00000000))
        self.words[lanes, self.used] = ((self.low >> _WORD) + up).astype(np.uint32)
        self.used += 1
        both = np.flatnonzero((lower > 0) & ~up)
        self.words[both, self.used[both]] = lower[both].astype(np.uint32)
        self.used[both] += 1
        return self.words[np.arange(self.words.shape[1]) < self.used[:, None]], self.used


class Reader:
    def __init__(self, words: np.ndarray, used: np.ndarray):
        width = int(used.max()) + 3
        table = np.zeros((len(used), width), dtype=np.uint64)
        table[np.arange(width) < used[:, None]] = words
        self.words, self.at = table.ravel(), np.arange(len(used)) * width + 2
        self.code = table[:, 0] << _WORD | table[:, 1]
        self.low = np.zeros(len(used), dtype=np.uint64)
        self.range = np.full(len(used), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)

    def value(self, n: int, total) -> np.ndarray:
        """Where the code of each of the first n lanes stands in [0, total)."""
        self.unit = self.range[:n] // total
        return np.minimum((self.code[:n] - self.low[:n]) // self.unit, total - _U(1)).view(np.int64)

    def take(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        """Move on past the interval that value() fell in."""
        low, span, code = self.low[:n], self.range[:n], self.code[:n]
        low += start * self.unit
        np.multiply(self.unit, width, out=span)
        out = _settled(low, span)
        if len(out):
            code[out] = code[out] << _WORD | self.words[self.at[out]]
            self.at[out] += 1
            low[out] <<= _WORD
            span[out] <<= _WORD


# --- blocks -------------------------------------------------------------------------------------


def encode_ids(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    lanes, last_len = _lanes(len(ids))
    padded = np.zeros(lanes * RUN, dtype=np.int64)
    padded[: len(ids)] = ids
    # A row for each step, a column for each lane; two rows of no id ahead.
    grid = np.full((RUN + 2, lanes), size, dtype=np.int64)
    grid[2:] = padded.reshape(lanes, RUN).T
    model, writer = Mixer(size, lanes, False), Writer(lanes)
    for k in range(RUN if lanes > 1 else last_len):
        n = lanes if k < last_len else lanes - 1
        cur = grid[k + 2, :n]
        proposed, context, seen = model.look(grid[k + 1, :n], grid[k, :n])
        hits = (proposed[: KINDS - 1] == cur).view(np.uint8)
        hits <<= _HIT_BITS
        kind = _FIRST_HIT.take(hits[0] | hits[1] | hits[2] | hits[3])
        place = context * KINDS + kind
        miss = np.flatnonzero(kind == KINDS - 1)
        share = model.share.take(place)
        start, width = model.start.take(place) * model.total, share * model.total
        missed, part = cur.take(miss), share.take(miss)
        start[miss] += model.bounds.take(missed) * part
        width[miss] = model.counts.take(missed) * part
        writer.put(n, start.view(np.uint64), width.view(np.uint64), _U(SHARE * model.total))
        model.learn(cur, proposed, place, missed, seen)
    return writer.finish()


def decode_ids(words: np.ndarray, used: np.ndarray, n_ids: int, size: int) -> np.ndarray:
    lanes, last_len = _lanes(n_ids)
    grid = np.full((RUN + 2, lanes), size, dtype=np.int64)
    model, reader = Mixer(size, lanes, True), Reader(words, used)
    lane, row, flat = np.arange(lanes), np.arange(KINDS) * lanes, model.proposed.ravel()
    for k in range(RUN if lanes > 1 else last_len):
        n = lanes if k < last_len else lanes - 1
        proposed, context, seen = model.look(grid[k + 1, :n], grid[k, :n])
        v = reader.value(n, _U(SHARE * model.total))
        kind = model.kind_at.take(context * SHARE + v // model.total)
        place = context * KINDS + kind
        share, start = model.share.take(place), model.start.take(place)
        start *= model.total
        width = share * model.total
        miss = np.flatnonzero(kind == KINDS - 1)
        ids = flat.take(row.take(kind) + lane[:n])
        part, begin = share.take(miss), start.take(miss)
        found = model.id_at.take((v.take(miss) - begin) // part).astype(np.int64)
        start[miss] = begin + model.bounds.take(found) * part
        width[miss] = model.counts.take(found) * part
        ids[miss] = found
        reader.take(n, start.view(np.uint64), width.view(np.uint64))
        grid[k + 2, :n] = ids
        model.learn(ids, proposed, place, found, seen)
    return grid[2:].T.ravel()[:n_ids].astype(np.uint32)


def write_block(ids: np.ndarray, documents: list[tuple[int | None, int, bool]], size: int) -> bytes:
    """documents in order: (doc_id, how many ids of it are in this block, whether it goes on in the next block)."""
    words, used = encode_ids(ids, size) if len(ids) else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
    names = zlib.compress(np.array([[0 if d is None else d, d is not None, n, more] for d, n, more in documents], dtype="<i8").tobytes(), 6)
    rest = used.astype("<u2").tobytes() + names + words.astype("<u4").tobytes()
    head = _HEADER.pack(MAGIC, len(ids), size, len(used), len(names), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest))
    return head + rest


def read_block(data: bytes) -> tuple[np.ndarray, list[tuple[int | None, int, bool]]]:
    """(ids, documents) of a block; ValueError if it is damaged."""
    if len(data) < _HEADER.size:
        raise ValueError("id block: too short")
    magic, n_ids, size, lanes, n_names, n_words, ids_crc, rest_crc = _HEADER.unpack_from(data)
    rest = data[_HEADER.size :]
    if magic != MAGIC or zlib.crc32(rest) != rest_crc or len(rest) != 2 * lanes + n_names + 4 * n_words:
        raise ValueError("id block: damaged")
    used = np.frombuffer(rest, dtype="<u2", count=lanes).astype(np.int64)
    names = np.frombuffer(zlib.decompress(rest[2 * lanes : 2 * lanes + n_names]), dtype="<i8").reshape(-1, 4)
    words = np.frombuffer(rest, dtype="<u4", offset=2 * lanes + n_names)
    ids = decode_ids(words, used, n_ids, size) if n_ids else np.zeros(0, dtype=np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("id block: ids differ from their checksum")
    return ids, [(int(d) if some else None, int(n), bool(more)) for d, some, n, more in names]


# --- Spark --------------------------------------------------------------------------------------

_BLOCKS = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("n_ids", pa.int64()), ("block", pa.binary())])
_BLOCKS_SQL = "file_no int, block_no int, n_ids long, block binary"


def _encode(path: str, size: int):
    def run(batches):
        file_no, block_no = TaskContext.get().partitionId(), 0
        encode = tokenizer(path or vocabulary(VOCABULARY), lower=False).encode
        held, documents, filled = [], [], 0

        def block():
            return batch_of(_BLOCKS, [file_no], [block_no], [filled], [write_block(np.concatenate(held), documents, size)])

        for batch in slices(batches, max_chars=30_000_000):
            names = batch.column("doc_id").to_pylist()
            for row, ids in encode(batch.column("text")):
                ids = np.append(ids, np.uint32(END_ID))
                while len(ids):
                    part, ids = ids[: BLOCK_IDS - filled], ids[BLOCK_IDS - filled :]
                    held.append(part)
                    documents.append((names[row], len(part), bool(len(ids))))
                    filled += len(part)
                    if filled == BLOCK_IDS:
                        yield block()
                        held, documents, filled, block_no = [], [], 0, block_no + 1
        if filled:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str = "", vocabulary_size: int = VOCABULARY_SIZE) -> None:
    """Encode whole texts and write their ids, an end id after each document, as blocks in ascending doc_id order.

    path: a new folder. file_no counts the ranges of doc_id, block_no the blocks of a file; Parquet is only their
    envelope, so any store that Spark writes to will do, with its commit of whole tasks. Null texts count as
    empty; null ids come first. A file takes about FILE_BYTES of text, or less: there are as many as the session has
    shuffle partitions, more where that is needed.
    """
    # The hash deals out repeated and null ids too.
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = number_of_parts(docs.sparkSession, size, FILE_BYTES)
    ordered = keyed.repartitionByRange(*parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    blocks = ordered.mapInArrow(_encode(tokenizer_path, vocabulary_size), _BLOCKS_SQL)
    blocks.write.option("compression", "uncompressed").parquet(path)


_READ = pa.schema([("doc_id", pa.int64()), ("file_no", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_READ_SQL = "doc_id long, file_no int, inside long, n_tokens long, ids_crc32 long, ids binary"


def _decode(with_ids: bool):
    def run(batches):
        """Blocks sorted by (file_no, block_no) -> a row for each document, put together from its parts."""
        file_no, inside = None, 0
        crc, size, parts = 0, 0, []
        for batch in batches:
            rows = []
            for f, data in zip(batch.column("file_no").to_pylist(), batch.column("block")):
                ids, documents = read_block(data.as_py())
                if f != file_no:
                    file_no, inside = f, 0
                at = 0
                for name, n, more in documents:
                    part = ids[at : at + n].astype("<u4").tobytes()
                    at += n
                    size += n
                    crc = zlib.crc32(part, crc)
                    if with_ids:
                        parts.append(part)
                    if not more:
                        rows.append((name, file_no, inside, size, crc, b"".join(parts) if with_ids else None))
                        inside += size
                        crc, size, parts = 0, 0, []
            if rows:
                yield batch_of(_READ, *map(list, zip(*rows)))

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian 32-bit) of each document, from the files at path."""
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(path)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    parts = number_of_parts(spark, (blocks.agg(F.max("file_no")).first()[0] or 0) + 1, 1)
    ordered = blocks.select("file_no", "block_no", "block").repartitionByRange(*parts, "file_no").sortWithinPartitions("file_no", "block_no")
    parts = ordered.mapInArrow(_decode(with_ids), _READ_SQL)
    out = parts.join(files, "file_no").select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def id_files(docs: DataFrame, folder: str, tokenizer_path: str = "") -> DataFrame:
    """Write docs' ids under folder and read them back: doc_id, start, n_tokens, ids_crc32.

    docs: doc_id (long) and text; other columns are left unread. Every document has its end id, so empty and
    null texts have one id. Repeated rows are written one after another. An empty table writes no block and gives no rows.
    """
    path = f"{folder}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer_path)
    return read_ids(docs.sparkSession, path)
