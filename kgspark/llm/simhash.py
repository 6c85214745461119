"""SimHash near-dedup: fingerprints of word shingles, linked through Golay-code keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, number_of_parts, own_names, slices, string_list

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Keys that a task links, about: 64 MB of them.
KEYS_A_PART = 1 << 22
#: Bits of a fingerprint's three segments, each at most the code's 23.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23, dimension 12 and distance 7.
GOLAY = 0xAE3
_LOW = np.uint64(0x0101010101010101)


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8").lower().split()
    if not words:
        return []
    data = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(data, SEED)]
    h = xxhash.xxh64_intdigest
    starts = [0] + [e + 1 for e in ends]
    return [h(data[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of the 64 bits; starts: where the runs begin (none is empty).

    Runs are cut into parts of at most 255 hashes, whose counts fit the eight bytes of a word.
    """
    ends = np.append(starts[1:], len(hashes))
    n_parts = -(-(ends - starts) // 255)
    first = np.cumsum(n_parts) - n_parts
    parts = np.repeat(starts - 255 * first, n_parts) + 255 * np.arange(int(n_parts.sum()))
    out = np.empty((len(starts), 64), dtype=np.int64)
    for b in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & _LOW, parts)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        out[:, b::8] = lanes
    return out


_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYED = pa.schema([*_PRINT, ("sha", pa.string())])


def _prints_of(texts) -> np.ndarray:
    each = [shingle_hashes(t) for t in string_list(texts)]
    n = np.array([len(x) for x in each], dtype=np.int64)
    fps = np.zeros(len(each), dtype=np.uint64)
    some = n > 0
    if some.any():
        flat = np.fromiter((h for x in each for h in x), dtype=np.uint64, count=int(n.sum()))
        counts = _bit_counts(flat, (np.cumsum(n) - n)[some])
        bits = counts * 2 > n[some, None]
        fps[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return fps.view(np.int64)


def _fingerprints(batches):
    for batch in slices(batches, max_chars=2_000_000):
        yield batch_of(_PRINT, batch.column("doc_id"), _prints_of(batch.column("text")))


def _keyed_fingerprints(batches):
    for batch in slices(batches, max_chars=2_000_000):
        yield batch_of(_KEYED, batch.column("doc_id"), _prints_of(batch.column("text")), batch.column("_sha"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp: the 64-bit fingerprint as a signed long. No words: zero."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# --- Golay keys ---------------------------------------------------------------------------------


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GOLAY << (i - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits, and the error of weight 3 or less for each remainder.

    The code is perfect: each of the 2048 remainders has exactly one such error.
    """
    low = np.array([_remainder(v) for v in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], dtype=np.int64)
    unit = [1 << i for i in range(23)]
    errors = [0, *unit, *(a | b for i, a in enumerate(unit) for b in unit[:i]), *(a | b | c for i, a in enumerate(unit) for j, b in enumerate(unit[:i]) for c in unit[:j])]
    table = np.zeros(1 << 11, dtype=np.int64)
    for e in errors:
        table[low[e & 4095] ^ high[e >> 12]] = e
    return low, high, table


_CODE: list[np.ndarray] = []


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12 leading bits, which name it, of the codeword nearest to each 23-bit word."""
    if not _CODE:
        _CODE.extend(_tables())
    low, high, error = _CODE
    return (v ^ error[low[v & 4095] ^ high[v >> 12]]) >> 11


def nearby_indices(v: np.ndarray, width: int) -> np.ndarray:
    """A row for each word: indices of the codewords nearest to it and to each word one bit (below width) away.

    Two words at most one bit apart share an index: each one's own codeword is in the other's row.
    """
    near = v[:, None] ^ np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
    return codeword_index(near)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint), repeats left out.

    Two errors over three segments leave one segment without an error whose successor has one at most
    (errors 0-0-2, 0-1-1 and their turns). So a key is one segment as it is with an index of the next one:
    fingerprints within MAX_BITS share a key.
    """
    u = fps.view(np.uint64)
    parts, at = [], 0
    for width in SEGMENTS:
        parts.append((u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    keys, places = [], []
    for j in range(3):
        nxt = (j + 1) % 3
        index = np.sort(nearby_indices(parts[nxt], SEGMENTS[nxt]), axis=1)
        fresh = np.ones(index.shape, dtype=bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        keys.append(np.int64(j) << 34 | parts[j][row] << 12 | index[row, col])
        places.append(row)
    return np.concatenate(keys), np.concatenate(places)


_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def _emit_keys(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        keys, places = keys_of(fps)
        yield batch_of(_KEYS, keys, fps[places])


# --- links within a key -------------------------------------------------------------------------


def forest(fps: np.ndarray, group: np.ndarray, parts: int = 1) -> np.ndarray:
    """A label for each fingerprint, the same for those of a group that chains of links at MAX_BITS or less join.

    Fingerprints at most two bits apart have a word in common that is at most one bit from both. So all
    65 such words of each are sorted with the group, and equal ones join their fingerprints: linear in
    the fingerprints, no pairs. parts: the words are taken in so many portions to bound memory.
    """
    n = len(fps)
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    links = []
    for part in range(parts):
        words = (fps.view(np.uint64)[:, None] ^ flips).ravel()
        owner = np.repeat(np.arange(n), 65)
        if parts > 1:
            chosen = (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
            words, owner = words[chosen], owner[chosen]
        order = np.lexsort((words, group[owner]))
        words, owner = words[order], owner[order]
        same = (words[1:] == words[:-1]) & (group[owner[1:]] == group[owner[:-1]])
        pair = np.stack((owner[:-1][same], owner[1:][same]), axis=1)
        links.append(np.unique(pair, axis=0))
    pairs = np.unique(np.concatenate(links), axis=0)
    label = np.arange(n)
    while len(pairs):
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _link(batches):
    """Fingerprints sorted by key -> a forest of links in each key's group; a group may span batches."""

    def solved(keys, fps):
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(edge, len(keys)))
        shared = np.repeat(size > 1, size)
        fps, group = fps[shared], np.repeat(np.arange(len(size)), size)[shared]
        if not len(fps):
            return None
        us, vs, at = [], [], 0
        while at < len(fps):
            stop = min(len(fps), at + 4000)
            if stop < len(fps):  # whole groups only
                back = np.searchsorted(group, group[stop])
                stop = int(back) if back > at else int(np.searchsorted(group, group[at], side="right"))
            f = fps[at:stop]
            label = forest(f, group[at:stop], parts=1 + len(f) // 30_000)
            joined = np.flatnonzero(label != np.arange(len(f)))
            us.append(f[label[joined]])
            vs.append(f[joined])
            at = stop
        u, v = np.concatenate(us), np.concatenate(vs)
        if not len(u):
            return None
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1), axis=0)
        return batch_of(_EDGES, pairs[:, 0], pairs[:, 1])

    held = []
    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            done_k = np.concatenate([k for k, _ in held] + [keys[:cut]])
            done_f = np.concatenate([f for _, f in held] + [fps[:cut]])
            held = []
            if (out := solved(done_k, done_f)) is not None:
                yield out
        held.append((keys[cut:], fps[cut:]))
    if held and (out := solved(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))) is not None:
        yield out


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints (column fp) that join all within MAX_BITS bits."""
    keys = prints.mapInArrow(_emit_keys, "key long, fp long")
    parts = number_of_parts(prints.sparkSession, prints.count() * 16, KEYS_A_PART)
    shared = keys.repartition(*parts, "key").sortWithinPartitions("key", "fp")
    return shared.mapInArrow(_link, "u long, v long").distinct()


# --- components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it reaches) of every node of an edge (u, v).

    Alternates large-star and small-star steps, which only move edges to smaller ends, until nothing changes; that is after
    about as many rounds as the logarithm of the largest component, squared. Each round is a checkpoint in the shared folder; the
    driver sees only a count and a digest, and where these repeat, whether there is a link that wasn't there before.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        if not large:
            both = both.where("m < n")
        least = both.groupBy("n").agg(F.min("m").alias("least"))
        least = least.select("n", F.least("n", "least").alias("least"))
        moved = both.join(least, "n")
        if large:
            moved = moved.where("m > n").select(F.col("least").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.select(F.col("least").alias("u"), F.col("m").alias("v")).union(least.select(F.col("least").alias("u"), F.col("n").alias("v")))
        return moved.where("u <> v").distinct()

    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        moved = materialize(star(star(edges, True), False))
        now = state(moved)
        # As many links, none of them new: the same ones.
        if now == before and moved.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges, before = moved, now
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size.

    docs: doc_id (long) and text; other columns are left unread. Texts are lower-cased (A-Z) and cut into words
    at ASCII white space; fewer than three words are one shingle; null, empty and blank texts have fingerprint zero
    and are linked like any other. component_id is the smallest doc_id of the component (null ids only if it has
    no other). Repeated rows come back as often as they are there. An empty table gives no rows.
    Equal fingerprints are one node throughout, so a huge group of copies costs one fingerprint.
    """
    prints = materialize(fingerprints(docs))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    member = rooted.join(groups, "root").select("fp", "component_id", "component_size")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group; same columns.

    The row with the smallest doc_id stays (null last), of rows that share it the one with the least digest of its text,
    of repeated rows one. Rows are told apart by id and text, so unrelated texts without an id, or with the same one,
    all stay.
    """
    sha, kept_id, kept_sha = own_names(docs, "_sha", "_kept_id", "_kept_sha")
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    prints = materialize(keyed.select(F.col("doc_id").cast("long"), "text", F.col(sha).alias("_sha")).mapInArrow(_keyed_fingerprints, "doc_id long, fp long, sha string"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sha")).alias("first")
    nodes = materialize(prints.groupBy("fp").agg(first))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(kept_id), F.col("first.sha").alias(kept_sha))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return joined.dropDuplicates(["doc_id", sha]).select(*docs.columns)
