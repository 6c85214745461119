"""Best-fit packing of token sequences with a swap-based local search."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices
from .tokens import tokenizer, vocabulary

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs at once, and how many groups' emptiest sequences the next round packs together.
GROUP_PIECES = 8192
JOINED_GROUPS = 64
VOCABULARY = "word_bpe_49k.json"


# --- pieces -------------------------------------------------------------------------------------

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, capacity: int):
    def run(batches):
        encode = tokenizer(path or vocabulary(VOCABULARY), lower=True, keep=400_000).encode
        for batch in slices(batches, max_chars=12_000_000):
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for row, tokens in encode(batch.column("text")):
                tokens = np.append(tokens, np.uint32(END_ID))
                for k, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start : start + capacity]
                    rows.append((ids[row], k, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            if rows:
                yield batch_of(_PIECES, *map(list, zip(*rows)))

    return run


def pieces(docs: DataFrame, tokenizer_path: str = "", capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32. A null text is empty."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path, capacity), schema)


# --- packing one group --------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item places: longest first, each into the fullest bin that it fits."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        if r > n:
            room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins


def bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: what all items fill, or those that can't share a bin with another such one."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


class Search:
    """Bins while items move between them. Each step takes from a bin and makes a fuller one fuller, so the sum of squared fills
    grows."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.n = np.asarray(lengths, dtype=np.int64)
        self.bin_of = np.empty(len(self.n), dtype=np.int64)
        for b, items in enumerate(bins):
            self.bin_of[items] = b
        self.fill = np.bincount(self.bin_of, weights=self.n, minlength=len(bins)).astype(np.int64)
        self.capacity = capacity

    def _put(self, item, b: int) -> None:
        np.subtract.at(self.fill, self.bin_of[item], self.n[item])
        self.bin_of[item] = b
        self.fill[b] += self.n[item].sum()

    def _room(self, a: int) -> np.ndarray:
        """Room of the bins that a may give to, which are those as full as itself or fuller; 0 for all others."""
        room = np.where(self.fill >= self.fill[a], self.capacity - self.fill, 0)
        room[a] = 0
        return room

    def _sums(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, pairs) of two items of one bin each; one pair for each bin and sum."""
        items = items[np.lexsort((self.n[items], self.bin_of[items]))]
        first, second = [], []
        for shift in range(1, len(items)):
            same = np.flatnonzero(self.bin_of[items[shift:]] == self.bin_of[items[:-shift]])
            if not len(same):
                break
            first.append(items[same])
            second.append(items[same + shift])
        if not first:
            return np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
        pairs = np.stack((np.concatenate(first), np.concatenate(second)), axis=1)
        return self.n[pairs].sum(axis=1), pairs

    def _exchange(self, a: int, mine: np.ndarray, mine_size: np.ndarray, theirs: np.ndarray, their_size: np.ndarray, room: np.ndarray) -> bool:
        """The exchange between a and another bin after which the squared fill has grown most; rows of mine and theirs change places."""
        where = self.bin_of[theirs[:, 0]]
        most, best = 0, None
        for k in np.unique(mine_size, return_index=True)[1]:
            d = mine_size[k] - their_size
            gain = np.where((d > 0) & (d <= room[where]), d * (self.fill[where] - self.fill[a] + d), 0)
            j = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[j] > most:
                most, best = gain[j], (k, j)
        if best is None:
            return False
        k, j = best
        b = int(where[j])
        self._put(mine[k], b)
        self._put(theirs[j], a)
        return True

    def step(self, a: int) -> bool:
        """Move an item of bin a into the bin that it fits best; else exchange one for one, else one for two or two for one."""
        mine = np.flatnonzero(self.bin_of == a)
        mine = mine[np.argsort(-self.n[mine], kind="stable")]
        room = self._room(a)
        most = int(room.max(initial=0))
        fits = mine[self.n[mine] <= most]
        if len(fits):
            left = room - self.n[fits[0]]
            self._put(fits[:1], int(np.where(left >= 0, left, self.capacity).argmin()))
            return True
        if not most:
            return False
        theirs = np.flatnonzero(room[self.bin_of] > 0)
        if self._exchange(a, mine[:, None], self.n[mine], theirs[:, None], self.n[theirs], room):
            return True
        sums, pairs = self._sums(theirs)
        if self._exchange(a, mine[:, None], self.n[mine], pairs, sums, room):
            return True
        sums, pairs = self._sums(mine)
        return bool(len(sums)) and self._exchange(a, pairs, sums, theirs[:, None], self.n[theirs], room)

    def drain(self, a: int) -> bool:
        """Steps until bin a is empty, which is returned, or none helps."""
        while self.fill[a] > 0 and self.step(a):
            pass
        return self.fill[a] == 0

    def run(self) -> None:
        """Drain the emptiest bins, again and again, until there are as few as can be or a pass over all empties none.

        Then the emptiest bin gives what it can once more, so what is free comes together in it.
        """
        least = bound(self.n, self.capacity)
        emptied = True
        while emptied:
            emptied = False
            for a in np.argsort(self.fill, kind="stable"):
                if np.count_nonzero(self.fill) <= least:
                    break
                if 0 < self.fill[a] < self.capacity:
                    emptied |= self.drain(int(a))
            if np.count_nonzero(self.fill) <= least:
                break
        some = np.flatnonzero(self.fill)
        if len(some):
            self.drain(int(some[self.fill[some].argmin()]))


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins after the search, the emptiest one last."""
    if not bins:
        return []
    search = Search(bins, lengths, capacity)
    search.run()
    order = np.argsort(search.bin_of, kind="stable")
    edges = np.searchsorted(search.bin_of[order], np.arange(len(bins) + 1))
    out = [order[i:j].tolist() for i, j in zip(edges, edges[1:]) if j > i]
    return sorted(out, key=lambda b: -int(search.n[b].sum()))


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("spare", pa.bool_()), ("grp", pa.int64())])
_PACKED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, spare boolean, grp long"


def _pack(capacity: int, level: int, last: bool):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = part.column("length").to_pylist()
        grp = part.column("grp")[0].as_py()
        base = level << 60 | grp << 20
        sequence, offset, spare = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        bins = pack_lengths(lengths, capacity)
        for b, items in enumerate(bins):
            # The emptiest sequence meets those of other groups, unless it is full.
            release = not last and b == len(bins) - 1 and sum(lengths[i] for i in items) < capacity
            at = 0
            for i in items:
                sequence[i], offset[i], spare[i] = base + b, at, release
                at += lengths[i]
        columns = (pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(spare), pa.array([grp] * len(lengths), pa.int64()))
        return pa.table([*(part.column(c) for c in _PIECES.names), *columns], names=_PACKED.names).cast(_PACKED)

    return run


def pack(docs: DataFrame, tokenizer_path: str = "", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, joined: int = JOINED_GROUPS) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most capacity tokens.

    docs: doc_id (long) and text; other columns are left unread. A document is its whole text's ids and an end id
    (null and empty texts: the end id alone); only documents longer than a sequence are cut. Repeated rows are packed as often as
    they are there. An empty table gives no rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt to groups of about group_pieces by their row, so equal ones are dealt out too; each group is packed by itself: best
    fit, longest first, then the local search. The emptiest sequence of each of `joined` groups goes into a group of the next
    round, until one group is left, so all of them together waste what one does.
    """
    cut = materialize(pieces(docs, tokenizer_path, capacity))
    groups = max(1, round(cut.count() / group_pieces))
    todo = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    done, level = None, 0
    while True:
        last = groups == 1
        packed = todo.groupBy("grp").applyInArrow(_pack(capacity, level, last), _PACKED_SQL)
        packed = packed if last else materialize(packed)
        fixed = packed.where(~F.col("spare")).drop("spare", "grp")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            return done
        groups, level = -(-groups // joined), level + 1
        todo = packed.where("spare").select(*_PIECES.names, F.floor(F.col("grp") / joined).cast("long").alias("grp"))
