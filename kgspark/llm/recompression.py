"""Removal of long repeated word sequences by recompression: pairs of symbols are replaced, round by round, the same way everywhere.

A text starts as its words. In a round each symbol is a left or a right one, by its name; a left symbol and the right one after it become
one symbol, if both are at most as long as the round allows. So whether two words are parted by a boundary after all rounds depends on RADIUS
words to each side alone, and boundaries are never far apart: every window of repeated words holds one with all that it
depends on. Equal symbols side by side are on the same side and stay apart, so runs (periodic text) keep their boundaries. A boundary with
the words that it depends on is a letter. Names are hashes of what they stand for: all tasks give the same ones without asking.

Spark's rounds: (1) letters meet by name, and those of one document only are dropped. What is left is recompressed further, runs and pairs of
letters into symbols of some dozens of words. (2) Symbols, with the letters that follow as far as a window reaches, meet by name; all
windows that start in one which an earlier document has are repeats. (3) Windows that are left, near the ends of repeats and where
documents first differ, meet by their own words' names, and settle the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

WINDOW = 50
#: Longest symbols that the further rounds, on letters, may take.
FURTHER = (16, 32)
#: Bytes of text in a group of documents, and for each bucket of names, on average.
GROUP_BYTES, BUCKET_BYTES = 8_000_000, 16_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def rounds_for(window: int) -> tuple[int, ...]:
    """Longest symbols of each round: doubled as long as a window is sure to hold a boundary with all that it depends on.

    A boundary depends on as many words to each side as these numbers add up to, and symbols are at most twice the last one.
    """
    out: tuple[int, ...] = ()
    longest = 1
    while window - 2 * (sum(out) + longest) + 1 >= 2 * longest:
        out += (longest,)
        longest *= 2
    if not out:
        raise ValueError("a window has 3 words at least")
    return out


# --- names --------------------------------------------------------------------------------------


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return out


class Rolling:
    """Hashes of all stretches of a sequence of names, modulo 2**64."""

    def __init__(self, names: np.ndarray, base: int):
        powers = lambda b: np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(len(names), b, dtype=np.uint64))))
        self.upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(names * powers(base)[:-1])))
        self.back = powers(pow(base, -1, 1 << 64))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.upto[end] - self.upto[begin]) * self.back[begin]


def word_names(words: list[bytes]) -> np.ndarray:
    """Two 64-bit names of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2).astype(np.uint64)


def _paired(names: np.ndarray, lengths: np.ndarray, joined: np.ndarray, longest: int, turn: int) -> np.ndarray:
    """Where a symbol and the next one become one. joined: the next symbol is of the same stretch."""
    left = _mix(names ^ np.uint64(turn)) >> np.uint64(63) == 1
    short = lengths <= longest
    out = np.zeros(len(names), dtype=bool)
    out[:-1] = joined[:-1] & short[:-1] & short[1:] & left[:-1] & ~left[1:]
    return out


def boundaries(names: np.ndarray, first: np.ndarray, longest: tuple[int, ...]) -> np.ndarray:
    """Places of the words that start a symbol after the rounds. first: flags of the words that start a text."""
    start = np.arange(len(names))
    for turn, most in enumerate(longest):
        lengths = np.diff(start, append=len(first))
        joined = np.append(~first[start[1:]], False) if len(start) else np.zeros(0, dtype=bool)
        pair = np.flatnonzero(_paired(names, lengths, joined, most, turn))
        names = names.copy()
        names[pair] = _mix(names[pair], names[pair + 1])
        gone = np.zeros(len(names), dtype=bool)
        gone[pair + 1] = True
        names, start = names[~gone], start[~gone]
    return start


def symbols(names: np.ndarray, lengths: np.ndarray, joined: np.ndarray, longest: tuple[int, ...] = FURTHER) -> np.ndarray:
    """Places of the letters that start a symbol after the further rounds: in each, runs of equal symbols become one, then pairs do."""
    start = np.arange(len(names))
    for turn, most in enumerate(longest):
        same = np.zeros(len(names), dtype=bool)
        same[1:] = joined[:-1] & (names[1:] == names[:-1]) & (lengths[1:] == lengths[:-1])
        begin = np.flatnonzero(~same)
        count = np.diff(begin, append=len(names))
        names = np.where(count > 1, _mix(names[begin], count.astype(np.uint64)), names[begin]) if len(begin) else names
        lengths = np.add.reduceat(lengths, begin) if len(begin) else lengths
        joined, start = joined[begin + count - 1], start[begin]
        pair = np.flatnonzero(_paired(names, lengths, joined, most, turn + 64))
        names, lengths, joined = names.copy(), lengths.copy(), joined.copy()
        names[pair] = _mix(names[pair], names[pair + 1])
        lengths[pair] += lengths[pair + 1]
        joined[pair] = joined[pair + 1]
        gone = np.zeros(len(names), dtype=bool)
        gone[pair + 1] = True
        names, lengths, joined, start = names[~gone], lengths[~gone], joined[~gone], start[~gone]
    return start


# --- numbers of several documents in a column of bytes -------------------------------------------


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary cell for each count: so many of the values (rows, if they have two axes)."""
    values = np.ascontiguousarray(values)
    size = values.itemsize * int(np.prod(values.shape[1:]))
    offsets = np.concatenate(([0], np.cumsum(counts))) * size
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column, kind: str, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many each cell has); null cells are empty."""
    cells = [b"" if c is None else c for c in column.to_pylist()]
    size = np.dtype(kind).itemsize * width
    values = np.frombuffer(b"".join(cells), dtype=kind)
    return values.reshape(-1, width) if width > 1 else values, np.array([len(c) // size for c in cells], dtype=np.int64)


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    n = np.maximum(end - begin, 0)
    return np.repeat(begin - _begins(n), n) + np.arange(int(n.sum()))


def _runs(values: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) of the runs of equal values; fresh: a run must start here."""
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])) | fresh) if len(values) else np.zeros(0, dtype=np.int64)
    return edge, np.append(edge[1:], len(values))


# --- a round of Spark ---------------------------------------------------------------------------


def _once(part: pa.Table) -> pa.Table:
    """One of the rows with the same id and text."""
    key = np.stack((part.column("doc_id").to_numpy(), part.column("key").to_numpy()), axis=1)
    place = np.unique(key, axis=0, return_index=True)[1]
    return part if len(place) == part.num_rows else part.take(pa.array(place))


def _distinct(names: np.ndarray, docs: np.ndarray):
    """(distinct names in order, first and last document of each, number of each name)."""
    order = np.lexsort((docs, *names.T))
    ordered = names[order]
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1))) if len(order) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[begin], docs[order[begin]], docs[order[np.append(begin[1:], len(order)) - 1]] if len(begin) else docs[:0], number


def _names_of(part: pa.Table, width: int):
    names, counts = _unpacked(part.column("names"), "<u8", width)
    return _distinct(names.reshape(-1, width), np.repeat(part.column("doc_id").to_numpy(), counts))


_DEALT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("payload", pa.binary())])
_ANSWER = pa.schema([("grp", pa.int32()), ("payload", pa.binary())])


def _deal(width: int, buckets: int):
    """A group's distinct names, with the first and last document of each, by bucket."""

    def run(part: pa.Table) -> pa.Table:
        grp = part.column("grp")[0].as_py()
        names, first, last, _ = _names_of(_once(part), width)
        bucket = (names[:, -1] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(edges))
        payload = []
        for b in some:
            at = order[edges[b] : edges[b + 1]]
            payload.append(at.astype("<i4").tobytes() + names[at].astype("<u8").tobytes() + first[at].astype("<i8").tobytes() + (last[at] - first[at]).astype("<i8").tobytes())
        return pa.table([pa.array(some, pa.int32()), pa.array([grp] * len(some), pa.int32()), pa.array(payload, pa.binary())], schema=_DEALT)

    return run


def _answer(width: int):
    """A bucket's names: each group hears of those of its names that several documents have, with the first and last of all."""

    def run(part: pa.Table) -> pa.Table:
        places, names, firsts, lasts, groups = [], [], [], [], []
        for grp, payload in zip(part.column("grp").to_pylist(), part.column("payload").to_pylist()):
            n = len(payload) // (20 + 8 * width)
            places.append(np.frombuffer(payload, "<i4", n))
            names.append(np.frombuffer(payload, "<u8", n * width, 4 * n).reshape(n, width))
            firsts.append(np.frombuffer(payload, "<i8", n, (4 + 8 * width) * n))
            lasts.append(firsts[-1] + np.frombuffer(payload, "<i8", n, (12 + 8 * width) * n))
            groups.append(np.full(n, grp, dtype=np.int32))
        place, names, first, last, group = (np.concatenate(x) for x in (places, names, firsts, lasts, groups))
        _, least, _, number = _distinct(names, first)
        most = np.full(len(least), np.iinfo(np.int64).min)
        np.maximum.at(most, number, last)
        shared = np.flatnonzero((least != most)[number])
        shared = shared[np.argsort(group[shared], kind="stable")]
        edge, behind = _runs(group[shared], np.zeros(len(shared), dtype=bool))
        payload = [place[own].astype("<i4").tobytes() + least[number[own]].astype("<i8").tobytes() + (most - least)[number[own]].astype("<i8").tobytes() for own in (shared[a:b] for a, b in zip(edge, behind))]
        return pa.table([pa.array(group[shared][edge], pa.int32()), pa.array(payload, pa.binary())], schema=_ANSWER)

    return run


def _hear(width: int, then):
    """Flags of all names of a group's documents: an earlier document has it, a later one has it; then(rows, earlier, later) goes on."""

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        part = _once(part)
        _, least, most, number = _names_of(part, width)
        docs = np.repeat(part.column("doc_id").to_numpy(), _unpacked(part.column("names"), "<u8", width)[1])
        least, most = least.copy(), most.copy()
        for payload in answers.column("payload").to_pylist():
            n = len(payload) // 20
            place, first = np.frombuffer(payload, "<i4", n), np.frombuffer(payload, "<i8", n, 4 * n)
            least[place], most[place] = first, first + np.frombuffer(payload, "<i8", n, 12 * n)
        return then(part, least[number] < docs, most[number] > docs)

    return run


def ask(state: DataFrame, width: int, buckets: int, then, schema: str) -> DataFrame:
    """One round: every name in state (grp, doc_id, key, names, ...) is told whether earlier and later documents have it.

    A group sends each of its names once, however often its documents hold it, and hears of the shared ones alone.
    """
    state = state.repartition("grp")
    dealt = state.groupBy("grp").applyInArrow(_deal(width, buckets), "bucket int, grp int, payload binary")
    answers = dealt.groupBy("bucket").applyInArrow(_answer(width), "grp int, payload binary")
    return state.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_hear(width, then), schema)


# --- what happens between the rounds --------------------------------------------------------------


def _texts(batch) -> tuple[list[bytes], np.ndarray]:
    """(all words of a batch's texts, how many each has)."""
    each = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
    words: list[bytes] = []
    counts = []
    for t in each:
        own = t.split()
        counts.append(len(own))
        words += own
    return words, np.array(counts, dtype=np.int64)


_KEYS = [("grp", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64())]
_KEYS_SQL = "grp int, doc_id long, key long"
_LETTERS = pa.schema([*_KEYS, ("n_words", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()), ("names", pa.binary())])
_LETTERS_SQL = f"{_KEYS_SQL}, n_words long, first long, gaps binary, names binary"


def _letters(longest: tuple[int, ...]):
    """Texts -> letters: the place of the first one, the gaps to the next ones, and their names."""
    radius = sum(longest)

    def run(batches):
        for batch in slices(batches, max_chars=4_000_000):
            words, counts = _texts(batch)
            names = word_names(words)[:, 0]
            begin = _begins(counts)
            first = np.zeros(len(words), dtype=bool)
            first[begin[counts > 0]] = True
            at = boundaries(names, first, longest)
            row = np.searchsorted(begin, at, side="right") - 1 if len(at) else at
            # Texts without words begin where the next one does; the last row that begins there has the words.
            inside = (at - begin[row] >= radius) & (begin[row] + counts[row] - at >= radius)
            at, row = at[inside], row[inside]
            letters = _mix(Rolling(names, _BASES[0]).of(at - radius, at + radius))
            n = np.bincount(row, minlength=batch.num_rows)
            gaps = np.diff(at, prepend=0)
            edge = _begins(n)[n > 0]
            place = np.zeros(batch.num_rows, dtype=np.int64)
            place[n > 0] = at[edge] - begin[n > 0]
            gaps[edge] = 0
            keys = [batch.column(c) for c in ("grp", "doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(counts), pa.array(place), _packed(gaps.astype(np.uint8), n), _packed(letters, n)], schema=_LETTERS)

    return run


_SYMBOLS_SQL = f"{_KEYS_SQL}, n_words long, covered binary, windows binary, names binary"
_SYMBOLS = pa.schema([*_KEYS, ("n_words", pa.int64()), ("covered", pa.binary()), ("windows", pa.binary()), ("names", pa.binary())])


def _to_symbols(window: int, longest: tuple[int, ...]):
    """Letters that several documents have -> symbols with what follows them, and the windows that may be repeats or repeated.

    A window asks if all its letters have an earlier document, and gives if all have a later one. covered: the starts of the windows that lie
    in a symbol and the letters after it.
    """
    radius = sum(longest)

    def run(part: pa.Table, earlier: np.ndarray, later: np.ndarray) -> pa.Table:
        n_words = part.column("n_words").to_numpy()
        gaps, counts = _unpacked(part.column("gaps"), "u1")
        names, _ = _unpacked(part.column("names"), "<u8")
        base = _begins(n_words + window)  # documents side by side, a window apart
        row = np.repeat(np.arange(len(counts)), counts)
        first = part.column("first").to_numpy()
        walked = np.cumsum(gaps.astype(np.int64))
        at = base[row] + first[row] + walked - (walked - gaps)[np.repeat(_begins(counts), counts)] if len(row) else row
        shared = earlier | later
        some = np.bincount(row[shared], minlength=len(counts)) > 0

        # Windows: how many of the letters in each are known to earlier and to later documents.
        starts = _ranges(base[some], base[some] + n_words[some] - window + 1)
        lo, hi = np.searchsorted(at, starts + radius), np.searchsorted(at, starts + window - radius, side="right")
        known = [np.concatenate(([0], np.cumsum(flags))) for flags in (earlier, later)]
        asks, gives = ((k[hi] - k[lo] == hi - lo) & (hi > lo) for k in known)
        kind = asks.astype(np.int32) + 2 * gives
        edge, behind = _runs(kind, np.diff(starts, prepend=-2) != 1)
        worth = kind[edge] > 0
        edge, behind = edge[worth], behind[worth]
        owner = np.searchsorted(base, starts[edge], side="right") - 1
        windows = np.stack((starts[edge] - base[owner], starts[behind - 1] + 1 - base[owner], kind[edge]), axis=1).astype("<i4")

        # Symbols: letters side by side in a text without a dropped one between them.
        alive = np.flatnonzero(shared)
        place, own, name = at[alive], row[alive], names[alive]
        joined = np.append((np.diff(alive) == 1) & (own[1:] == own[:-1]), False)
        gap = np.where(joined, np.diff(place, append=0), 1)
        spelled = _mix(name, gap.astype(np.uint64))
        begin = symbols(spelled, gap, joined)
        last = np.flatnonzero(~joined)  # of each stretch of letters
        end_of = last[np.searchsorted(last, begin)] if len(begin) else begin
        behind = np.append(begin[1:], len(alive))
        more = behind <= end_of  # another symbol of the stretch follows
        upto = np.where(more, place[np.minimum(behind, len(alive) - 1)] - radius, np.iinfo(np.int64).max) if len(begin) else begin
        reach = np.minimum(np.searchsorted(place, upto - 1 + window - radius), end_of) if len(begin) else begin
        upto = np.minimum(upto, place[reach] + radius - window + 1)
        known = [np.concatenate(([0], np.cumsum(flags[alive]))) for flags in (earlier, later)]
        whole = np.zeros(len(begin), dtype=bool)
        for k in known:
            whole |= k[reach + 1] - k[begin] == reach + 1 - begin
        keep = whole & (upto > place[begin] - radius)
        begin, reach, upto = begin[keep], reach[keep], upto[keep]
        lanes = [_mix(Rolling(_mix(spelled ^ np.uint64(b)), b).of(begin, reach), name[reach] ^ np.uint64(b)) for b in _BASES]
        covered = np.stack((place[begin] - radius - base[own[begin]], upto - base[own[begin]]), axis=1).astype("<i4")
        n_symbols, n_windows = np.bincount(own[begin], minlength=len(counts)), np.bincount(owner, minlength=len(counts))
        out = pa.table([*[part.column(c) for c, _ in _KEYS], part.column("n_words"), _packed(covered, n_symbols), _packed(windows, n_windows), _packed(np.stack(lanes, axis=1), n_symbols)], schema=_SYMBOLS)
        return out.filter(pa.array((n_symbols > 0) | (n_windows > 0)))

    return run


_MARKS_SQL = f"{_KEYS_SQL}, settled binary, windows binary"
_MARKS = pa.schema([*_KEYS, ("settled", pa.binary()), ("windows", pa.binary())])


def _to_marks(window: int):
    """Symbols -> settled: ranges of starts of repeated windows; windows: ranges that are left, with their kind."""

    def run(part: pa.Table, earlier: np.ndarray, later: np.ndarray) -> pa.Table:
        n_starts = np.maximum(part.column("n_words").to_numpy() - window + 1, 0)
        base = _begins(n_starts)
        covered, n_covered = _unpacked(part.column("covered"), "<i4", 2)
        windows, n_windows = _unpacked(part.column("windows"), "<i4", 3)
        total = int(n_starts.sum())
        change = np.zeros(total + 1, dtype=np.int64)
        begin = covered[earlier] + base[np.repeat(np.arange(len(base)), n_covered)[earlier], None]
        np.add.at(change, begin[:, 0], 1)
        np.add.at(change, begin[:, 1], -1)
        settled = np.cumsum(change)[:total] > 0
        kind = np.zeros(total, dtype=np.int32)
        offset = base[np.repeat(np.arange(len(base)), n_windows)]
        kind[_ranges(windows[:, 0] + offset, windows[:, 1] + offset)] = np.repeat(windows[:, 2], windows[:, 1] - windows[:, 0])
        kind[settled] = 4
        fresh = np.zeros(total, dtype=bool)
        fresh[base[n_starts > 0]] = True
        edge, behind = _runs(kind, fresh)
        owner = np.repeat(np.arange(len(base)), n_starts)[edge] if total else edge
        spans = np.stack((edge - base[owner], behind - base[owner], kind[edge]), axis=1).astype("<i4") if total else np.zeros((0, 3), dtype="<i4")
        is_settled, is_open = spans[:, 2] == 4, (spans[:, 2] > 0) & (spans[:, 2] < 4)
        n = [np.bincount(owner[flags], minlength=len(base)) for flags in (is_settled, is_open)]
        out = pa.table([*[part.column(c) for c, _ in _KEYS], _packed(spans[is_settled, :2], n[0]), _packed(spans[is_open], n[1])], schema=_MARKS)
        return out.filter(pa.array((n[0] > 0) | (n[1] > 0)))

    return run


_OPEN_SQL = f"{_KEYS_SQL}, windows binary, names binary"
_OPEN = pa.schema([*_KEYS, ("windows", pa.binary()), ("names", pa.binary())])


def _open_windows(window: int):
    """Texts with the windows that are left -> the names of those, from two names of each word."""

    def run(batches):
        for batch in slices(batches, max_chars=2_000_000):
            words, counts = _texts(batch)
            names = word_names(words)
            windows, n = _unpacked(batch.column("windows"), "<i4", 3)
            base = np.repeat(_begins(counts), n)
            starts = _ranges(windows[:, 0] + base, windows[:, 1] + base)
            lanes = np.stack([_mix(Rolling(names[:, i], b).of(starts, starts + window)) for i, b in enumerate(_BASES)], axis=1)
            each = np.bincount(np.repeat(np.arange(batch.num_rows), n), weights=windows[:, 1] - windows[:, 0], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c, _ in _KEYS], batch.column("windows"), _packed(lanes, each)], schema=_OPEN)

    return run


_FOUND_SQL = f"{_KEYS_SQL}, found binary"
_FOUND = pa.schema([*_KEYS, ("found", pa.binary())])


def _to_found(part: pa.Table, earlier: np.ndarray, later: np.ndarray) -> pa.Table:
    """Windows that were left -> ranges of the starts of those which an earlier document has."""
    windows, n = _unpacked(part.column("windows"), "<i4", 3)
    starts = _ranges(windows[:, 0], windows[:, 1])
    size = (windows[:, 1] - windows[:, 0]).astype(np.int64)
    fresh = np.zeros(len(starts), dtype=bool)
    fresh[_begins(size)] = True
    edge, behind = _runs(earlier, fresh)
    edge, behind = edge[earlier[edge]], behind[earlier[edge]]
    owner = np.repeat(np.repeat(np.arange(len(n)), n), size)[edge]
    found = np.stack((starts[edge], starts[behind - 1] + 1), axis=1).astype("<i4")
    return pa.table([*[part.column(c) for c, _ in _KEYS], _packed(found, np.bincount(owner, minlength=len(n)))], schema=_FOUND)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])
_RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept string"


def _remove(window: int, with_text: bool):
    def run(batches):
        for batch in slices(batches):
            rows = []
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for text, *marks in zip(texts, batch.column("settled").to_pylist(), batch.column("found").to_pylist()):
                words = text.split()
                starts = np.concatenate([np.frombuffer(m or b"", dtype="<i4").reshape(-1, 2) for m in marks])
                spans = []
                for begin, end in starts[np.argsort(starts[:, 0])].tolist():
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end + window - 1)
                    else:
                        spans.append([begin, end + window - 1])
                kept, at = [], 0
                for begin, end in spans:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                rest = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), spans, rest.decode() if with_text else None))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_RESULT)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=_RESULT)

    return run


def word_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: what is left after its long repeats of documents with smaller ids are removed, word by word.

    docs: doc_id (long) and text; other columns are left unread. Words are maximal runs without ASCII white space; null has none. Each word
    covered by `window` consecutive words that also stand in a document with a smaller doc_id goes; windows are judged on the
    input. Shorter texts lose nothing. A document with a null id neither loses nor gives anything. Rows that share an id are documents of
    their own, none smaller than the other; repeated rows come back as often as they are there. An empty table gives no rows.
    Returns doc_id, n_words, n_removed, kept_sha256, spans (removed ranges of words, from and up to) and, with_text, kept (words that stay, with one
    space between).

    Names are 64 bits; a window is told to be a repeat by two of them (its words', or those of the letters that make it up). Letters cost about nine bytes
    each, one for some three words; texts are shuffled once, after most windows are settled.
    """
    longest = rounds_for(window)
    # No cast where there is none to do: both joins then have the same plan below, and share its exchange.
    texts = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    known = texts.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, -(-total // GROUP_BYTES)), max(1, -(-total // BUCKET_BYTES))
    grp = F.pmod(F.xxhash64("doc_id", "key"), F.lit(groups)).cast("int").alias("grp")
    letters = known.select(grp, "doc_id", "key", "text").mapInArrow(_letters(longest), _LETTERS_SQL)
    shared = materialize(ask(letters, 1, buckets, _to_symbols(window, longest), _SYMBOLS_SQL))
    marks = materialize(ask(shared, 2, buckets, _to_marks(window), _MARKS_SQL))
    left = marks.where("octet_length(windows) > 0").select("grp", "doc_id", "key", "windows")
    windows = known.join(left, ["doc_id", "key"]).select("grp", "doc_id", "key", "text", "windows").mapInArrow(_open_windows(window), _OPEN_SQL)
    found = ask(windows, 2, buckets, _to_found, _FOUND_SQL).select("doc_id", "key", "found")
    both = marks.select("doc_id", "key", "settled").join(found, ["doc_id", "key"], "left")
    nothing = F.lit(None).cast("binary")
    nameless = texts.where("doc_id is null").select("doc_id", "text", nothing.alias("settled"), nothing.alias("found"))
    marked = known.join(both, ["doc_id", "key"], "left").select("doc_id", "text", "settled", "found").unionByName(nameless)
    out = marked.mapInArrow(_remove(window, with_text), _RESULT_SQL)
    return out if with_text else out.drop("kept")


#: DuckDB SQL for op12_word_dedup: every window as a list of words (spans left out).
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM starts JOIN d USING (doc_id)
), repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p + o AS i FROM repeats, (SELECT unnest(range(50)) AS o)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
