"""Removal of long repeated byte strings by prefix-free parsing, to the depth that the question needs.

A rolling hash picks triggers that depend on the nearby bytes alone: every string of LENGTH bytes holds one, at the same
place wherever the string stands. The text around a trigger (as far as strings of LENGTH bytes that hold it
reach) is its phrase; phrases overlap, so no string is cut. Parse: phrases are dealt out and sorted by (trigger, phrase,
document): equal phrases prove all their strings equal at once, which settles the long repeats. Dictionary: where one trigger has
different phrases, at the ends of repeats, the suffixes of the distinct ones are sorted by their bytes, and with the parse's
documents that gives the first document of every string. Both orders go as deep as LENGTH bytes; the order of whole
suffixes of the corpus, which would take rounds of shuffles, isn't worked out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialize, slices

LENGTH = 50
TRIGGER = 20
#: Strings of LENGTH bytes that hold a trigger start at most so far before it.
REACH = LENGTH - TRIGGER
#: Bytes of text whose phrases one bucket takes, on average.
BUCKET_BYTES = 16_000_000
#: A trigger with about so many different phrases or more is hot: its strings are dealt out one by one. Which ones are is
#: estimated on one document in SAMPLE_SHARE; it only settles where the work is done, never what comes out. At most HOT_KEYS are told.
HOT_PHRASES = 20_000
SAMPLE_SHARE = 64
HOT_KEYS = 1 << 18
_GAP = 256  # stands between documents, so no string crosses them
_AT_ONCE = 1 << 18
_LEFT, _RIGHT = 64, 192
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_CODES = np.random.default_rng(20_240_229).integers(0, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return out


def _joined(left: np.ndarray, right: np.ndarray, shift: int, size: int) -> np.ndarray:
    """Hashes of strings: left part at i, right part (of size bytes) at i + shift."""
    n = len(right) - shift
    return left[:n] * _power(size) + right[shift:]


class Text:
    """Documents side by side with gaps of LENGTH between them, and where each starts."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes + LENGTH) - sizes  # a gap stands before each
        self.codes = np.full(int(sizes.sum()) + LENGTH * (len(texts) + 1), _GAP, dtype=np.uint16)
        for s, t in zip(self.starts, texts):
            self.codes[s : s + len(t)] = np.frombuffer(t, dtype=np.uint8)

    def parts(self):
        """(first, count, hashes) for the positions first ... first + count - 1, a bounded number at a time.

        hashes: H2, H16, H32 and the trigger's order at each position of the part, _LEFT positions before it and
        enough after it; and the positions where a whole string of LENGTH bytes starts.
        """
        n = len(self.codes)
        padded = np.concatenate((np.full(_LEFT, _GAP, dtype=np.uint16), self.codes, np.full(_RIGHT, _GAP, dtype=np.uint16)))
        for first in range(0, n, _AT_ONCE):
            count = min(_AT_ONCE, n - first)
            codes = padded[first : first + _LEFT + count + _RIGHT]
            h1 = _CODES[codes]
            h2 = _joined(h1, h1, 1, 1)
            h4 = _joined(h2, h2, 2, 2)
            h8 = _joined(h4, h4, 4, 4)
            h16 = _joined(h8, h8, 8, 8)
            h32 = _joined(h16, h16, 16, 16)
            trigger = _joined(h16, h4, 16, 4) * _MIX[0]
            where = np.arange(len(codes), dtype=np.int32)
            gap = np.where(codes == _GAP, where, np.int32(len(codes)))
            whole = np.minimum.accumulate(gap[::-1])[::-1] - where >= LENGTH
            yield first, count, h2, h16, h32, trigger, whole


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of a[i] ... a[i + width - 1]."""
    return _slide(a, width, np.minimum)


def _slide(a: np.ndarray, width: int, of) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        a = of(a[:-have], a[have:])
        have *= 2
    return of(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def _served(trigger: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each start of a string, the least trigger order in it; 0 where no whole string starts."""
    least = _least(trigger, REACH + 1)
    return np.where(whole[: len(least)], least, np.uint64(0))


def triggers(text: Text):
    """(position, trigger hash, phrase hash) of all triggers, by position.

    A position is a trigger if its hash is the least in some whole string of LENGTH bytes, ties included. The
    phrase is the REACH bytes before it and the LENGTH bytes from it on, gaps included.
    """
    for first, count, _h2, h16, h32, trigger, whole in text.parts():
        served = _served(trigger, whole)
        most = _slide(served, REACH + 1, np.maximum)  # over the starts i ... i + REACH
        here = np.arange(_LEFT, _LEFT + count)
        q = here[most[here - REACH] == trigger[here]]
        phrase = _mix(h32[q - REACH], h32[q - REACH + 32], h16[q - REACH + 64])
        yield q - _LEFT + first, trigger[q], phrase


AROUND = REACH + LENGTH  # bytes of a phrase


def phrases_at(text: Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigger hash, phrase) of triggers at positions of the text; a phrase is a row of AROUND bytes, 0 in gaps."""
    padded = np.concatenate((np.full(REACH, _GAP, dtype=np.uint16), text.codes, np.full(LENGTH, _GAP, dtype=np.uint16)))
    codes = padded[at[:, None] + np.arange(AROUND)]
    key = np.zeros(len(at), dtype=np.uint64)
    for j in range(TRIGGER):
        key = key * np.uint64(_BASE) + _CODES[codes[:, REACH + j]]
    return key * _MIX[0], np.where(codes == _GAP, 0, codes).astype(np.uint8)


def string_hashes(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string of LENGTH bytes in each phrase: rows of REACH + 1."""
    h1 = _CODES[phrases]

    def doubled(h: np.ndarray, n: int) -> np.ndarray:
        return h[:, :-n] * _power(n) + h[:, n:]

    h2 = doubled(h1, 1)
    h16 = doubled(doubled(doubled(h2, 2), 4), 8)
    h32 = doubled(h16, 16)
    n = REACH + 1
    a, b, c = (np.ascontiguousarray(h[:, i : i + n]).ravel() for h, i in ((h32, 0), (h16, 32), (h2, 48)))
    return _mix(a, b, c).reshape(-1, n), _mix(c, a ^ _MIX[1], b).reshape(-1, n)


# --- dealing out and matching -------------------------------------------------------------------

#: What a dealt row holds: records of triggers (later open ones with their phrases), finished marks, or single strings.
RECORDS, FINISHED, STRINGS = 0, 1, 2
#: Marks of a trigger: four times its position and what is known of it.
REPEAT, OPEN, HOT_OPEN = 0, 1, 2
_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])
_DEALT_SQL = "bucket int, kind tinyint, payload binary"
_MARKS = pa.schema([("doc_id", pa.int64()), ("marks", pa.list_(pa.int64()))])
_MARKS_SQL = "doc_id long, marks array<long>"


def _six(a: np.ndarray) -> bytes:
    """The lower six bytes of hashes."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _rows(key, second, doc, pos) -> bytes:
    """Records as bytes: columns one after another."""
    return _six(key) + _six(second) + np.diff(doc, prepend=0).astype("<i8").tobytes() + pos.astype("<i8").tobytes()


def _read(payloads: list[bytes]):
    columns = []
    for p in payloads:
        n = len(p) // 28
        columns.append((_eight(p[: 6 * n]), _eight(p[6 * n : 12 * n]), np.cumsum(np.frombuffer(p[12 * n : 20 * n], dtype="<i8")), np.frombuffer(p[20 * n :], dtype="<i8")))
    return tuple(np.concatenate(c) for c in zip(*columns))


def _settle(key: np.ndarray, second: np.ndarray, doc: np.ndarray):
    """(in order, repeats, open) for records: places sorted by (key, second, doc) of those whose key occurs more than once.

    repeats: a document with a smaller id has the same key and second. open: the first document of its second,
    while the key has another second in another document.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    twin = np.zeros(len(k), dtype=bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:].copy()
    order = order[twin]
    order = order[np.lexsort((doc[order], second[order], key[order]))]
    k, s, d = key[order], second[order], doc[order]
    if not len(order):
        return order, np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_key | np.concatenate(([True], s[1:] != s[:-1]))
    group = np.cumsum(new) - 1
    first_doc = d[new]  # sorted by doc: the smallest of each (key, second)
    repeats = d > first_doc[group]
    begin = np.flatnonzero(new_key[new])  # first group of each key
    low, high = np.minimum.reduceat(first_doc, begin), np.maximum.reduceat(first_doc, begin)
    mixed = (low != high)[np.cumsum(new_key[new]) - 1]
    return order, repeats, ~repeats & mixed[group]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(20)) % np.uint64(buckets)


def _by_bucket(kind: int, key: np.ndarray, buckets: int, payload) -> list[tuple]:
    """A row for each bucket that some keys go to; payload(places) makes its bytes."""
    bucket = _bucket(key, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    return [(int(b), kind, payload(order[edges[int(b)] : edges[int(b) + 1]])) for b in np.unique(bucket)]


def _finished(doc: np.ndarray, marks: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of marks that are known already; any bucket may carry them."""
    if not len(doc):
        return []
    order = np.argsort(doc, kind="stable")
    cut = np.array_split(order, max(1, min(buckets, len(order) // 4096)))
    return [(int(doc[c[0]] % buckets), FINISHED, doc[c].astype("<i8").tobytes() + marks[c].astype("<i8").tobytes()) for c in cut]


def _deal(key, second, doc, pos, buckets: int, hot_keys: np.ndarray):
    """Records of one slice by bucket. What the slice itself settles goes along as finished marks, and so do the open ones of hot
    triggers, which needn't meet."""
    order, repeats, _ = _settle(key, second, doc)
    settled = order[repeats]
    keep = np.ones(len(key), dtype=bool)
    keep[settled] = False
    out = _finished(doc[settled], pos[settled] * 4 + REPEAT, buckets)
    key, second, doc, pos = key[keep], second[keep], doc[keep], pos[keep]
    hot = np.isin(key, hot_keys)
    out += _finished(doc[hot], pos[hot] * 4 + HOT_OPEN, buckets)
    key, second, doc, pos = key[~hot], second[~hot], doc[~hot], pos[~hot]
    out += _by_bucket(RECORDS, key, buckets, lambda at: _rows(key[at], second[at], doc[at], pos[at]))
    return batch_of(_DEALT, *map(list, zip(*out))) if out else None


_SPREAD = pa.schema([("grp", pa.int32()), ("payload", pa.binary())])
_SPREAD_SQL = "grp int, payload binary"


def _spread(doc: np.ndarray, marks: np.ndarray, groups: int) -> pa.Table:
    """Marks for groups of documents: a row for each group that has some, not for each document."""
    grp = doc % groups
    order = np.lexsort((marks, doc, grp))
    grp, doc, marks = grp[order], doc[order], marks[order]
    edges = np.searchsorted(grp, np.arange(groups + 1))
    some = np.flatnonzero(np.diff(edges))
    payloads = [np.diff(doc[edges[g] : edges[g + 1]], prepend=0).astype("<i8").tobytes() + marks[edges[g] : edges[g + 1]].astype("<i8").tobytes() for g in some]
    return pa.table({"grp": pa.array(some, pa.int32()), "payload": pa.array(payloads, pa.binary())}, schema=_SPREAD)


def _by_document(part: pa.Table) -> pa.Table:
    """A group's marks -> one row for each of its documents."""
    halves = [np.frombuffer(p, dtype="<i8").reshape(2, -1) for p in part.column("payload").to_pylist()]
    doc, marks = np.concatenate([np.cumsum(h[0]) for h in halves]), np.concatenate([h[1] for h in halves])
    order = np.lexsort((marks, doc))
    doc, marks = doc[order], marks[order]
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    offsets = pa.array(np.append(edge, len(doc)).astype(np.int32))
    return pa.table({"doc_id": pa.array(doc[edge]), "marks": pa.ListArray.from_arrays(offsets, pa.array(marks))}, schema=_MARKS)


def _payloads(part: pa.Table, kind: int) -> list[bytes]:
    return part.filter(pc.equal(part.column("kind"), kind)).column("payload").to_pylist()


def _marks_in(part: pa.Table) -> tuple[list, list]:
    both = [np.frombuffer(p, dtype="<i8").reshape(2, -1) for p in _payloads(part, FINISHED)]
    return [b[0] for b in both], [b[1] for b in both]


def _match_phrases(part: pa.Table, groups: int) -> pa.Table:
    """A bucket's records -> marks by document."""
    docs, marks = _marks_in(part)
    if rest := _payloads(part, RECORDS):
        key, second, doc, pos = _read(rest)
        order, repeats, is_open = _settle(key, second, doc)
        for flags, bit in ((repeats, REPEAT), (is_open, OPEN)):
            docs.append(doc[order[flags]])
            marks.append(pos[order[flags]] * 4 + bit)
    return _spread(np.concatenate(docs), np.concatenate(marks), groups)


_OPEN_BYTES = 6 + AROUND + 2 + 16


def _open_rows(key, phrases, left, right, doc, pos) -> bytes:
    """Open triggers as bytes: hash, phrase, how much of it is there before and after, document, position."""
    return _six(key) + phrases.tobytes() + left.astype(np.uint8).tobytes() + right.astype(np.uint8).tobytes() + np.diff(doc, prepend=0).astype("<i8").tobytes() + pos.astype("<i8").tobytes()


def _strings(phrases: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(trigger, start, hash, second hash) of the whole strings of LENGTH bytes in phrases."""
    first, second = string_hashes(phrases)
    start = np.arange(REACH + 1)
    there = (start >= REACH - left[:, None].astype(np.int64)) & (start + LENGTH <= REACH + right[:, None].astype(np.int64))
    row, at = np.nonzero(there)
    return row, at, first[row, at], second[row, at]


def _equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of the rows' bytes, number of each place's group of equal rows, in that order)."""
    keys = np.ascontiguousarray(rows).view(np.dtype((np.bytes_, rows.shape[1]))).ravel()
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))


def first_documents(phrases: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each occurrence of a phrase and each start in it, the first document with the string of LENGTH bytes there.

    The distinct phrases are the dictionary; which one stands at each place is the parse. The dictionary's suffixes are sorted by
    their bytes, as deep as a string is long, so equal strings are neighbours; a suffix brings along the first document that the parse has
    its phrase in, and the least of a run of neighbours is the string's. Starts where no whole string is there get the largest
    number.
    """
    most = np.iinfo(np.int64).max
    full = np.concatenate((phrases, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)), axis=1)
    order, number = _equal_rows(full)
    parse = np.empty(len(doc), dtype=np.int64)
    parse[order] = number
    entry = order[np.concatenate(([True], number[1:] != number[:-1]))]  # a place of each phrase of the dictionary
    earliest = np.full(len(entry), most)
    np.minimum.at(earliest, parse, doc)
    start = np.arange(REACH + 1)
    there = (start >= REACH - left[entry, None].astype(np.int64)) & (start + LENGTH <= REACH + right[entry, None].astype(np.int64))
    phrase, at = np.nonzero(there)
    first = np.full((len(entry), REACH + 1), most)
    if len(phrase):
        suffixes = np.lib.stride_tricks.sliding_window_view(phrases[entry], LENGTH, axis=1)[phrase, at]
        order, number = _equal_rows(suffixes)
        least = np.minimum.reduceat(earliest[phrase[order]], np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))))
        first[phrase[order], at[order]] = least[number]
    return first[parse]


def _match_strings(part: pa.Table, groups: int) -> pa.Table:
    """A bucket's open triggers and single strings -> runs of strings that stand in earlier documents: 64 * start + how many, by document."""
    docs, marks = _marks_in(part)
    docs, marks = [np.zeros(0, dtype=np.int64), *docs], [np.zeros(0, dtype=np.int64), *marks]
    if single := _payloads(part, STRINGS):
        first, second, doc, at = _read(single)
        order, repeats, _ = _settle(first, second, doc)
        docs.append(doc[order[repeats]])
        marks.append(at[order[repeats]] * 64 + 1)
    columns = []
    for p in _payloads(part, RECORDS):
        n = len(p) // _OPEN_BYTES
        edges = np.cumsum([0, 6 * n, AROUND * n, n, n, 8 * n, 8 * n])
        key, phrases, left, right, doc, pos = (p[i:j] for i, j in zip(edges, edges[1:]))
        columns.append((_eight(key), np.frombuffer(phrases, dtype=np.uint8).reshape(n, AROUND), np.frombuffer(left, dtype=np.uint8), np.frombuffer(right, dtype=np.uint8), np.cumsum(np.frombuffer(doc, dtype="<i8")), np.frombuffer(pos, dtype="<i8")))
    key, phrases, left, right, doc, pos = (np.concatenate(c) for c in zip(*columns)) if columns else (np.zeros(0, dtype=np.uint64),) * 6
    portions = 1 + len(key) // 20_000
    for k in range(portions if len(key) else 0):  # all triggers of a hash are in one portion
        own = np.flatnonzero(key % np.uint64(portions) == k)
        if not len(own):
            continue
        hit = np.zeros((len(own), REACH + 3), dtype=np.int8)
        hit[:, 1:-1] = first_documents(phrases[own], left[own], right[own], doc[own]) < doc[own][:, None]
        change = np.diff(hit, axis=1)
        r, begin = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        docs.append(doc[own][r])
        marks.append((pos[own][r] - REACH + begin) * 64 + (end - begin))
    return _spread(np.concatenate(docs), np.concatenate(marks), groups)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _ahead(batch) -> np.ndarray:
    """Where each row begins in its document (see _placed)."""
    return batch.column("ahead").to_numpy() if "ahead" in batch.schema.names else np.zeros(batch.num_rows, dtype=np.int64)


def _found(batches):
    """(doc ids, positions, trigger hashes, phrase hashes) of slices of the input that hold a trigger. ahead: see _placed."""
    for batch in slices(batches, max_chars=16_000_000):
        ids = batch.column("doc_id").to_numpy()
        text = Text(_bytes(batch.column("text")))
        at, key, second = [np.concatenate(x) for x in zip(*triggers(text))]
        if len(at):
            row = np.searchsorted(text.starts, at, side="right") - 1
            yield ids[row], at - text.starts[row] + _ahead(batch)[row], key, second


def _deal_phrases(buckets: int, hot_keys):
    def run(batches):
        for doc, pos, key, second in _found(batches):
            if (out := _deal(key, second, doc, pos, buckets, hot_keys.value)) is not None:
                yield out

    return run


_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _count_phrases(batches):
    for _, _, key, second in _found(batches):
        pairs = np.unique(np.stack((key, second), axis=1), axis=0)
        own, n = np.unique(pairs[:, 0], return_counts=True)
        yield batch_of(_COUNTS, own.view(np.int64), n)


def hot_triggers(known: DataFrame) -> np.ndarray:
    """Hashes of the triggers with the most phrases, HOT_KEYS at most, where a share of the documents makes HOT_PHRASES likely."""
    some = known.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(SAMPLE_SHARE)) == 0)
    counts = some.mapInArrow(_count_phrases, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") * SAMPLE_SHARE >= HOT_PHRASES).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def _spans(marks, n: int) -> np.ndarray:
    """Flags of the starts of strings that repeated triggers settle, in a document of n bytes."""
    last = n - LENGTH
    change = np.zeros(max(0, last) + 2, dtype=np.int64)
    q = marks[marks & 3 == REPEAT] >> 2
    q = q[(q >= 0) & (q < n)]
    lo, hi = np.maximum(q - REACH, 0), np.minimum(q, last)
    good = lo <= hi
    np.add.at(change, lo[good], 1)
    np.add.at(change, hi[good] + 1, -1)
    return np.cumsum(change)[: max(0, last) + 1] > 0


def _deal_strings(phrases, left, right, doc, pos, buckets: int) -> list[tuple]:
    """Rows of the strings of hot triggers, by string: of those that stand several times in the slice only the first document's.

    The others are settled here, so however many documents hold a string, a bucket gets one record of it a slice.
    """
    out, docs, starts = [], [], []
    for at in range(0, len(doc), 20_000):
        row, begin, first, second = _strings(phrases[at : at + 20_000], left[at : at + 20_000], right[at : at + 20_000])
        docs.append((doc[at : at + 20_000][row], pos[at : at + 20_000][row] - REACH + begin))
        starts.append((first, second))
    owner, start = (np.concatenate(x) for x in zip(*docs))
    first, second = (np.concatenate(x) for x in zip(*starts))
    if not len(owner):
        return out
    # A string may be in the reach of several hot triggers of its document: one record of it is enough.
    once = np.unique(np.stack((owner, start), axis=1), axis=0, return_index=True)[1]
    owner, start, first, second = owner[once], start[once], first[once], second[once]
    order, repeats, _ = _settle(first, second, owner)
    settled = order[repeats]
    keep = np.ones(len(owner), dtype=bool)
    keep[settled] = False
    out += _finished(owner[settled], start[settled] * 64 + 1, buckets)
    owner, start, first, second = owner[keep], start[keep], first[keep], second[keep]
    return out + _by_bucket(STRINGS, first, buckets, lambda i: _rows(first[i], second[i], owner[i], start[i]))


def _deal_open(buckets: int):
    def run(batches):
        for batch in slices(batches, max_chars=8_000_000):
            ids = batch.column("doc_id").to_numpy()
            texts = _bytes(batch.column("text"))
            text = Text(texts)
            at, row, is_hot = [], [], []
            ahead = _ahead(batch)
            for i, (start, t, marks) in enumerate(zip(text.starts, texts, batch.column("marks"))):
                marks = marks.values.to_numpy() - 4 * ahead[i]
                open_ones = np.unique(marks[marks & 3 != REPEAT])
                q, hot = open_ones >> 2, open_ones & 3 == HOT_OPEN
                inside = (q >= 0) & (q < len(t))  # the others are of rows with the same id
                q, hot = q[inside], hot[inside]
                # Those whose strings are all settled already have nothing to ask or to give.
                if len(q) and len(t) >= LENGTH:
                    settled = np.concatenate(([0], np.cumsum(_spans(marks, len(t)))))
                    lo, hi = np.maximum(q - REACH, 0), np.minimum(q, len(t) - LENGTH) + 1
                    wanted = (hi > lo) & (settled[np.maximum(hi, lo)] - settled[lo] < hi - lo)
                    at.append(start + q[wanted])
                    row.append(np.full(int(wanted.sum()), i))
                    is_hot.append(hot[wanted])
            if not at or not sum(map(len, at)):
                continue
            at, row, is_hot = np.concatenate(at), np.concatenate(row), np.concatenate(is_hot)
            pos, ahead = at - text.starts[row], ahead[row]
            sizes = np.array([len(t) for t in texts])[row]
            key, phrases = phrases_at(text, at)
            left, right = np.minimum(pos, REACH), np.minimum(sizes - pos, LENGTH)
            out = _deal_strings(phrases[is_hot], left[is_hot], right[is_hot], ids[row[is_hot]], (pos + ahead)[is_hot], buckets) if is_hot.any() else []
            plain = np.flatnonzero(~is_hot)
            if len(plain):
                out += _by_bucket(RECORDS, key[plain], buckets, lambda i: _open_rows(key[plain[i]], phrases[plain[i]], left[plain[i]], right[plain[i]], ids[row[plain[i]]], (pos + ahead)[plain[i]]))
            if out:
                yield batch_of(_DEALT, *map(list, zip(*out)))

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def removed_bytes(n: int, marks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Flags of the bytes that go from a document of n bytes: repeated phrases' strings, and runs of strings."""
    if n < LENGTH:
        return np.zeros(n, dtype=bool)
    change = np.zeros(n + 1, dtype=np.int64)
    begin = runs >> 6
    end = np.minimum(begin + (runs & 63), n - LENGTH + 1)
    good = (begin >= 0) & (begin < end)
    np.add.at(change, begin[good], 1)
    np.add.at(change, end[good], -1)
    first = np.flatnonzero(_spans(marks, n) | (np.cumsum(change)[: n - LENGTH + 1] > 0))
    gone = np.zeros(n + 1, dtype=np.int64)
    gone[first] += 1
    gone[first + LENGTH] -= 1
    return np.cumsum(gone)[:n] > 0


def _remove(with_text: bool):
    def run(batches):
        none = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            rows = []
            for t, ahead, marks, starts in zip(_bytes(batch.column("text")), _ahead(batch).tolist(), batch.column("marks"), batch.column("starts")):
                marks = marks.values.to_numpy() - 4 * ahead if marks.is_valid else none
                starts = starts.values.to_numpy() - 64 * ahead if starts.is_valid else none
                if len(marks) or len(starts):
                    gone = removed_bytes(len(t), marks, starts)
                    rest = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
                else:
                    rest, spans = t, 0
                rows.append((len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            yield batch_of(_RESULT, batch.column("doc_id"), *map(list, zip(*rows)))

    return run


def _placed(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) with ahead: where the row begins in its document, if rows that share an id stood side by side with gaps between.

    So positions tell them apart, and none is earlier than the other; equal rows have one place. Where no id is shared, texts stay as they are.
    """
    rows = texts.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).distinct()
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if shared.isEmpty():
        return texts
    before = Window.partitionBy("doc_id").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, -1)
    places = rows.join(shared, "doc_id", "left_semi").withColumn("ahead", F.coalesce(F.sum(F.col("n") + LENGTH).over(before), F.lit(0)))
    keyed = texts.withColumn("key", F.xxhash64("text")).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return materialize(keyed.join(places, ["doc_id", "key", "n"], "left").select("doc_id", "text", F.coalesce("ahead", F.lit(0).cast("long")).alias("ahead")))


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: what is left after its long repeats of documents with smaller ids are removed.

    docs: doc_id (long) and text; other columns are left unread. Texts count as UTF-8 bytes, null as empty. Each byte of a
    LENGTH-byte string that also stands in a document with a smaller doc_id goes; matches never cross documents, and are
    judged on the input. Texts shorter than LENGTH lose nothing. A document with a null id neither loses nor
    gives anything. Rows that share an id are documents of their own, none smaller than the other; repeated rows come back as often as they
    are there. An empty table gives no rows.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary).

    Positions and 48-bit hashes of triggers and phrases are shuffled, not texts; records that a slice of the
    input settles by itself leave before the shuffle. Texts are shuffled once, to meet their marks; of open triggers
    the phrase itself is dealt out, and its strings are told apart where all phrases of the trigger meet. A trigger of a passage that
    many documents hold has ever new phrases at the passage's ends; such hot ones don't meet as a whole: their strings are dealt
    out one by one, and of each string a slice of the input sends one record, however many documents hold it.
    """
    # Without a cast where there is none to do: both joins then have the same plan below, and share its exchange.
    texts = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long"), "text")
    known = _placed(texts.where("doc_id is not null"))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    hot_keys = docs.sparkSession.sparkContext.broadcast(hot_triggers(known))
    phrases = known.mapInArrow(_deal_phrases(buckets, hot_keys), _DEALT_SQL)

    def marks_of(dealt: DataFrame, match) -> DataFrame:
        spread = dealt.groupBy("bucket").applyInArrow(lambda part: match(part, buckets), _SPREAD_SQL)
        return spread.groupBy("grp").applyInArrow(_by_document, _MARKS_SQL)

    marks = materialize(marks_of(phrases, _match_phrases))
    pending = marks.where(F.exists("marks", lambda m: m % 4 != REPEAT))
    open_phrases = known.join(pending, "doc_id").mapInArrow(_deal_open(buckets), _DEALT_SQL)
    starts = marks_of(open_phrases, _match_strings).withColumnRenamed("marks", "starts")
    both = marks.join(starts, "doc_id", "left")
    # The same exchange of the texts serves this join and the one above.
    nothing = F.lit(None).cast("array<bigint>")
    nameless = texts.where("doc_id is null")
    if "ahead" in known.columns:
        nameless = nameless.withColumn("ahead", F.lit(0).cast("long"))
    nameless = nameless.withColumn("marks", nothing).withColumn("starts", nothing)
    marked = known.join(both, "doc_id", "left").unionByName(nameless)
    out = marked.mapInArrow(_remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
