"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, draw, held_out, slices

#: Training draws about so many rows of each label, twice as many at most, in the order of a hash, and whole texts of so many bytes of each
#: label at most (one text at least). This bounds what the driver holds; scoring has no such bounds.
ROWS_PER_LABEL = 2500
BYTES_PER_LABEL = 64 << 20
DIM = 8
BUCKET_BITS = 18
GRAMS = (3, 4, 5, 6)
#: Words averaged at a time: one bad word in a long text must still tell, so a text's score is its worst segment's.
SEGMENT = 3
EPOCHS = 10
BATCH = 32
STEP, SOFT_STEP = 0.3, 0.05
THRESHOLD = 0.3
WORDS_AT_ONCE = 1 << 16  # distinct words whose n-grams are worked on together
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


# --- features -----------------------------------------------------------------------------------


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, edges): hashed byte n-grams of each word between "<" and ">"; word i has edges[i] ... edges[i + 1]."""
    if len(words) > WORDS_AT_ONCE:
        parts = [subwords(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)]
        sizes = np.concatenate([np.diff(edges) for _, edges in parts])
        return np.concatenate([buckets for buckets, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))
    marked = pc.binary_join_element_wise("<", pc.utf8_trim(words, characters=_TRIM), ">", "")
    if isinstance(marked, pa.ChunkedArray):
        marked = marked.combine_chunks()
    sizes = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(x.encode() for x in marked.to_pylist()), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int32), np.zeros(len(words) + 1, dtype=np.int64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    h = _BYTES[data]
    one = h
    found, owner = [], []
    # A word of two marks alone has no n-gram; its marks stand for it.
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _BASE + one[n - 1 :] if len(h) > 1 else h[:0]
        good = at[: len(h)] + n <= end[: len(h)]
        if n == 2:
            good &= (sizes == 2)[word[: len(h)]]
        elif n not in GRAMS:
            continue
        mixed = (h[good] ^ (h[good] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        found.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owner.append(word[: len(h)][good])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes)))))
    return np.concatenate(found)[order], edges


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all texts, words per text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each segment among all words, segments per text): SEGMENT words each, the last one shorter."""
    per = -(-counts // SEGMENT)
    first = np.cumsum(counts) - counts
    base = np.repeat(first, per)
    within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return base + within * SEGMENT, per


def _segment_means(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(scores, starts) / np.diff(np.append(starts, len(scores)))


def word_scores(gains: np.ndarray, buckets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean gain of each word's subwords."""
    out = np.zeros(len(edges) - 1)
    for at in range(0, len(out), WORDS_AT_ONCE):
        own = edges[at : at + WORDS_AT_ONCE + 1]
        total = np.concatenate(([0.0], np.cumsum(gains[buckets[own[0] : own[-1]]], dtype=np.float64)))[own - own[0]]
        out[at : at + WORDS_AT_ONCE] = np.diff(total) / np.maximum(np.diff(own), 1)
    return out


# --- model --------------------------------------------------------------------------------------


@dataclass
class Model:
    """gains: what each subword bucket adds for the label 1 (its embedding on the softmax's difference)."""

    gains: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, index, counts = _coded(texts)
        out = np.zeros(len(counts))
        if not len(index):
            return out
        own = word_scores(self.gains, *subwords(words))[index]
        starts, per = _segments(counts)
        some = per > 0
        first = (np.cumsum(per) - per)[some]
        logits = np.maximum.reduceat(_segment_means(own, starts), first) + self.bias
        out[some] = 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -40, 40)))
        # A text without a word splits into one empty word.
        blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))), 0)
        out[blank.to_numpy(zero_copy_only=False)] = 0
        return out


def _calibrate(logits: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a sigmoid, the labels weighed to the given share of ones; Newton steps, slightly regularised."""
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    x = np.stack((logits, np.ones(len(logits))), axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * (theta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _log_odds(labels: np.ndarray, index: np.ndarray, counts: np.ndarray, buckets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each subword by the texts of either label that have a word with it; where the search begins."""
    row = np.repeat(np.arange(len(counts)), counts)
    n_words = len(edges) - 1
    pairs = np.unique(row * n_words + index)
    word, toxic = pairs % n_words, labels[pairs // n_words] == 1
    seen = [np.bincount(word[flag], minlength=n_words) for flag in (toxic, ~toxic)]
    each = np.zeros((2, 1 << BUCKET_BITS))
    for at in range(0, n_words, WORDS_AT_ONCE):
        own = edges[at : at + WORDS_AT_ONCE + 1]
        for total, n in zip(each, seen):
            total += np.bincount(buckets[own[0] : own[-1]], weights=np.repeat(n[at : at + WORDS_AT_ONCE], np.diff(own)), minlength=1 << BUCKET_BITS)
    return np.log((each[0] + 0.5) / (labels == 1).sum()) - np.log((each[1] + 0.5) / (labels == 0).sum())


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Fit embeddings and softmax together by Adagrad on four fifths of the texts, calibrate on the others.

    A text learns through its worst segment alone, which is looked up anew before each epoch.
    """
    rng = np.random.default_rng(seed)
    words, index, counts = _coded(pa.array(texts, pa.string()))
    buckets, edges = subwords(words)
    grams = np.diff(edges)
    table = rng.uniform(-0.5 / DIM, 0.5 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2)
    table_seen = np.full(1 << BUCKET_BITS, 1e-6, dtype=np.float32)
    soft_seen, bias_seen = np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    rows = rng.permutation(np.flatnonzero(counts > 0))
    check, fit = rows[: len(rows) // 5], np.sort(rows[len(rows) // 5 :])
    use = _ranges((np.cumsum(counts) - counts)[fit], counts[fit])
    index, counts, y = index[use], counts[fit], labels[fit]
    starts, per = _segments(counts)
    stops, first = np.append(starts[1:], len(index)), np.cumsum(per) - per
    gains = _log_odds(y, index, counts, buckets, edges) if 0 < y.sum() < len(y) else np.zeros(1 << BUCKET_BITS)
    for _ in range(EPOCHS):
        means = _segment_means(word_scores(gains, buckets, edges)[index], starts)
        top = np.maximum.reduceat(means, first)
        best = np.flatnonzero(means == np.repeat(top, per))
        best = best[np.unique(np.repeat(np.arange(len(fit)), per)[best], return_index=True)[1]]  # the first of each text
        order = rng.permutation(len(fit))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            begin, n_words = starts[best[part]], stops[best[part]] - starts[best[part]]
            ws = index[_ranges(begin, n_words)]
            n = grams[ws]
            g = buckets[_ranges(edges[ws], n)]
            share = np.repeat((1.0 / (n * np.repeat(n_words, n_words))).astype(np.float32), n)
            size = np.add.reduceat(n, np.cumsum(n_words) - n_words)
            owner = np.repeat(np.arange(len(part)), size)
            hidden = np.add.reduceat(share[:, None] * table[g], np.cumsum(size) - size, axis=0)
            toward = softmax[:, 1] - softmax[:, 0]
            error = 1 / (1 + np.exp(-np.clip(hidden @ toward + (bias[1] - bias[0]), -40, 40))) - y[part]
            pull = (share * error[owner])[:, None].astype(np.float32) * toward
            np.add.at(table_seen, g, (pull**2).mean(axis=1))
            pull *= np.float32(STEP) / np.sqrt(table_seen[g])[:, None]
            np.subtract.at(table, g, pull)
            both = np.stack((-error, error), axis=1)
            step = hidden.T @ both
            soft_seen += step**2
            softmax -= (SOFT_STEP * step / np.sqrt(soft_seen)).astype(np.float32)
            step = both.sum(axis=0)
            bias_seen += step**2
            bias -= SOFT_STEP * step / np.sqrt(bias_seen)
        gains = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
    model = Model(gains, float(bias[1] - bias[0]), 1.0, 0.0)
    if len(check) and 0 < labels[check].mean() < 1:
        p = np.clip(model.scores(pa.array([texts[i] for i in check], pa.string())), 1e-12, 1 - 1e-12)
        model.slope, model.shift = _calibrate(np.log(p / (1 - p)), labels[check], prior)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, bytes_per_label: int = BYTES_PER_LABEL) -> Model | None:
    """A model of labels.toxic from a bounded sample of rows that aren't held out; None if a label is missing.

    The sample has at most rows_per_label ids of each label, in the order of a hash, and of their whole texts those that together have
    bytes_per_label bytes at most; the share of ones is that of all rows that may be learnt from. An id with several labels counts as toxic if one of them says so.
    """
    rows = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in rows.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = {y: min(1.0, rows_per_label / counts[y]) for y in (0, 1)}
    u = draw(F.col("doc_id"))
    wanted = rows.where(u < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    ids = [wanted.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label) for y in (0, 1)]
    ids = ids[0].union(ids[1])  # at most 2 * rows_per_label rows
    # An id may have several rows with different texts: the order is by the text too, so runs agree.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", F.xxhash64("doc_id").alias("h"), F.xxhash64("text", "doc_id").alias("h2"), "text")
    so_far = Window.partitionBy("toxic").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, 0)
    sized = sample.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far)).withColumn("nth", F.count("*").over(so_far))
    fitting = sized.where((F.col("bytes") <= bytes_per_label) | (F.col("nth") == 1)).select("toxic", "h", "h2", "text")
    got = fitting.orderBy("h", "h2").limit(2 * rows_per_label).toPandas()
    y = got["toxic"].to_numpy(dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return train(got["text"].tolist(), y, counts[1] / (counts[0] + counts[1]))


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(held):
    def run(batches):
        model = held.value
        for batch in slices(batches, max_chars=16_000_000):
            scores = model.scores(batch.column("text")) if model else np.zeros(batch.num_rows)
            yield batch_of(_SCORES, batch.column("doc_id"), scores)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows_per_label: int = ROWS_PER_LABEL, bytes_per_label: int = BYTES_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) of each document.

    docs: doc_id (long) and text; labels: doc_id and toxic. Learns from labelled rows whose crc32(doc_id as text) mod 4
    isn't 2, and scores by the whole text alone. Texts without a word (null, empty, blank) score 0, as does everything
    if there is nothing to learn from. Rows repeated with an id come back as often as they are there.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows_per_label, bytes_per_label))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(held), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
