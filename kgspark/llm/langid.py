"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, draw, held_out, slices

BITS = 15
GRAMS = (1, 2, 3)
#: Training draws about so many rows of each language, and not more than ROWS in all where each language has LEAST_ROWS; and of those, in the
#: order of a hash, so many that they hold MOST_GRAMS distinct n-grams, each text's counted for itself (one text of a language at least). This
#: bounds what the driver holds, by languages; prediction has no such bounds.
ROWS_PER_LANGUAGE = 400
ROWS = 4000
LEAST_ROWS = 50
MOST_GRAMS = 16_000_000
EPOCHS = 4
#: Follow-the-regularised-leader: step size, its smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
_AT_ONCE = 1 << 20
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of lower-case code points occurs in a whole text, blanks put around it."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    most = max(GRAMS)
    for at in range(0, len(points), _AT_ONCE):
        part = points[at : at + _AT_ONCE + most - 1].astype(np.uint64)
        h = np.zeros(len(part), dtype=np.uint64)
        for n in GRAMS:
            size = min(_AT_ONCE, len(part) - n + 1)
            if size <= 0:
                break
            h = h[:size] * np.uint64(0x100000001B3) + part[n - 1 : n - 1 + size] + np.uint64(n)
            hashed = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            counts += np.bincount(hashed.view(np.int64), minlength=1 << BITS)
    return counts


def _lower(column: pa.Array) -> list[str]:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")).to_pylist()


# --- corpus statistics --------------------------------------------------------------------------

_DF = pa.schema([("gram", pa.int32()), ("df", pa.int64()), ("docs", pa.int64())])


def _document_frequencies(batches):
    df, docs = np.zeros(1 << BITS, dtype=np.int64), 0
    for batch in batches:
        for text in _lower(batch.column("text")):
            df += gram_counts(text) > 0
            docs += 1
    some = np.flatnonzero(df)
    yield batch_of(_DF, np.append(some, -1), np.append(df[some], 0), np.append(np.zeros(len(some), dtype=np.int64), docs))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each n-gram over all rows of docs (column text)."""
    rows = docs.select("text").mapInArrow(_document_frequencies, "gram int, df long, docs long")
    df, total = np.zeros(1 << BITS), 0
    for r in rows.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs")).collect():  # 2**BITS rows and one
        if r["gram"] < 0:
            total = r["docs"]
        else:
            df[r["gram"]] = r["df"]
    return np.log((1 + total) / (1 + df)) + 1


# --- model --------------------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # n-gram x language
    bias: np.ndarray
    temperature: float

    def features(self, some: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, values) of a text's n-grams and their counts: TF-IDF of unit length."""
        x = counts * self.idf[some]
        return some, x / max(np.linalg.norm(x), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        counts = gram_counts(text)
        some = np.flatnonzero(counts)
        some, x = self.features(some, counts[some])
        return x @ self.weights[some] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, seed: int = 3) -> Model:
    """A model of (n-grams, counts) of texts and their languages.

    FTRL-proximal with elastic net on four fifths of the rows; the temperature fits the likelihood of the others."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    model = Model(names, idf, np.zeros((1 << BITS, len(names))), np.zeros(len(names)), 1.0)
    rows = [(model.features(*t), names.index(y)) for t, y in zip(texts, langs)]
    order = rng.permutation(len(rows))
    check, use = order[: len(rows) // 5], order[len(rows) // 5 :]
    z, n = np.zeros((1 << BITS, len(names))), np.zeros((1 << BITS, len(names)))
    zb, nb = np.zeros(len(names)), np.zeros(len(names))

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(use):
            (some, x), y = rows[i]
            w, b = leader(z[some], n[some], L1), leader(zb, nb, 0.0)
            error = _softmax(x @ w + b)
            error[y] -= 1
            g = np.outer(x, error)
            grown = n[some] + g * g
            z[some] += g - (np.sqrt(grown) - np.sqrt(n[some])) / ALPHA * w
            n[some] = grown
            grown = nb + error * error
            zb += error - (np.sqrt(grown) - np.sqrt(nb)) / ALPHA * b
            nb = grown
    model.weights, model.bias = leader(z, n, L1), leader(zb, nb, 0.0)
    if len(check):
        logits = np.array([x @ model.weights[some] + model.bias for (some, x), _ in (rows[i] for i in check)])
        right = np.array([rows[i][1] for i in check])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    return model


_COUNTED = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("h2", pa.int64()), ("grams", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _counted(batches):
    for batch in slices(batches):
        some, counts = [], []
        for text in _lower(batch.column("text")):
            n = gram_counts(text)
            some.append(np.flatnonzero(n))
            counts.append(np.minimum(n[some[-1]], (1 << 31) - 1))
        yield batch_of(_COUNTED, batch.column("lang"), batch.column("h"), batch.column("h2"), some, counts)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = ROWS, most_grams: int = MOST_GRAMS) -> Model | None:
    """A model from documents that aren't held out and have a language; None without any.

    The inverse frequencies cover all documents that aren't held out, the weights a bounded sample in hash order.
    """
    may = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    rows = may.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").collect()}  # a row for each language
    if not counts:
        return None
    idf = inverse_frequencies(may)
    each = min(rows_per_language, max(LEAST_ROWS, most_rows // len(counts)))
    u = draw(F.col("doc_id"))
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / v)))])
    # Rows may share an id: the order is by the text too, so runs agree.
    drawn = rows.where(u < share[F.col("lang")]).withColumns({"h": F.xxhash64("doc_id"), "h2": F.xxhash64("text", "lang")})
    counted = drawn.select("lang", "h", "h2", "text").mapInArrow(_counted, "lang string, h long, h2 long, grams array<int>, counts array<int>")
    so_far = Window.partitionBy("lang").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, 0)
    sized = counted.withColumn("held", F.sum(F.size("grams")).over(so_far)).withColumn("nth", F.count("*").over(so_far))
    fitting = sized.where((F.col("nth") == 1) | ((F.col("held") <= most_grams // len(counts)) & (F.col("nth") <= 2 * each))).select("lang", "h", "h2", "grams", "counts")
    got = fitting.orderBy("h", "h2").toArrow()
    some, n = ([np.asarray(x.values) for x in got.column(c)] for c in ("grams", "counts"))
    return train(list(zip(some, n)), got.column("lang").to_pylist(), idf) if got.num_rows else None


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(held):
    def run(batches):
        model = held.value
        for batch in slices(batches):
            letters = pc.match_substring_regex(pc.fill_null(batch.column("text").cast(pa.string()), ""), r"\pL").to_pylist()
            langs, scores = [], []
            for text, some in zip(_lower(batch.column("text")), letters):
                if model is None or not some:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax(model.logits(text) / model.temperature)
                best = int(np.argmax(p))
                langs.append(model.languages[best])
                scores.append(float(p[best]))
            yield batch_of(_PREDICTED, batch.column("doc_id"), langs, scores)

    return run


def language_id(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = ROWS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by its whole text alone.

    docs: doc_id (long), text and lang. Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 4
    isn't 2, of any length. Long texts are counted in slices and predicted whole. Texts that are null or have no letter, and all texts if there is nothing to learn from, get "und" with
    score 0; others the likeliest language and its calibrated probability. Repeated rows come back as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, rows_per_language, most_rows, most_grams))
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(held), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
