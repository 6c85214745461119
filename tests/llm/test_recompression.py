"""Word dedup by recompression against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import recompression

SCHEMA = "doc_id long, text string"


def brute(rows, window=50):
    cut = [(d, [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]) for d, t in rows]
    first = {}
    for d, words in cut:
        for i in range(len(words) - window + 1 if d is not None else 0):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, words in cut:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1 if d is not None else 0):
            if first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((repr(d), len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got_of(df, **options):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.word_dedup(df, **options).collect())


def passages(rng, n_docs, n_pool, alphabet, longest=200):
    """Documents cut from a pool of passages, changed here and there, so that repeats begin and end anywhere."""
    pool = [[rng.choice(alphabet) for _ in range(rng.randint(60, longest))] for _ in range(n_pool)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, longest)] + [f"x{rng.randrange(9)}"] * rng.randint(0, 2)
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i * 3 % 101, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, size", [(1, 2), (2, 5), (3, 400), (4, 400)])
def test_repeats_anywhere(spark, monkeypatch, seed, size):
    monkeypatch.setattr(recompression, "GROUP_BYTES", 3000)
    monkeypatch.setattr(recompression, "BUCKET_BYTES", 5000)
    rows = passages(random.Random(seed), 60, 6, [f"w{i}é" for i in range(size)])
    want = brute(rows)
    assert sum(w[2] for w in want) > 300
    assert got_of(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


@pytest.mark.parametrize("window", [3, 4, 7, 20])
def test_other_windows(spark, window):
    rows = passages(random.Random(window), 40, 5, [f"w{i}" for i in range(30)], longest=70)
    assert got_of(spark.createDataFrame(rows, SCHEMA), window=window) == brute(rows, window)


def test_runs_and_periodic_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join((["a"] * rng.randint(0, 90) + ["b", "c"] * rng.randint(0, 60) + [rng.choice("xyz")] * rng.randint(0, 70)) * rng.randint(1, 3))) for i in range(30)]
    rows += [(40, "a " * 49), (41, "a " * 50), (42, "a " * 3000), (43, "a b " * 2000), (44, "q " * 49 + "r"), (45, "q " * 50), (46, "p " + "q " * 49 + "r")]
    assert got_of(spark.createDataFrame(rows, SCHEMA).repartition(2)) == brute(rows)


def test_copies_long_texts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(recompression, "GROUP_BYTES", 50_000)
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(40)) for _ in range(n))
    long, copy = prose(30_000), prose(300)
    rows = [(1, long), (2, "new " + long + " end"), (3, prose(70) + " " + long[5000:9000])]
    rows += [(10 + i, copy) for i in range(200)] + [(500 + i, f"{i} {copy} {i}") for i in range(100)]
    # One id with several texts, repeated rows, no id, no text, white space alone.
    tail = prose(60)
    rows += [(700, copy), (700, copy), (700, tail), (701, tail), (701, prose(55)), (None, copy), (None, tail), (None, None), (702, None), (703, ""), (704, " \n\t\r\v\f "), (-5, prose(51) + " " + tail)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("names", F.lit(1)).withColumn("grp", F.lit(None)).repartition(4)
    assert got_of(df) == brute(rows)


def test_rows_of_one_id_lose_nothing_to_each_other(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (2, text + " tail"), (2, other), (2, text)]
    out = {(r["doc_id"], r["n_words"], r["kept"]): r["spans"] for r in recompression.word_dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert out == {(1, 80, text): [], (2, 81, "tail"): [[0, 80]], (2, 80, other): [], (2, 80, ""): [[0, 80]]}


def test_tables_without_repeats(spark):
    assert recompression.word_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(1, None)], [(None, "a " * 60), (None, "a " * 60)], [(1, "a b c")], [(1, "a " * 60)]):
        assert got_of(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(ValueError):
        recompression.word_dedup(spark.createDataFrame([], SCHEMA), window=2)


@pytest.mark.parametrize("window", [3, 10, 50, 128])
@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_every_window_has_a_letter_that_its_words_alone_settle(window, size):
    longest = recompression.rounds_for(window)
    radius, rng = sum(longest), np.random.default_rng(size)
    core = rng.integers(1, size + 1, window).astype(np.uint64)
    found = set()
    for _ in range(20):
        before, after = (rng.integers(1, size + 1, rng.integers(0, 90)).astype(np.uint64) for _ in range(2))
        names = np.concatenate((before, core, after))
        first = np.zeros(len(names), dtype=bool)
        first[0] = True
        at = recompression.boundaries(recompression._mix(names), first, longest) - len(before)
        found.add(tuple(at[(at >= radius) & (at <= window - radius)].tolist()))
    assert len(found) == 1 and found.pop()


def test_runs_are_one_symbol():
    names = np.array([7] * 9 + [8, 9] * 4 + [7] * 3, dtype=np.uint64)
    joined = np.array([True] * (len(names) - 1) + [False])
    start = recompression.symbols(names, np.full(len(names), 2), joined, (1,))  # too long for pairs: runs alone
    assert start.tolist() == [0, *range(9, 18)]
    assert recompression.symbols(names, np.full(len(names), 2), np.zeros(len(names), dtype=bool)).tolist() == list(range(len(names)))
