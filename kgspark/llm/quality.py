"""Quality rules as a short-circuit cascade, ordered by rejection per cost. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, draw, own_names, word_array

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: The cascade's order is fitted on about so many documents; the verdicts don't depend on it.
SAMPLE_ROWS = 2000


def _bind(value: Column, use) -> Column:
    """use(value) with value worked out once: a lambda over a one-element array holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the text, the first included.

    Where the windows' 64-bit hashes are all different, so are the windows. Else the windows themselves are sorted, so equal ones are
    neighbours; their places are sorted, and each adds the words up to the next place, WINDOW at most. n log n in the
    number of words.
    """
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))

    def hashes(w: Column) -> Column:
        from_word = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
        return F.slice(from_word, F.lit(1), F.size(w) - (WINDOW - 1))

    def covered(places: Column) -> Column:
        gap = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        twin = lambda w, j: F.coalesce(w["t"] == F.get(windows, j)["t"], F.lit(False))
        marked = F.filter(windows, lambda w, i: twin(w, i - 1) | twin(w, i + 1))
        return F.sort_array(F.transform(marked, lambda w: w["i"]))

    def windows(w: Column) -> Column:
        text = lambda i: F.concat_ws(" ", *[F.get(w, i - 1 + k) for k in range(WINDOW)])
        return F.sort_array(F.transform(starts(w), lambda i: F.struct(text(i).alias("t"), i.alias("i"))))

    def counted(w: Column) -> Column:
        no_twins = _bind(hashes(w), lambda h: F.size(h) == F.size(F.array_distinct(h)))
        return F.when((F.size(w) <= WINDOW) | no_twins, F.lit(0)).otherwise(_bind(_bind(windows(w), repeated), covered))

    return _bind(words, counted).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def _symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


@dataclass
class Measures:
    """What the rules look at, as columns: worked out already, or expressions that a rule pays for when it is reached."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_repeat_words: Column


#: Rules of the cascade: true means the document is rejected.
RULES: dict[str, Callable[[Measures], Column]] = {
    "few_words": lambda m: m.n_words < MIN_WORDS,
    "repeats": lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > 3 * m.word_chars,
    "duplicate_lines": lambda m: _bind(_lines(m.text), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x)),
    "word_length": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 25 * m.n_words),
    "letters": lambda m: 10 * (F.length(m.text) - F.length(F.regexp_replace(m.text, r"\p{L}+", ""))) < 5 * m.word_chars,
    "long_words": lambda m: 10 * F.size(F.filter(m.words, lambda w: F.length(w) > 60)) > m.n_words,
}
#: What a rule costs, in nanoseconds: for the row, for each word and for each character. Measured once on prose; only their
#: proportions matter, and fixed ones give the same order in every run, which timing the sample wouldn't.
COSTS = {
    "few_words": (50, 0, 0),
    "repeats": (500, 700, 0),
    "symbols": (200, 0, 5),
    "duplicate_lines": (800, 0, 3),
    "word_length": (100, 0, 0),
    "letters": (200, 0, 12),
    "long_words": (200, 120, 0),
}


def base_metrics(docs: DataFrame, held: str = "_words") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the words themselves in a column named held."""
    words = docs.withColumn(held, word_array(F.col("text")))
    lines = _bind(_lines(_text()), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = words.select(
        "*",
        F.size(held).cast("long").alias("n_words"),
        _word_chars(F.col(held)).alias("word_chars"),
        _symbols(_text()).alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeat_words(F.col(held)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _measured(held: str = "_words") -> Measures:
    """The columns of base_metrics."""
    return Measures(_text(), *[F.col(c) for c in (held, "n_words", "word_chars", "n_symbols", "n_repeat_words")])


def _cascade(m: Measures, order: Sequence[str]) -> Column:
    """True for a document that no rule rejects; a rule is worked out only where the earlier ones let pass."""
    verdict = F
    for name in order:
        verdict = verdict.when(RULES[name](m), F.lit(False))
    return verdict.otherwise(F.lit(True))


def accepted(order: Sequence[str]) -> Column:
    """The verdict on the column text. Words and their length are worked out once, all else when its rule is reached."""
    text = _text()

    def judged(words: Column) -> Column:
        lazy = lambda chars: Measures(text, words, F.size(words).cast("long"), chars, _symbols(text), repeat_words(words))
        return _bind(_word_chars(words), lambda chars: _cascade(lazy(chars), order))

    return _bind(word_array(F.col("text")), judged)


def cascade_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share it rejects of what reaches it, nanoseconds a row) of a sample, the best rejection per cost first.

    docs: text and, to draw the sample by, doc_id (else the text): rows whose hash falls into a share of the number
    of rows. Which rules reject a row is one number, so the sample comes back as a row for each set of rules (2 ** 7 at most)
    with how many rows and what cost it stands for. Each place goes to the rule that rejects most per cost of the rows that the
    earlier rules let pass; rules that reject nothing go last, cheap ones first. Repeated runs give the same order.
    """
    key = "doc_id" if "doc_id" in docs.columns else "text"
    sample = base_metrics(docs.where(draw(F.col(key)) < sample_rows / max(1, docs.count())).select("text"))
    names, m = list(RULES), _measured()
    rejected = [F.when(RULES[name](m), F.lit(1 << k)).otherwise(0) for k, name in enumerate(names)]
    cost = lambda row, word, char: row + word * F.col("n_words") + char * F.length(m.text)
    sums = [F.sum(cost(*COSTS[name])).cast("double").alias(name) for name in names]
    mask = rejected[0]
    for r in rejected[1:]:
        mask = mask.bitwiseOR(r)
    left = [(r["mask"], r["n"], {name: r[name] for name in names}) for r in sample.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"), *sums).collect()]
    order = []
    while len(order) < len(names):
        n = sum(x[1] for x in left)
        best = None
        for k, name in enumerate(names):
            if name not in [o[0] for o in order]:
                bad = sum(x[1] for x in left if x[0] >> k & 1) / n if n else 0.0
                spent = sum(x[2][name] for x in left) / n if n else float(COSTS[name][0])
                rank = (-bad / spent, spent, name)
                if best is None or rank < best[0]:
                    best = (rank, name, bad, spent)
        order.append(best[1:])
        left = [x for x in left if not x[0] >> names.index(best[1]) & 1]
    return order


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs' rows with the base metrics, base_failed and kept; all of docs' columns stay.

    docs: text (null: no words); a column named as one of the metrics is replaced. A document is kept if no rule
    rejects it. The rules stand in one CASE in the order of cascade_order. Empty texts fail few_words. Texts of any length are
    taken whole, in n log n of their words. Repeated rows are judged alike and all come back. An empty table gives no rows.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = docs.drop(*own)
    (held,) = own_names(docs, "_words")
    order = [name for name, _, _ in cascade_order(docs, sample_rows)]
    return base_metrics(docs, held).withColumn("kept", _cascade(_measured(held), order)).drop(held)


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rejected documents; same columns. No metric is worked out that the verdict doesn't need."""
    return docs.where(accepted([name for name, _, _ in cascade_order(docs, sample_rows)]))


#: DuckDB SQL for op3_quality.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, words[i:i+4] AS win5
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM d WHERE len(words) >= 5)
), marked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win5) AS n FROM win
), gaps AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS covered FROM marked WHERE n > 1
), rep AS (
  SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id
), m AS (
  SELECT doc_id, t, words, lines, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * word_chars OR 10 * n_dup_lines > 3 * len(lines)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 10 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 5 * word_chars
            OR 10 * len(list_filter(words, lambda w: length(w) > 60)) > n_words) AS kept
FROM b
"""
