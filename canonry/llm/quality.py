"""Quality rules as a short-circuit cascade.

Each rule is a boolean column "rejects this text". On a sample of at most ``SAMPLE_ROWS``
expected rows (drawn from the whole table) every rule's cost (seconds to evaluate it) and
selectivity (share it rejects) are measured, and the rules run in descending order of
rejection per cost, as branches of one CASE: a text that a rule rejects costs no further rule.
The order decides only how fast a verdict comes, never the verdict, so the sample bounds
planning work and no result depends on it.

Everything is one projection of built-in functions: nothing is shuffled and a text is one
row's work, near linear in its length (the sort of a text's window hashes, done only where
some window repeats, is the exception).

Edge cases: null and empty texts have no words and are rejected. Repeated rows each get their
row; ties do not occur. An empty table gives no rows. Extra columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.llm.native import covered, let, space_words, window_hashes

SAMPLE_ROWS = 500
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

#: The symbols that count.
SYMBOLS = "[#*$%&|<>]+"


def count_of(chars: str, text: Column) -> Column:
    """Number of characters of a class (a regular expression of runs of it) in a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def n_repeat_words(words: Column, k: int = REPEAT_WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more in the text."""
    def positions(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda j: (F.element_at(s, j)["h"] == F.element_at(s, F.greatest(j - 1, F.lit(1)))["h"]) & (j > 1)
            | (F.element_at(s, j)["h"] == F.element_at(s, F.least(j + 1, F.size(s)))["h"]) & (j < F.size(s))),
            lambda j: F.element_at(s, j)["i"])))

    return let(window_hashes(words, k), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(positions(h), k)))


def n_dup_lines(text: Column) -> Column:
    r"""Lines (split at \n) with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^[\x20\x09-\x0D]*$"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def words_and_marks() -> dict[str, Column]:
    """``words``, and ``marks``: what is neither a lower-case letter nor white space, a small part of prose; counts read that."""
    return {"words": space_words(F.col("text")),
            "marks": F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[a-z\x20\x09-\x0D]+", "")}


def counts(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The counts every text is judged by."""
    return {
        "n_words": F.size(of("words")).cast("long"),
        "word_chars": F.length(F.array_join(of("words"), "")).cast("long"),
        "n_symbols": count_of(SYMBOLS, of("marks")),
        "n_dup_lines": n_dup_lines(F.coalesce(of("text").cast("string"), F.lit(""))).cast("long"),
        "n_repeat_words": n_repeat_words(of("words")).cast("long"),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """Adds ``words``, ``marks`` and the counts."""
    return docs.withColumns(words_and_marks()).withColumns(counts())


def _of(record: Column) -> Callable[[str], Column]:
    return lambda name: record[name]


def verdict(order: list[str]) -> Column:
    """Kept or not, of the column ``text`` alone. The counts are bound by ``let``: a filter on this
    column is pushed below projections, and would otherwise write each count's expression into every branch."""
    def struct(columns: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    def judged(base: Column) -> Column:
        have = {name: base[name] for name in ("text", "words", "marks")}
        return let(struct({"text": have["text"], "marks": have["marks"], **counts(have.__getitem__)}),
                   lambda s: cascade(order, rules(_of(s)), base_failed(_of(s))))

    return let(struct({"text": F.col("text").cast("string"), **words_and_marks()}), judged)


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * of("n_words"))


def rules(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Rule name -> "rejects": over the text and the columns of ``statistics``.

    Thresholds are wide: prose of any language passes all of them. ``of`` gives the column of a name.
    """
    text = F.coalesce(of("text").cast("string"), F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^[\x20\x09-\x0D]*$")))
    return {
        "symbols": 2 * of("n_symbols") > of("n_words"),
        "word_length": (of("word_chars") < 2 * of("n_words")) | (of("word_chars") > 20 * of("n_words")),
        "duplicate_lines": (of("n_dup_lines") >= 3) & (2 * of("n_dup_lines") > lines),
        "capitals": (of("word_chars") >= 40) & (2 * count_of("[A-Z]+", of("marks")) > of("word_chars")),
        "exclamation": 3 * count_of("[!?]+", of("marks")) > of("n_words"),
        "digits": 2 * count_of("[0-9]+", of("marks")) > of("word_chars"),
    }


def order_rules(sample: DataFrame, checks: dict[str, Column]) -> list[str]:
    """Rule names by rejected share per second on the sample, best first (ties by name).

    ``sample`` holds the columns the rules read; it is cached here, bounded as it is.
    """
    sample = sample.cache()
    try:
        total = sample.count()
        rank = []
        for name, check in checks.items():
            begin = time.perf_counter()
            rejected = sample.select(F.sum(check.cast("int"))).first()[0] or 0
            cost = time.perf_counter() - begin
            rank.append((-(rejected / max(total, 1)) / cost, name))
    finally:
        sample.unpersist()
    return [name for _, name in sorted(rank)]


def cascade(order: list[str], checks: dict[str, Column], first: Column) -> Column:
    """Kept or not: ``first`` rejects before any rule; a CASE stops at the first branch that holds."""
    verdict = F.when(F.coalesce(first, F.lit(False)), F.lit(False))
    for name in order:
        verdict = verdict.when(F.coalesce(checks[name], F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True))


def measured_order(docs: DataFrame, sample_rows: int) -> list[str]:
    """The rules' order by a sample of ``sample_rows`` expected rows of the whole table."""
    texts = docs.select("text")
    share = min(1.0, sample_rows / max(docs.select(F.lit(1)).count(), 1))
    return order_rules(statistics(texts.sample(False, share, seed=5)), rules())


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_cols``, the counts, ``base_failed`` and ``kept`` of every document."""
    order = measured_order(docs, sample_rows)
    return (statistics(docs.select(*keep_cols, "text") if "text" not in keep_cols else docs.select(*keep_cols))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", cascade(order, rules(), F.col("base_failed"))))


def keep(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass, all columns as they came; each text's counts are computed once."""
    return docs.filter(verdict(measured_order(docs, sample_rows)))
