"""Column helpers of the operators that run on DataFrame functions alone."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but white space (\x20, \x09 to \x0D).
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
#: Lower-case alphanumeric words: everything else in ASCII separates.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters outside ASCII that lower() could change (unassigned ones in case its tables are newer).
_OTHER_CASE = r"[[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]&&[^\x00-\x7F]]"


def empty(kind: str) -> Column:
    """An empty array of a given type."""
    return F.array().cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    The optimiser may write a column's expression into a lambda that refers to it, where it
    would run once per element; a lambda variable cannot be unfolded like that.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(_OTHER_CASE), exact).otherwise(F.lower(text))


def _runs(text: Column, chars_trimmed: Column, separators: str) -> Column:
    return F.when(chars_trimmed == "", empty("string")).otherwise(F.split(chars_trimmed, separators))


def space_words(text: Column) -> Column:
    """White-space separated words of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return _runs(text, trimmed, SPACE)


def lower_words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text (letters outside ASCII as they are); null has none."""
    separators = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(separators))
    return _runs(text, trimmed, NO_WORD)


def window_hashes(items: Column, k: int) -> Column:
    """64-bit hash of each k consecutive items; none where there are fewer.

    Windows of 2, 4, 8, ... items are hashed from the two halves, those of k from the powers
    of two that make it up: a few hashes of two numbers per item instead of one of k strings.
    """
    def pairs(left: Column, right: Column, skip: int, n: Column) -> Column:
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + skip), n), lambda a, b: F.xxhash64(a, b))

    def grow(power: Column, size: int, made: Column | None, done: int, rest: int) -> Column:
        if rest & 1:
            if made is None:
                made, done = power, size
            else:
                n = F.size(power) - done
                return let(pairs(made, power, done, n),
                           lambda m: grow(power, size, m, done + size, rest - 1))
        if rest <= 1:
            return made
        return let(pairs(power, power, size, F.size(power) - size),
                   lambda p: grow(p, 2 * size, made, done, rest >> 1))

    return let(items, lambda a: F.when(F.size(a) >= k, let(
        F.transform(a, lambda x: F.xxhash64(x)), lambda h: grow(h, 1, None, 0, k)))
        .otherwise(empty("bigint")))


def covered(starts: Column, k: int) -> Column:
    """Number of positions covered by windows of ``k`` that begin at the ascending distinct ``starts``."""
    return let(starts, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.lit(k) + F.aggregate(
        F.sequence(F.lit(1), F.size(p)), F.lit(0),
        lambda total, i: total + F.when(i > 1, F.least(F.lit(k), F.element_at(p, i) - F.element_at(p, F.greatest(i - 1, F.lit(1)))))
        .otherwise(F.lit(0)))))
