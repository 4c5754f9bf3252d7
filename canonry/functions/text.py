"""Text expressions. All are native Column expressions (whole-stage codegen, no UDF).

Fixed values that must agree with Python's ``str`` semantics:

* Python whitespace (``str.isspace``) = Java ``(?U)\\s`` plus U+001C..U+001F.
* JavaScript ``String.prototype.trim`` removes tab, LF, VT, FF, CR, space,
  U+00A0, U+FEFF, U+2028, U+2029 and every other Zs character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes (Java regex syntax).
PY_WHITESPACE = r"[\s\x1c-\x1f]"
JS_TRIM_CLASS = r"[\t\n\x0B\f\r\x{00A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]"

_WS_RUN = "(?U)" + PY_WHITESPACE + "+"
_PY_STRIP = "(?U)^" + PY_WHITESPACE + "+|" + PY_WHITESPACE + r"+\z"
_JS_TRIM = "^" + JS_TRIM_CLASS + "+|" + JS_TRIM_CLASS + r"+\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col, mask_digits: bool = False) -> Column:
    """Lower-case, optionally mask digit runs as ``#``, collapse whitespace runs, strip.

    Equals Python ``re.sub(r"\\s+", " ", s.lower()).strip()`` (with
    ``re.sub(r"\\d+", "#", ...)`` after ``lower`` when ``mask_digits``).
    NULL stays NULL.
    """
    x = F.lower(_c(col))
    if mask_digits:
        x = F.regexp_replace(x, r"(?U)\d+", "#")
    x = F.regexp_replace(x, _WS_RUN, " ")
    return F.regexp_replace(x, "^ | $", "")


def python_strip(col) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(col), _PY_STRIP, "")


def js_trim(col) -> Column:
    """JavaScript ``trim()``."""
    return F.regexp_replace(_c(col), _JS_TRIM, "")


def strip_token(col, token: str = "<pad>") -> Column:
    """Remove every occurrence of a marker token, then strip (``s.replace(tok, '').strip()``)."""
    return python_strip(F.replace(_c(col), F.lit(token), F.lit("")))


def split_lines(col) -> Column:
    """Blob -> array of lines: split on LF, JS-trim each line, drop blank lines."""
    parts = F.split(_c(col), "\n", -1)
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, _JS_TRIM, ""))
    return F.filter(trimmed, lambda x: F.length(x) > 0)


def split_whitespace(col) -> Column:
    """Python ``str.split()`` with no argument: split on whitespace runs, no empty items."""
    stripped = python_strip(col)
    return F.when(F.length(stripped) == 0, F.array().cast("array<string>")).otherwise(
        F.split(stripped, _WS_RUN, -1))


def word_terms(col) -> Column:
    """Words of an already normalised text (single spaces, stripped)."""
    return F.filter(F.split(_c(col), " ", -1), lambda x: F.length(x) > 0)


def char_ngrams(col, n: int = 3) -> Column:
    """Character n-grams of the whole text; a non-empty text shorter than n is one term."""
    c = _c(col)
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1),
                        lambda i: F.substring(c, i, n))
    return (F.when(F.length(c) >= n, grams)
            .when(F.length(c) > 0, F.array(c))
            .otherwise(F.array().cast("array<string>")))


def tokenize_terms(col, kind: str = "word", n: int = 3, normalize: bool = True) -> Column:
    """Terms of a whole text, with repeats, in order.

    ``kind="word"``: words of the normalised text; ``kind="char_ngram"``: character
    n-grams.
    """
    c = normalize_text(col) if normalize else _c(col)
    if kind == "word":
        return word_terms(c) if normalize else split_whitespace(c)
    if kind == "char_ngram":
        return char_ngrams(c, n)
    raise ValueError(f"unknown term kind {kind!r}")


def tokenize_words(col, normalize: bool = True) -> Column:
    """Words of a whole text and empty strings, which the caller drops: one regex split, no per-element lambda."""
    return F.split(F.lower(_c(col)) if normalize else _c(col), _WS_RUN, -1)


def explode_terms(df, keep_cols, text_col: str, kind: str = "word", n: int = 3, normalize: bool = True,
                  with_pos: bool = False, term_col: str = "term"):
    """One row per term (``keep_cols`` + term [+ pos]), in text order.

    For words this is a single regex split of the lower-cased text followed by an
    explode and a filter of empty strings: the same terms as
    ``split(normalize_text(t), ' ')`` without per-element lambdas, so it stays in
    whole-stage codegen.
    """
    keep = [F.col(c) if isinstance(c, str) else c for c in keep_cols]
    if kind == "char_ngram":
        # The normalised text becomes an array of characters once per row (the one-element
        # explode keeps the optimiser from moving that work above the second generator);
        # each start position then cuts its n-gram by index, so the work is linear in the
        # text's length. A non-empty text shorter than n is one term; an empty (or NULL)
        # text generates only an empty term, dropped below.
        c = normalize_text(text_col) if normalize else F.col(text_col)
        chars = df.select(*keep, F.explode(F.array(F.split(c, ""))).alias("_chars"))
        kept = chars.columns[:len(keep)]
        starts = F.sequence(F.lit(1), F.greatest(F.size("_chars") - n + 1, F.lit(1)))
        gen = chars.select(*kept, "_chars", F.posexplode(starts).alias("pos", "_start"))
        out = gen.select(*kept, *(["pos"] if with_pos else []),
                         F.array_join(F.slice("_chars", F.col("_start"), n), "").alias(term_col))
        return out.where(F.length(F.col(term_col)) > 0)
    if kind == "word":
        arr = tokenize_words(text_col, normalize)
    else:
        arr = tokenize_terms(text_col, kind, n, normalize)
    if with_pos:
        out = df.select(*keep, F.posexplode(arr).alias("pos", term_col))
    else:
        out = df.select(*keep, F.explode(arr).alias(term_col))
    return out.where(F.length(F.col(term_col)) > 0)
