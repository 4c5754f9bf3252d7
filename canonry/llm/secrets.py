"""Secret scan: fixed patterns, and windows of high entropy inside candidate strings.

Candidates are runs of at least ``WINDOW`` token characters. A candidate of one character
class (hexadecimal, or base 64 with lower and upper case and digits) is slid over with a window
of ``WINDOW`` characters; the character counts of the window are kept from step to step (one
character leaves, one enters), and with them the sum of n log2 n that gives the Shannon
entropy. Windows at or above the class's threshold are merged into spans. A candidate that an
allow-list pattern matches (identifiers of known form, placeholders, alphabets) gives none,
nor does a span that lies inside a span of a fixed pattern.

All of it is one projection of built-in functions per text: nothing is shuffled, and a text's
cost is linear in its length and in the number of its candidates' characters.

Edge cases: null and empty texts have no spans. Equal starts are ordered by kind. Repeated rows
each give a row; an empty table gives none. Other columns are kept (a column named ``spans`` is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.llm.native import empty, let

_SPAN = "struct<begin:int,rank:int,kind:string,end:int>"

ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
          r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12

WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Bits per character that a window must reach, by class.
HEX_BITS = 3.05
BASE64_BITS = 4.05
#: Candidates that match are no secrets.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)|test[_-]?(?:key|token))",
    r"(?i:0123456789|abcdefghijk|qwertyuiop)",
    r"(?i:^(?:sha256|sha384|sha512)-)",
    r"(?i:/(?:usr|etc|var|home|static|assets|images|docs)/)",
    r"(.)\1{7}",
)
#: The characters counted, one counter each.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _matches(text: Column, pattern: str, body) -> Column:
    """``body(match text, code points before it)`` of every leftmost non-overlapping match, nulls left out."""
    def walk(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda between: F.aggregate(
            F.sequence(F.lit(1), F.size(found)),
            F.struct(F.lit(0).alias("at"), empty(_SPAN).alias("out")),
            lambda state, i: let(
                state["at"] + F.length(F.element_at(between, i)),
                lambda begin: F.struct(
                    (begin + F.length(F.element_at(found, i))).alias("at"),
                    F.concat(state["out"], body(F.element_at(found, i), begin)).alias("out"))),
            lambda state: state["out"]))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)).otherwise(empty(_SPAN))


def _span(begin: Column, end: Column, rank: int, kind: str) -> Column:
    return F.array(F.struct(begin.cast("int").alias("begin"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                            end.cast("int").alias("end")).cast(_SPAN))


def _fixed(text: Column, pattern: str, rank: int, kind: str, accept=None) -> Column:
    def body(match: Column, begin: Column) -> Column:
        span = _span(begin, begin + F.length(match), rank, kind)
        return span if accept is None else F.when(accept(match), span).otherwise(empty(_SPAN))

    return _matches(text, pattern, body)


def hot_windows(candidate: Column, bits: float, window: int = WINDOW) -> Column:
    """Merged (begin, end) ranges of the windows of a string whose entropy reaches ``bits``."""
    least = window * (math.log2(window) - bits)  # entropy >= bits  <=>  sum of n log2 n <= this
    xlogx = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    size = len(ALPHABET)
    ranges = "array<struct<begin:int,end:int>>"

    def changed(state: Column, char: Column, by: int) -> Column:
        """State with one more or one less of a character: its counter and the running sum."""
        return let(F.instr(F.lit(ALPHABET), char), lambda k: let(
            F.element_at(state["n"], k), lambda n: F.struct(
                F.concat(F.slice(state["n"], F.lit(1), k - 1), F.array(n + by),
                         F.slice(state["n"], k + 1, F.lit(size) - k)).alias("n"),
                (state["sum"] + F.element_at(xlogx, n + 1 + by) - F.element_at(xlogx, n + 1)).alias("sum"),
                state["out"].alias("out"))))

    def merged(state: Column, i: Column) -> Column:
        begin = i - window
        last = F.element_at(state["out"], -1)
        piece = F.array(F.struct(begin.alias("begin"), i.alias("end")))
        grown = F.array(F.struct(last["begin"].alias("begin"), i.alias("end")))
        out = (F.when(F.size(state["out"]) == 0, piece)
               .when(last["end"] >= begin, F.concat(F.slice(state["out"], F.lit(1), F.size(state["out"]) - 1), grown))
               .otherwise(F.concat(state["out"], piece)))
        hot = (i >= window) & (state["sum"] <= least + 1e-9)
        return F.struct(state["n"].alias("n"), state["sum"].alias("sum"),
                        F.when(hot, out).otherwise(state["out"]).cast(ranges).alias("out"))

    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"),
                     F.array().cast(ranges).alias("out"))
    return let(F.split(candidate, ""), lambda chars: F.aggregate(
        F.sequence(F.lit(1), F.length(candidate)), start,
        lambda state, i: let(
            F.when(i > window, changed(state, F.element_at(chars, F.greatest(i - window, F.lit(1))), -1)).otherwise(state),
            lambda left: let(changed(left, F.element_at(chars, i), 1), lambda now: merged(now, i))),
        lambda state: state["out"]))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of high-entropy windows: base 64 first, then hexadecimal."""
    def body(match: Column, begin: Column) -> Column:
        def spans(bits: float, rank: int, kind: str) -> Column:
            return F.transform(hot_windows(match, bits), lambda r: _span(begin + r["begin"], begin + r["end"], rank, kind)[0])

        is_hex = match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & match.rlike("[0-9]") & match.rlike("[a-fA-F]")
        is_mixed = match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
        return (F.when(match.rlike("|".join(allow)), empty(_SPAN))
                .when(is_hex, spans(HEX_BITS, 4, "entropy_hex"))
                .when(is_mixed, spans(BASE64_BITS, 3, "entropy_base64"))
                .otherwise(empty(_SPAN)))

    return _matches(text, CANDIDATE, body)


def scan(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Adds ``spans``: (begin, rank, kind, end) in code points, end exclusive, by begin and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(
        _fixed(text, ASSIGN, 0, "assign",
               lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_VALUE),
        _fixed(text, ACCESS, 1, "access"), _fixed(text, HEX, 2, "hex"))

    def joined(fixed: Column) -> Column:
        extra = F.filter(entropy_spans(text, allow), lambda s: ~F.exists(
            fixed, lambda b: (b["begin"] <= s["begin"]) & (s["end"] <= b["end"])))
        return F.array_sort(F.concat(fixed, extra))

    return docs.withColumn("spans", let(base, joined))


def names(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_of(spans: Column) -> Column:
    """The spans of the fixed patterns."""
    return F.filter(spans, lambda s: s["rank"] < 3)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every span's text replaced by a mark (overlapping spans by one); others as they are.

    ``n_chars``, where there is one, follows the new text.
    """
    def cut(state: Column, s: Column, text: Column) -> Column:
        # Spans come in order; one that starts inside what is already cut only moves its end.
        fresh = s["begin"] >= state["at"]
        between = F.substring(text, state["at"] + 1, F.greatest(s["begin"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], F.array(between, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    def cleaned(spans: Column, text: Column) -> Column:
        return F.aggregate(
            spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda state, s: cut(state, s, text),
            lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))))

    scanned = scan(docs.select(F.struct("*").alias("row"), F.col("text")))
    fields = {"text": F.when(F.size("spans") > 0, cleaned(F.col("spans"), F.col("text"))).otherwise(F.col("text"))}
    rows = scanned.withColumn("clean", fields["text"])
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.size("spans") > 0, F.length("clean").cast(kind)).otherwise(F.col("row")[c]).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return rows.select(*out)
