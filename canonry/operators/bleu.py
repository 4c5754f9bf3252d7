"""Corpus BLEU as aggregations (Papineni et al. 2002; corpus form as in Post 2018).

Per row and order n: clipped matches ``sum_g min(count_hyp(g), count_ref(g))`` and
``max(0, len - n + 1)`` hypothesis n-grams, counted inside tasks (Arrow batches, numpy) and summed
over the corpus. Smoothing 'exp'; brevity penalty over corpus lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import split_whitespace

# The '13a' tokenizer (mteval-v13a) as four regex rules, applied in order
# after removing '<skipped>', joining '-\n' and replacing newlines, and unescaping
# &quot; &amp; &lt; &gt;.
RULES_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def tokenize_13a(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    c = F.replace(F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")),
                  F.lit("\n"), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))  # the rules see a blank at both ends
    for pat, rep in RULES_13A:
        c = F.regexp_replace(c, pat, rep)
    return c


def _tokens(col, tokenize: str) -> Column:
    if tokenize == "none":
        return split_whitespace(col)
    if tokenize == "13a":
        return split_whitespace(tokenize_13a(col))
    raise ValueError(f"tokenize must be 'none' or '13a', not {tokenize!r}")


#: Tokens of both sides counted at a time inside a task (or one longer row).
SLICE_TOKENS = 1 << 18


def _matches(hyp: pa.Array, ref: pa.Array, max_n: int) -> np.ndarray:
    """sys_len, ref_len, total_1..N, correct_1..N of rows given as lists of tokens (null: none).

    A gram is coded by the code of the gram without its last token, which starts with that of its row, and its last token: codes are exact.
    """
    lens = [np.asarray(pc.fill_null(pc.list_value_length(c), 0)) for c in (hyp, ref)]
    out = np.zeros((2, max_n), dtype=np.int64)
    n_hyp, n_ref = (int(x.sum()) for x in lens)
    if n_hyp + n_ref:
        token = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
        words = int(token.max()) + 1
        each = np.concatenate(lens)
        left = np.repeat(np.cumsum(each), each) - np.arange(len(token))  # tokens from here to the text's end
        code = np.repeat(np.tile(np.arange(len(hyp)), 2), each)
        for n in range(1, max_n + 1):
            start = np.flatnonzero(left >= n)
            distinct, gram = np.unique(code[start] * words + token[start + n - 1], return_inverse=True)
            code[start] = gram
            cut = np.searchsorted(start, n_hyp)
            out[0, n - 1] = cut
            out[1, n - 1] = np.minimum(*[np.bincount(g, minlength=len(distinct)) for g in (gram[:cut], gram[cut:])]).sum()
    return np.concatenate(([n_hyp, n_ref], out.reshape(-1)))


def bleu_statistics(df: DataFrame, hyp_col: str, ref_col: str, id_cols=None, max_n: int = 4,
                    tokenize: str = "13a") -> DataFrame:
    """One row: sys_len, ref_len, correct_1..N, total_1..N.

    Every row is a pair of its own, whatever its ``id_cols``. Its n-grams are counted and clipped in the task that
    holds it, slice by slice, and a batch of rows leaves one row of sums: no n-gram is shuffled.
    """
    tok = df.select(_tokens(hyp_col, tokenize).alias("h"), _tokens(ref_col, tokenize).alias("r"))
    names = ["sys_len", "ref_len", *[f"total_{n}" for n in range(1, max_n + 1)], *[f"correct_{n}" for n in range(1, max_n + 1)]]
    limit = SLICE_TOKENS

    def count(batches):
        for b in batches:
            h, r = b.column(0), b.column(1)
            size = np.cumsum(sum(np.asarray(pc.fill_null(pc.list_value_length(c), 0)).astype(np.int64) for c in (h, r)))
            total, at = np.zeros(len(names), dtype=np.int64), 0
            while at < b.num_rows:
                done = size[at - 1] if at else 0
                to = max(int(np.searchsorted(size, done + limit, side="right")), at + 1)
                total += _matches(h[at:to], r[at:to], max_n)
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in total], names=names)

    sums = tok.mapInArrow(count, ", ".join(f"{c} long" for c in names))
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])


def corpus_bleu(df: DataFrame, hyp_col: str = "hypothesis", ref_col: str = "reference", id_cols="row_id",
                max_n: int = 4, tokenize: str = "13a") -> DataFrame:
    """One row: bleu (0-100), brevity_penalty, sys_len, ref_len, correct_n, total_n."""
    st = bleu_statistics(df, hyp_col, ref_col, id_cols, max_n, tokenize)
    logs, zeros = [], F.lit(0)
    for n in range(1, max_n + 1):
        c, t = F.col(f"correct_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when(c == 0, 1).otherwise(0)
        p = F.when(c > 0, F.lit(100.0) * c / t).otherwise(F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t))
        logs.append(F.when(t > 0, F.log(p)))
    any_total_zero = F.lit(False)
    for n in range(1, max_n + 1):
        any_total_zero = any_total_zero | (F.col(f"total_{n}") == 0)
    no_match = F.lit(True)
    for n in range(1, max_n + 1):
        no_match = no_match & (F.col(f"correct_{n}") == 0)
    bp = (F.when(F.col("sys_len") >= F.col("ref_len"), F.lit(1.0))
          .when(F.col("sys_len") == 0, F.lit(0.0))
          .otherwise(F.exp(F.lit(1.0) - F.col("ref_len") / F.col("sys_len"))))
    mean_log = sum(logs[1:], logs[0]) / F.lit(float(max_n))
    score = F.when(no_match | any_total_zero, F.lit(0.0)).otherwise(bp * F.exp(mean_log))
    return st.select(F.round(score, 6).alias("bleu"), F.round(bp, 9).alias("brevity_penalty"),
                     "sys_len", "ref_len",
                     *[f"correct_{n}" for n in range(1, max_n + 1)], *[f"total_{n}" for n in range(1, max_n + 1)])
