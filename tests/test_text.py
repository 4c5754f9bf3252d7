import random
import re

from pyspark.sql import functions as F

from canonry.functions import text as T


def py_norm(s, mask=False):
    s = s.lower()
    if mask:
        s = re.sub(r"\d+", "#", s)
    return re.sub(r"\s+", " ", s).strip()


def test_normalize_literals(spark):
    df = spark.createDataFrame([("　 A\u001c\tB ",), ("",), ("  \t ",), (None,)], "t string")
    got = [r.n for r in df.select(T.normalize_text("t").alias("n")).collect()]
    assert got == ["a b", "", "", None]


def test_normalize_matches_python_on_random_unicode(spark):
    rnd = random.Random(7)
    ws = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    pool = ws + list("aBcD1٣9 xyzÉ") + [chr(rnd.randrange(0x20, 0x3000)) for _ in range(200)]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.normalize_text("t").alias("n"), T.normalize_text("t", True).alias("m")).collect()
    for r in rows:
        assert r.n == py_norm(r.t), repr(r.t)
        assert r.m == py_norm(r.t, True), repr(r.t)


def test_word_terms_equal_split_of_normalised(spark):
    texts = ["  Hello World \t again ", "", " x", "a  b\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in T.explode_terms(df, ["id"], "t", "word", with_pos=True).collect():
        got.setdefault(r.id, []).append((r.pos, r.term))
    for i, t in enumerate(texts):
        assert [w for _, w in sorted(got.get(i, []))] == py_norm(t).split()


def test_lines_trim_and_drop_blank(spark):
    df = spark.createDataFrame([(" a \n\n b",), ("﻿x \n\u001cy",)], "t string")
    got = [r.l for r in df.select(T.split_lines("t").alias("l")).collect()]
    assert got[0] == ["a", "b"]
    assert got[1] == ["x", "\u001cy"]  # JS trim keeps U+001C


def test_strip_token_and_char_ngrams(spark):
    df = spark.createDataFrame([("<pad> ab <pad>c\n",), ("ab",), ("",)], "t string")
    r = df.select(T.strip_token("t").alias("s"), T.char_ngrams("t", 3).alias("g")).collect()
    assert r[0].s == "ab c"
    assert r[1].g == ["ab"] and r[2].g == []
    assert spark.createDataFrame([("abcd",)], "t string").select(T.char_ngrams("t", 3)).first()[0] == ["abc", "bcd"]


def test_split_whitespace_like_python(spark):
    texts = ["a b  c", "   ", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.split_whitespace("t")).collect()] == [t.split() for t in texts]


def test_whitespace_classes_equal_python_and_js_on_every_code_point(spark):
    """The explicit classes match exactly Python's isspace set and JS trim's set."""
    js = {0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
          0x202F, 0x205F, 0x3000, 0xFEFF}
    rows = (spark.createDataFrame([(c, chr(c)) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF],
                                  "cp int, c string")
            .select("cp", F.col("c").rlike("(?U)^" + T.PY_WHITESPACE + "$").alias("py"),
                    F.col("c").rlike("^" + T.JS_TRIM_CLASS + "$").alias("js"))
            .where(F.col("py") | F.col("js")).collect())
    assert {r.cp for r in rows if r.py} == {c for c in range(0x110000) if chr(c).isspace()}
    assert {r.cp for r in rows if r.js} == js


def test_exploded_char_ngrams_equal_the_array_form(spark):
    texts = ["abcd", "ab", "", None, "  Héllo\tWorld ", "x", "ab𝔘cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for normalize in (False, True):
        got = {}
        for r in T.explode_terms(df, [F.col("id").alias("_id")], "t", "char_ngram", 3, normalize,
                                 with_pos=True).collect():
            got.setdefault(r._id, []).append((r.pos, r.term))
        arrays = {r.id: r.g for r in df.select("id", T.tokenize_terms("t", "char_ngram", 3, normalize).alias("g"))
                  .collect()}
        for i in range(len(texts)):
            assert [g for _, g in sorted(got.get(i, []))] == (arrays[i] or []), (normalize, texts[i])
