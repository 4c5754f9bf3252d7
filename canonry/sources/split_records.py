"""Records of large text files whose separator may also stand inside quotes, read in many tasks a file.

Spark's text source splits a file at a separator (``lineSep``), which may fall inside a quoted string. Whether it does
depends on all quotes before it; but the number of quotes modulo 2 adds up: a first pass counts each split's quotes with
built-in functions, their sums over the splits before give every split's state at its start, and a second pass
joins chunks to records from there on. A record that spans splits comes as pieces, at most two a split, which are joined by
file and order. Nothing but one row per split reaches the driver.

``json_entries`` reads ``{"data": {"<key>": {...}, ...}}`` objects (entries are flat objects or hold arrays of scalars), ``csv_rows``
quoted CSV with line breaks inside values. Text of another shape stops the job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["_file", "_blk"]
_SCHEMA = "_file string, _blk long, _i long, record string, opens boolean, closes boolean"


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"), F.col("value").alias("chunk"))


def _quotes(escapes: bool):
    """Quotes of a chunk; with ``escapes``, those after a backslash do not count. No separator used here can follow a lone
    backslash, so every chunk starts outside an escape."""
    text = F.regexp_replace("chunk", r"(?s)\\.", "") if escapes else F.col("chunk")
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def split_records(spark: SparkSession, path: str, separator: str, escapes: bool):
    """(records, splits): ``records`` has _file, _blk, _i (order inside a split) and the record without its last separator;
    ``splits`` a dict of (file, block start) to (inside quotes at its start, chunks, chunks that are blank)."""
    chunks = _chunks(spark, path, separator)
    blank = F.sum(F.when(F.col("chunk").rlike(r"^\s*$"), 1).otherwise(0))
    seen = chunks.groupBy(*_SPLIT).agg((F.sum(_quotes(escapes)) % 2).alias("odd"), F.count(F.lit(1)).alias("n"), blank.alias("blank"))
    splits: dict[tuple[str, int], tuple[bool, int, int]] = {}
    open_at: dict[str, bool] = {}
    for r in sorted(seen.collect(), key=lambda r: (r["_file"], r["_blk"])):
        inside = open_at.get(r["_file"], False)
        splits[r["_file"], r["_blk"]] = (inside, r["n"], r["blank"])
        open_at[r["_file"]] = inside ^ bool(r["odd"])
    unclosed = [f for f, inside in open_at.items() if inside]
    if unclosed:
        raise ValueError(f"unclosed quote in {unclosed[0]}")
    start = {k: v[0] for k, v in splits.items()}
    counted = chunks.withColumn("odd", (_quotes(escapes) % 2) == 1)

    def join(batches):
        at, inside, parts, opens, i = None, False, [], False, 0
        out: list[list] = [[] for _ in range(6)]

        def put(closes):
            for column, v in zip(out, (*at, i, separator.join(parts), opens, closes)):
                column.append(v)

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=[
                "_file", "_blk", "_i", "record", "opens", "closes"])
            for c in out:
                c.clear()
            return done

        for b in batches:
            for file, blk, chunk, odd in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if (file, blk) != at:
                    if parts:
                        put(False)
                    at, parts, i = (file, blk), [], 0
                    inside = start[at]
                    opens = not inside  # a piece that goes on from the split before does not open a record
                parts.append(chunk)
                inside ^= odd
                if not inside:
                    put(True)
                    parts, opens, i = [], True, i + 1
            yield batch()
        if parts:
            put(False)
        yield batch()

    found = counted.mapInArrow(join, _SCHEMA)
    # Null for pieces: what is made of a record may be computed before the filter.
    whole = found.where("opens AND closes").select(*_SPLIT, "_i", F.when(F.col("opens") & F.col("closes"), F.col("record")).alias("record"))
    pieces = found.where("NOT (opens AND closes)")
    order = Window.partitionBy("_file").orderBy("_blk", "_i")
    runs = pieces.withColumn("run", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order))
    merged = runs.groupBy("_file", "run").agg(
        F.min(F.struct("_blk", "_i")).alias("at"), F.array_sort(F.collect_list(F.struct("_blk", "_i", "record"))).alias("all"))
    merged = merged.select("_file", "at._blk", "at._i", F.array_join(F.transform("all", lambda p: p["record"]), separator).alias("record"))
    return whole.unionByName(merged), splits


# ------------------------------------------------------------------ one JSON object
_HEAD = r'\{\s*"data"\s*:\s*\{\s*'
_ENTRY = r'(?s)^[\s,]*+(?:' + _HEAD + r')?"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:\s*(\{.*)$'
_NO_ENTRY = r"(?s)^\s*(?:" + _HEAD + r")?$"


def json_entries(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(key, value, _file, _blk, _i) of every entry under ``data`` of the files' objects; a repeated key gives each of its entries."""
    records, splits = split_records(spark, path, "}", escapes=True)
    closed: dict[str, int] = {}
    for (file, _), (_, _, blank) in splits.items():
        closed[file] = closed.get(file, 0) + blank
    # The brace of data and that of the object end chunks that hold nothing else (an empty ``data`` has one only).
    is_entry = ~F.col("record").rlike(_NO_ENTRY)
    entries = records.where(is_entry)
    cut = sorted(f for f, n in closed.items() if n < 1)
    if cut:
        raise ValueError(f"object is not closed in {cut[0]}")
    key, value = F.regexp_extract("record", _ENTRY, 1), F.regexp_extract("record", _ENTRY, 2)
    # Guarded by itself: the parsed value may be computed before the filter above it.
    text = F.when(is_entry & (value == ""), F.raise_error(F.concat(F.lit("no entry of an object: "), F.substring("record", 1, 200)))).when(
        is_entry, F.concat(F.lit('{"key":"'), key, F.lit('","value":'), value, F.lit("}}")))
    parsed = F.from_json(text, f"key string, value struct<{','.join(fields)}>", {"mode": "FAILFAST"})
    return entries.select(parsed.alias("p"), *_SPLIT, "_i").select("p.key", "p.value", *_SPLIT, "_i")


def write_json_objects(df: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """Rows as one object a task, ``{"data": {"<key>": {other columns}, ...}}``; ``files`` sets how many objects."""
    value = F.struct(*[c for c in df.columns if c != key])
    pair = F.to_json(F.map_from_arrays(F.array(F.col(key).cast("string")), F.array(value)))
    lines = df.select(F.substring(pair, F.lit(2), F.length(pair) - 2).alias("value"))

    def wrap(batches):
        first = True
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                out = [("" if first and k == 0 else ",") + t for k, t in enumerate(texts)]
                if first:
                    out[0] = '{"data": {' + out[0]
                first = False
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(['{"data": {}}' if first else "}}"], pa.string())})

    (lines.coalesce(files) if files else lines).mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


# ------------------------------------------------------------------ CSV
def csv_rows(spark: SparkSession, path: str, schema: str, options: dict[str, str]) -> DataFrame:
    """Rows of quoted CSV files with a header each; a record's line breaks inside quotes are kept."""
    records, _ = split_records(spark, path, "\n", escapes=False)
    body = records.where("NOT (_blk = 0 AND _i = 0) AND record NOT IN ('', '\\r')")
    line = F.regexp_replace("record", r"\r$", "")
    parsed = F.from_csv(line, schema, {**{k: v for k, v in options.items() if k != "header"}, "mode": "FAILFAST"})
    return body.select(parsed.alias("p")).select("p.*")
