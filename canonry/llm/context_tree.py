"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions; each decision's node (the bits before it) has a
tree of contexts, the last 0 to ``DEPTH`` bytes. Every tree node estimates its decision by
Krichevsky-Trofimov, and the weighted probability of a node mixes its own estimate's block probability
with the product of its children's in equal parts. Trained on counts, the prediction in a context is

    P_d(bit) = w_d KT_d(bit) + (1 - w_d) P_{d+1}(bit),   w_d = KT block / (2 weighted block),

from depth 0 down to ``DEPTH`` or to the last context that training met (there a node's own
estimate stands). Texts are scored in lower case (A to Z) and end with byte 255, which no UTF-8 text
holds and which also fills the context at the start, so the score is a proper probability.

On Spark: each task counts the distinct (context, byte) grams of its texts; the counts are summed
by gram with a map-side combine; the tree below each pair of last bytes is one group of contexts,
built where its grams are; depths 1 and 0 are merged from at most 65,280 sums (a bound of the byte
alphabet, not of the data). The result is one value per gram that occurs. The unigram base goes the
same way, a value per word.

Scoring is one plan at every size. Rows are cut into blocks of about ``BLOCK_BYTES`` of text; a block's
distinct grams and words are summed to the counts of the model, joined with the model's values and sent back to their block, where all its texts are scored. A frequent gram so has one row a
block, whatever the number of its occurrences, and no task or driver holds the model.

Edge cases: a null or empty text is its end alone. Repeated rows are each counted and each get a row (a
null id trains). Without training texts every bit has probability 1/2. A text longer than a block is
counted and scored in pieces of its block. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.llm import textbytes
from canonry.session import arrow_batches, cut_lineage

DEPTH = 5
END = 0xFF
#: Text that is scored together: its distinct grams are looked up once.
BLOCK_BYTES = 32 << 20
#: Keys that a task holds before it sums them; it passes them on where more than two thirds are distinct.
FLUSH_KEYS = 2_000_000
#: Bytes of text, and grams, that are worked on at a time.
CHUNK_BYTES = 1 << 20
CHUNK_GRAMS = 1 << 17
#: Megabytes of an Arrow batch of texts, and rows of one of keys.
BATCH_MB = 2
BATCH_KEYS = 1 << 15

_GRAM, _WORD = 0, 1
_END_WORD = np.uint64(0x5851F42D4C957F2D)
_LOG_HALF = np.log(0.5)


def gram_codes(chunk: textbytes.Chunk, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Code of every byte of a chunk's texts with the ``depth`` bytes before it, ends included, and
    each text's first. Lowest byte: the coded one; then the last byte before it, and so on."""
    size = np.diff(chunk.offsets)
    n = chunk.n_docs
    stream = np.full(len(chunk.data) + (n + 1) * depth, END, dtype=np.uint8)
    doc = np.repeat(np.arange(n), size)
    stream[np.arange(len(chunk.data)) + (doc + 1) * depth] = chunk.data
    # Read backwards, the eight bytes from a place on are the coded byte and those before it.
    back = np.concatenate((stream[::-1], np.zeros(8, dtype=np.uint8)))
    code = np.lib.stride_tricks.as_strided(back[:8].view("<u8"), (len(stream) - depth,), (1,))[::-1]
    code = code & np.uint64((1 << 8 * (depth + 1)) - 1)
    # Of the fill between two texts only the first byte is coded: the end of the text before it.
    begin = chunk.offsets[:-1] + np.arange(n) * depth
    keep = np.zeros(len(code) + 1, dtype=np.int8)
    np.add.at(keep, begin, 1)
    np.add.at(keep, begin + size + 1, -1)
    return code[np.cumsum(keep[:-1]).astype(bool)], np.concatenate(([0], np.cumsum(size + 1)))


def word_codes(chunk: textbytes.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words and text ends, and each text's first."""
    words = textbytes.words(chunk)
    first = words.first + np.arange(chunk.n_docs + 1)
    code = np.full(first[-1], _END_WORD, dtype=np.uint64)
    code[np.arange(len(words.code)) + words.doc] = words.code
    return code, first


def runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal codes together, where each run of them starts, and the runs' codes."""
    bits = np.uint64(max(1, len(code).bit_length()))
    place = np.uint64((1 << int(bits)) - 1)
    packed = textbytes.mix(code) & ~place | np.arange(len(code), dtype=np.uint64)
    packed.sort()
    order = (packed & place).astype(np.int64)
    code = code[order]
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else order
    return order, start, code[start]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of ``parts`` (emptied) and their sums, worked out for a quarter of the keys at a time."""
    all_keys, all_n = (np.concatenate(part) for part in zip(*parts))
    parts.clear()
    found = []
    for low in range(4):
        of = np.flatnonzero(all_keys & np.uint64(3) == low)
        of = of[np.argsort(all_keys[of], kind="stable")]
        keys = all_keys[of]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else of
        found.append((keys[start], np.add.reduceat(all_n[of], start) if len(keys) else all_n[of]))
    del all_keys, all_n
    keys, n = (np.concatenate(part) for part in zip(*found))
    return keys, n


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(block, rows): consecutive rows as blocks of at most ``block_bytes`` and one text more, written.

    Nothing is shuffled: small input partitions are coalesced to about a block each, larger ones cut.
    ``rows`` packs some rows of a block (a chunk's, compressed), since texts travel to their block's values.
    """
    size = int(texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    texts = texts.coalesce(max(1, -(-size // block_bytes)))

    def run(batches):
        part, done, piece_bytes = TaskContext.get().partitionId(), 0, min(block_bytes, textbytes.CHUNK_BYTES)
        for batch in batches:
            if not batch.num_rows:
                continue
            end = done + np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            begin = np.concatenate(([done], end[:-1]))
            done = int(end[-1])
            piece = np.stack((begin // block_bytes, begin % block_bytes // piece_bytes))
            edge = [0, *(np.flatnonzero(np.diff(piece).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(edge[:-1], edge[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + int(piece[0, i])]),
                                                  pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])
        textbytes.give_back()

    with arrow_batches(texts.sparkSession, BATCH_MB):
        return cut_lineage(texts.mapInArrow(run, "block long, rows binary"), name="blocks")


def _unpacked(rows):
    """Batches of (doc_id, train, text) of packed rows."""
    for packed in rows:
        yield from pa.ipc.open_stream(packed.as_buffer())


def _counts(blocks: DataFrame, depth: int) -> DataFrame:
    """(block, kind, key, n) of ``_blocks``: a block's distinct grams and words with their training counts.
    A block that is read by two tasks, or has very many keys, may give a key twice."""

    def counted(code: np.ndarray, weight: int):
        code = np.sort(code)
        start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
        return code[start], np.diff(np.append(start, len(code))) * weight

    def run(batches):
        held, now = {_GRAM: [], _WORD: []}, None

        def emit(kind: int):
            keys, n = _summed(held[kind])
            held[kind] = []
            for i in range(0, len(keys), BATCH_KEYS):
                part = keys[i: i + BATCH_KEYS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), now, dtype=np.int64)), pa.array(np.full(len(part), kind, dtype=np.int32)),
                     pa.array(part.view(np.int64)), pa.array(n[i: i + BATCH_KEYS].astype(np.int64))],
                    names=["block", "kind", "key", "n"])

        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1))):
                if block != now:
                    for kind in [k for k, parts in held.items() if parts]:
                        yield from emit(kind)
                    now = block
                train = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for chunk in textbytes.chunks(rows.column(2), lower=True, limit=CHUNK_BYTES):
                    used = train[chunk.first: chunk.first + chunk.n_docs]
                    for kind, (code, first) in ((_GRAM, gram_codes(chunk, depth)), (_WORD, word_codes(chunk))):
                        learnt = np.repeat(used, np.diff(first))
                        held[kind] += [counted(code[learnt], 1), counted(code[~learnt], 0)]
                        if sum(len(k) for k, _ in held[kind]) > FLUSH_KEYS:
                            held[kind] = [_summed(held[kind])]
                            if len(held[kind][0][0]) > 2 * FLUSH_KEYS // 3:
                                yield from emit(kind)
        for kind in [k for k, parts in held.items() if parts]:
            yield from emit(kind)
        textbytes.give_back()

    return blocks.mapInArrow(run, "block long, kind int, key long, n long")


_SMALL = 1 << 14
#: ln gamma(n + 1/2) and ln gamma(n + 1) of small n.
_HALVES = np.concatenate(([0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(_SMALL) + 0.5))))
_WHOLES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))))


def _log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """ln gamma(n + plus) of whole n, plus 1/2 or 1: a table, and Stirling's series beyond it."""
    table = _HALVES if plus == 0.5 else _WHOLES
    out = table[np.minimum(n, _SMALL).astype(np.int64)]
    large = n > _SMALL
    if large.any():
        x = n[large] + plus
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return out


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(n0, 0.5) + _log_gamma(n1, 0.5) - _log_gamma(n0 + n1, 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: key (context, decision), counts, log weighted probability, each node's parent above."""

    def __init__(self, keys, n0, n1, below=None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.block = kt_block(n0, n1)
        self.weighted = self.block if below is None else np.logaddexp(_LOG_HALF + self.block, _LOG_HALF + below)
        self.parent = None

    def lift(self, depth: int) -> "Level":
        """The level above, its contexts cut to ``depth`` bytes: counts and weighted probabilities of the children."""
        keys, where = np.unique(_parents(self.keys, depth), return_inverse=True)
        self.parent = where
        sums = [np.bincount(where, weights=x, minlength=len(keys)) for x in (self.n0, self.n1, self.weighted)]
        return Level(keys, *sums)


def _parents(key: np.ndarray, depth: int) -> np.ndarray:
    """Node keys with their contexts cut to the last ``depth`` bytes."""
    return ((key >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | (key & np.uint64(0xFF))


def tree(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict[int, Level], np.ndarray, np.ndarray]:
    """Levels ``depth`` to ``top`` over grams with training counts, and each gram's eight decisions: node at
    ``depth`` and bit (8 x grams). Grams of count 0 have nodes too; they change no probability."""
    byte = (code & np.uint64(0xFF)).astype(np.int64)
    decision = np.stack([(1 << k) | (byte >> (8 - k)) for k in range(8)])
    bit = np.stack([byte >> (7 - k) & 1 for k in range(8)])
    key = (code & ~np.uint64(0xFF))[None, :] | decision.astype(np.uint64)
    keys, where = np.unique(key.reshape(-1), return_inverse=True)
    weight = np.tile(n.astype(float), 8)
    n1 = np.bincount(where, weights=weight * bit.reshape(-1), minlength=len(keys))
    levels = {depth: Level(keys, np.bincount(where, weights=weight, minlength=len(keys)) - n1, n1)}
    for d in range(depth - 1, top - 1, -1):
        levels[d] = levels[d + 1].lift(d)
    return levels, where.reshape(key.shape), bit


def predict(levels: dict[int, Level], depth: int) -> np.ndarray:
    """Probability of a 1 at every node of the deepest level, mixed along its path from depth 0."""
    for d in range(depth + 1):
        level = levels[d]
        own = (level.n1 + 0.5) / (level.n0 + level.n1 + 1.0)
        share = np.exp(np.minimum(_LOG_HALF + level.block - level.weighted, 0.0))
        # settled: mixed in above; left: weight not yet given away; end: the value if the path ends here.
        settled, left, end = (x[level.parent] for x in (settled, left, end)) if d else (0.0, 1.0, 0.5)
        end = np.where(level.n0 + level.n1 > 0, settled + left * own, end)
        settled, left = settled + left * share * own, left * (1 - share)
    return end


def _gram_values(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value) of (key, n): log10 probability of every gram's byte."""
    by_pair = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))
    parted = grams.repartition(by_pair)

    def trees(batches):
        """The partition's grams and counts, whole pairs together: about ``CHUNK_GRAMS`` at a time, or one pair's."""
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        keys, n = map(np.concatenate, zip(*parts))
        pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
        order = np.argsort(pair, kind="stable")
        keys, n, pair = keys[order], n[order], pair[order]
        edge = np.append(np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))), len(pair))
        at = 0
        while at < len(edge) - 1:
            end = max(int(np.searchsorted(edge, edge[at] + CHUNK_GRAMS, side="right")) - 1, at + 1)
            yield keys[edge[at]: edge[end]], n[edge[at]: edge[end]]
            at = end

    def sums(batches):
        for found in trees(batches):
            level = tree(*found, depth, 2)[0][2]
            up, where = np.unique(_parents(level.keys, 1), return_inverse=True)
            total = [np.bincount(where, weights=x, minlength=len(up)) for x in (level.n0, level.n1, level.weighted)]
            yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), *map(pa.array, total)],
                                             names=["key", "n0", "n1", "below"])

    # At most 256 x 255 nodes of depth 1, whatever the data.
    top = (parted.mapInArrow(sums, "key long, n0 double, n1 double, below double").groupBy("key")
           .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toPandas())
    keys = top["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    one = Level(keys[order], *(top[c].to_numpy(dtype=float)[order] for c in ("n0", "n1", "below")))
    upper = {1: one, 0: one.lift(0)}

    def values(batches):
        for found in trees(batches):
            levels, where, bit = tree(*found, depth, 2)
            levels[2].parent = np.searchsorted(one.keys, _parents(levels[2].keys, 1))
            ones = predict(levels | upper, depth)
            value = np.log10(np.where(bit == 1, ones[where], 1 - ones[where])).sum(axis=0)
            for i in range(0, len(value), BATCH_KEYS):
                yield pa.RecordBatch.from_arrays([pa.array(found[0][i: i + BATCH_KEYS].view(np.int64)),
                                                  pa.array(value[i: i + BATCH_KEYS])], names=["key", "value"])

    return parted.mapInArrow(values, "key long, value double")


def _word_values(words: DataFrame) -> tuple[DataFrame, int]:
    """(key, value, known) of (key, n), and the number of training words."""
    stats = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total, distinct = int(stats[0] or 0), int(stats[1])
    value = F.log10((F.col("n") + 0.5) / (total + 0.5 * (distinct + 1)))
    return words.select("key", value.alias("value"), (F.col("n") > 0).alias("known")), total


def _scorer(depth: int):
    """Function of a block's texts and its keys' values, giving a row for every text."""
    names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"]

    def model(found: pa.Table, kind: int):
        found = found.filter(pc.equal(found["kind"], kind))
        keys, value, known = (found[c].to_numpy() for c in ("key", "value", "known"))
        order = np.argsort(keys.view(np.uint64))
        return keys.view(np.uint64)[order], value[order], known[order]

    def looked_up(code: np.ndarray, keys: np.ndarray, *columns: np.ndarray):
        order, start, distinct = runs(code)
        at, times = np.searchsorted(keys, distinct), np.diff(np.append(start, len(code)))
        for column in columns:
            each = np.empty(len(code), dtype=column.dtype)
            each[order] = np.repeat(column[at], times)
            yield each

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        grams, words = model(found, _GRAM), model(found, _WORD)
        del found
        textbytes.give_back()
        parts = []
        for batch in _unpacked(x for part in texts["rows"].chunks for x in part):
            for chunk in textbytes.chunks(batch.column(2), lower=True, limit=CHUNK_BYTES):
                code, first = gram_codes(chunk, depth)
                (value,) = looked_up(code, grams[0], grams[1])
                code, word_first = word_codes(chunk)
                base, known = looked_up(code, *words)
                part = slice(chunk.first, chunk.first + chunk.n_docs)
                parts.append(pa.RecordBatch.from_arrays([
                    batch.column(0)[part], batch.column(1)[part], pa.array(np.diff(word_first)),
                    pa.array(np.add.reduceat(known.astype(np.int64), word_first[:-1])),
                    pa.array(np.add.reduceat(base, word_first[:-1])), pa.array(np.add.reduceat(value, first[:-1])),
                    pa.array(np.diff(first))], names=names))
        return pa.Table.from_batches(parts)

    return run


def score(docs: DataFrame, train, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row.

    ``train``: boolean column, the rows to learn from. Scores are log10 probabilities of the whole
    text; ``-score / log10(2) / n_bytes`` is the code length in bits per byte (the end counts as one).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = _blocks(texts, block_bytes)
    keys = _counts(blocks, depth)  # made twice: less than a table of them costs
    # A task's keys are distinct already: they are dealt out first, else Spark would hash them all on both sides.
    counted = cut_lineage(keys.select("kind", "key", "n").repartition("kind", "key").groupBy("kind", "key")
                          .agg(F.sum("n").alias("n")), name="counts")
    grams = _gram_values(counted.filter(F.col("kind") == _GRAM).select("key", "n"), depth)
    words, total = _word_values(counted.filter(F.col("kind") == _WORD).select("key", "n"))
    values = cut_lineage(grams.select(F.lit(_GRAM).alias("kind"), "key", "value", F.lit(True).alias("known"))
                         .union(words.select(F.lit(_WORD), "key", "value", "known")), name="values")
    found = keys.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value", "known")
    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    # Sorted by block in each partition: with a few times as many partitions as blocks, not many blocks at once.
    n = 4 * max(1, blocks.select("block").distinct().count())
    scored = (blocks.repartition(n, "block").groupBy("block").cogroup(found.repartition(n, "block").groupBy("block"))
              .applyInArrow(_scorer(depth), schema))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
