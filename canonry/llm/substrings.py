"""Substring deduplication with suffix automata over reference shards.

A word goes if some window of ``WINDOW`` words that covers it occurs earlier (smaller document
id, or the same document and an earlier start), judged on the input.

Every window chooses an anchor: the leftmost smallest hash among its ``GRAM``-word grams. Equal
windows choose equal anchors at the same place, so the corpus splits by anchor into shards
that can be treated apart. The windows of one place that share an anchor's
occurrence form a region, at most ``2 * WINDOW - GRAM`` words. Regions with equal words are settled
by their hash: all but the first go whole. Where an anchor has different regions, they are
streamed in order over the suffix automaton of the shard's earlier ones: the matching statistics
(longest match that ends at each word) tell the windows that occurred before, and the region joins
the reference. Only those regions' words are ever shuffled. The reference grows with
the corpus, so the automata are built where their shard's regions meet instead of being sent
to every task: each text meets the shards it has anchors in, and no others.

Hot passages: a batch keeps one row per anchor and region on its way to the shard; its other rows are settled on
the spot and dealt out by document. Of an anchor with more than ``HOT_REGIONS`` different regions
each window becomes a shard of its own (equal windows only): the first place of each window hash is a partial and
final minimum, and the windows at other places go. No words and no automaton are held for them, and the
rows of an anchor are told apart as they stream by, so no group is held that grows with the corpus.

Edge cases: null and empty texts have no words. Rows that repeat an id and a text are one
document and each get its row; one id with different texts counts as several documents in the order
of their texts. A null id sorts before all others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canonry.llm import textbytes
from canonry.session import cut_lineage

WINDOW = 20
GRAM = 8
HOT_REGIONS = 2_000

_PLACE = np.uint64(28)
_NO_ID = -(1 << 63)
_ROUTE = np.uint64(0x9FB21C651E98DF25)


class Automaton:
    """Suffix automaton of several sequences: every substring is a path from state 0."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The part of ``target`` that is one longer than ``state``: itself or a clone."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            target = self.next[last].get(symbol)
            if target is not None:
                last = self._split(last, symbol, target)
                continue
            new, state = self._state(self.length[last] + 1, 0, {}), last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, symbol, self.next[state][symbol])
            last = new

    def matches(self, sequence: list[int]) -> list[int]:
        """Matching statistics: length of the longest suffix of each prefix that occurs."""
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            out.append(size)
        return out


def earlier_windows(regions: list[list[int]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Of each region, in order, the runs (first window, number) of windows that an earlier region has."""
    automaton, out = Automaton(), []
    for i, words in enumerate(regions):
        runs: list[tuple[int, int]] = []
        if i:
            for end, size in enumerate(automaton.matches(words)):
                if size >= window:
                    start = end - window + 1
                    if runs and runs[-1][0] + runs[-1][1] == start:
                        runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                    else:
                        runs.append((start, 1))
        if i + 1 < len(regions) and sum(n for _, n in runs) < len(words) - window + 1:
            automaton.add(words)
        out.append(runs)
    return out


def regions(words: textbytes.Words, window: int = WINDOW, gram: int = GRAM):
    """Regions of a chunk's texts: text, anchor, hash, first word in the chunk, number of windows."""
    code, n = words.code, len(words.code)
    inside = textbytes.window_mask(words.first, n, window)
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = textbytes.window_codes(code, gram)
    low = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    size, span = 1, window - gram + 1
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    at = np.flatnonzero(inside)
    place = (low[at] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 0))))
    start, count = at[fresh], np.diff(np.append(fresh, len(at)))
    anchor = grams[place[fresh]]
    power, inverse = textbytes._powers(n + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(code * power[:n], dtype=np.uint64)))
    end = start + count + window - 1
    content = textbytes.mix((total[end] - total[start]) * inverse[start] + textbytes.mix(count.astype(np.uint64)))
    doc = np.searchsorted(words.first, start, side="right") - 1
    return doc, anchor, content, start, count


def _first_of_each(anchor, content, *order) -> np.ndarray:
    """True for the first row, by ``order``, of each anchor and content."""
    by = np.lexsort((*order[::-1], content, anchor))
    first = np.ones(len(by), dtype=bool)
    first[1:] = (anchor[by][1:] != anchor[by][:-1]) | (content[by][1:] != content[by][:-1])
    out = np.zeros(len(by), dtype=bool)
    out[by] = first
    return out


def _anchored(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Regions of (id, part, text); ``route`` deals them out, ``settled`` ones have an equal one before them."""
    names = ["route", "anchor", "content", "id", "part", "start", "n", "settled"]

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for chunk in textbytes.chunks(batch.column(2)):
                words = textbytes.words(chunk)
                doc, anchor, content, start, n = regions(words, window, gram)
                found.append((anchor, content, ids[chunk.first + doc], parts[chunk.first + doc],
                              start - words.first[doc], n))
            if not found:
                continue
            anchor, content, own, part, start, n = (np.concatenate(c) for c in zip(*found))
            settled = ~_first_of_each(anchor, content, own, part, start)
            route = np.where(settled, textbytes.mix(own.view(np.uint64) * _ROUTE + start.astype(np.uint64)), anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array(own), pa.array(part.astype(np.int32)), pa.array(start.astype(np.int32)),
                 pa.array(n.astype(np.int16)), pa.array(settled)], names=names)

    return texts.mapInArrow(run, "route long, anchor long, content long, id long, part int, start int, n short, settled boolean")


def _settle(anchored: DataFrame) -> DataFrame:
    """(id, part, start, n, anchor, hot): windows to remove (null anchor), and the regions, first of their
    content, of anchors that have several contents."""

    def rows(own, part, start, n, anchor, keep, hot):
        return pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(part), pa.array(start), pa.array(n.astype(np.int32)),
             pa.array(anchor, mask=np.full(len(anchor), not keep)), pa.array(hot)],
            names=["id", "part", "start", "n", "anchor", "hot"])

    def run(batches):
        # Rows come sorted by anchor, content and place. Of a batch's last anchor, which may go on in the next, the
        # first rows of the contents are held until they are over HOT_REGIONS: then it is known to be hot.
        last, known_hot = (None, None), None
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.int32, np.int16, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, content, own, part, start, n, settled = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            first = np.ones(len(anchor), dtype=bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            first[0] = (anchor[0], content[0]) != last
            last = (anchor[-1], content[-1])
            first &= ~settled
            if not first.all():
                yield rows(*(x[~first] for x in (own, part, start, n, anchor)), False, np.zeros(int((~first).sum()), dtype=bool))
            held = [np.concatenate((x, y[first])) for x, y in zip(held, (own, part, start, n, anchor))]
            _, where, size = np.unique(held[4], return_inverse=True, return_counts=True)
            size = size[where]
            hot = (size > HOT_REGIONS) | (held[4] == known_hot if known_hot is not None else False)
            ended = held[4] != anchor[-1]
            out = hot | ended & (size > 1)
            if out.any():
                yield rows(*(x[out] for x in held), True, hot[out])
            if hot[~ended].any():
                known_hot = anchor[-1]
            elif known_hot != anchor[-1]:
                known_hot = None
            held = [x[~ended & ~hot] for x in held]
        # Anchors whose first regions number two or more go on to the automata.
        if len(held[4]) > 1:
            yield rows(*held, True, np.zeros(len(held[4]), dtype=bool))

    # Settled rows pass through wherever they were dealt to: each is its own anchor.
    free = F.when(F.col("settled"), F.col("route")).otherwise(F.col("anchor"))
    sorted_rows = (anchored.repartition("route").select(free.alias("anchor"), "content", "id", "part", "start", "n", "settled")
                   .sortWithinPartitions("anchor", "content", "id", "part", "start"))
    return sorted_rows.mapInArrow(run, "id long, part int, start int, n int, anchor long, hot boolean")


def _with_words(texts: DataFrame, places: DataFrame, window: int, words_too: bool = True) -> DataFrame:
    """(key, id, part, start, words): the words of the regions at ``places``, windows of hot anchors one by one.

    Without ``words_too`` the words are left empty.
    """
    grouped = places.groupBy("id", "part").agg(
        F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("at"))
    joined = texts.join(grouped, ["id", "part"]).select("id", "part", "text", "at.anchor", "at.start", "at.n", "at.hot")

    def run(batches):
        for batch in batches:
            for chunk in textbytes.chunks(batch.column(2)):
                words = textbytes.words(chunk)
                keys, own, part, starts, sizes, content = [], [], [], [], [], []
                for i in range(chunk.n_docs):
                    row = chunk.first + i
                    fields = [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6)]
                    code = words.code[words.first[i]: words.first[i + 1]]
                    spans = []
                    for anchor, start, n, hot in zip(*(x.tolist() for x in fields)):
                        if hot:
                            each = textbytes.window_codes(code[start: start + n + window - 1], window).view(np.int64)
                            spans += [(int(k), start + j, window) for j, k in enumerate(each)]
                        else:
                            spans.append((anchor, start, n + window - 1))
                    for key, start, size in spans:
                        keys.append(key)
                        starts.append(start)
                        if not words_too:
                            size = 0
                        sizes.append(size)
                        content.append(code[start: start + size])
                    own += [batch.column(0)[row].as_py()] * len(spans)
                    part += [batch.column(1)[row].as_py()] * len(spans)
                flat = np.concatenate(content) if content else np.zeros(0, dtype=np.uint64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(own, pa.int64()), pa.array(part, pa.int32()), pa.array(starts, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                    names=["key", "id", "part", "start", "words"])

    return joined.mapInArrow(run, "key long, id long, part int, start int, words array<long>")


def _streamed(placed: DataFrame, window: int) -> DataFrame:
    """(id, part, start, n): windows of the regions of a key that its earlier regions have."""

    def judged(rows):
        ids, parts, starts, words = rows
        for own, part, start, runs in zip(ids, parts, starts, earlier_windows(words, window)):
            for first, n in runs:
                yield own, part, start + first, n

    def run(batches):
        key, held = None, ([], [], [], [])
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    if len(held[0]) > 1:
                        out += judged(held)
                    key, held = row[0], ([], [], [], [])
                for column, value in zip(held, row[1:]):
                    column.append(value)
            yield table(out)
        if len(held[0]) > 1:
            yield table(list(judged(held)))

    def table(rows):
        columns = list(zip(*rows)) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
            names=["id", "part", "start", "n"])

    dealt = placed.repartition("key").sortWithinPartitions("key", "id", "part", "start")
    return dealt.mapInArrow(run, "id long, part int, start int, n int")


def _repeated(placed: DataFrame) -> DataFrame:
    """(id, part, start, n): windows whose key has an earlier place; no group is brought together in one task."""
    # Read twice, not written: within one query the shuffled texts below are the same exchange.
    windows = placed.select("key", "id", "part", "start")
    first = windows.groupBy("key").agg(F.min(F.struct("id", "part", "start")).alias("at")).select("at.*")
    # By place, which is unique, and not by key: a hot window's rows are dealt out evenly.
    return windows.join(first, ["id", "part", "start"], "left_anti").select("id", "part", "start", F.lit(1).alias("n"))


def _kept(texts: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    """(id, part, n_words, n_removed, kept) of every text."""
    spans = gone.groupBy("id", "part").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    joined = texts.join(spans, ["id", "part"], "left").select("id", "part", "text", "at.start", "at.n")

    def run(batches):
        for batch in batches:
            for chunk in textbytes.chunks(batch.column(2)):
                words = textbytes.words(chunk)
                change = np.zeros(len(words.code) + 1, dtype=np.int32)
                for i in range(chunk.n_docs):
                    start = batch.column(3)[chunk.first + i]
                    if start.is_valid:
                        begin = start.values.to_numpy().astype(np.int64) + words.first[i]
                        np.add.at(change, begin, 1)
                        np.add.at(change, begin + batch.column(4)[chunk.first + i].values.to_numpy() + window - 1, -1)
                stays = np.cumsum(change[:-1]) == 0
                # Bytes that stay: those of the words, and one space before each but a text's first.
                begin, end = words.start[stays], words.end[stays]
                size = end - begin
                doc = words.doc[stays]
                lead = np.concatenate(([False], doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, dtype=bool)
                width = size + lead
                to = np.concatenate(([0], np.cumsum(width)))
                data = np.full(to[-1], 0x20, dtype=np.uint8)
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                data[np.repeat(to[:-1] + lead, size) + inner] = chunk.data[np.repeat(begin, size) + inner]
                per_doc = np.bincount(doc, minlength=chunk.n_docs)
                offsets = to[np.concatenate(([0], np.cumsum(per_doc)))].astype(np.int64)
                kept = pa.Array.from_buffers(pa.large_string(), chunk.n_docs, [None, pa.py_buffer(offsets.tobytes()),
                                                                               pa.py_buffer(data.tobytes())])
                part = slice(chunk.first, chunk.first + chunk.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(words.counts.astype(np.int64)),
                     pa.array(words.counts - per_doc), kept.cast(pa.string())],
                    names=["id", "part", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "id long, part int, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of (doc_id, text): the words left, joined by one space."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = bool(rows.groupBy("id").count().filter("count > 1").limit(1).count())
    if repeated:
        order = W.partitionBy("id").orderBy("text")
        texts = cut_lineage(rows.distinct().withColumn("part", F.row_number().over(order)), name="texts")
    else:
        texts = rows.withColumn("part", F.lit(0))
    texts = texts.select("id", "part", "text")
    found = cut_lineage(_settle(_anchored(texts, window, gram)), name="regions")
    placed = _with_words(texts, found.filter("anchor IS NOT NULL AND NOT hot"), window)
    gone = found.filter("anchor IS NULL").select("id", "part", "start", "n").union(_streamed(placed, window))
    hot = found.filter("hot")
    if hot.limit(1).count():
        gone = gone.union(_repeated(_with_words(texts, hot, window, words_too=False)))
    result = _kept(texts, gone, window)
    if repeated:
        every = rows.join(texts.withColumnRenamed("id", "i").withColumnRenamed("text", "t"),
                          (F.col("id") == F.col("i")) & (F.col("text") == F.col("t"))).select("id", "part")
        result = every.join(result, ["id", "part"])
    return result.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
