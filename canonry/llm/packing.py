"""Packing: documents cut into sequences of at most ``window`` tokens, order kept.

The tokens of consecutive documents form one stream. A dynamic programme chooses where the
stream is cut: at document ends (free), at sentence ends (``sentence_cost``) and, at one word end in
each ``STEP`` tokens without these, inside a sentence (``token_cost``); a stretch of two steps without any of these
may be cut every ``STEP`` tokens. A sequence costs its padding plus
the penalty of the cut that ends it,

    best[j] = penalty(j) + window - j + min(best[i] + i  for  j - window <= i < j),

whose inner minimum is over a sliding window: a monotone queue gives every transition in
constant amortised time. The programme runs over one block of consecutive documents at a time
(``BLOCK_BYTES`` of text, or one longer document), so memory is bounded and nothing
is shuffled; a block ends with one sequence that may be short.

Tokens: the tokenizer drops white space and splits words into letters, digits and the rest
before it merges, so each distinct piece of a word is tokenised once per task and the ids are
gathered by piece. Words outside ASCII and À to ÿ go through the whole tokenizer.

Edge cases: a null or empty text is the end-of-document id alone. Rows that repeat are packed
each on its own; a null id is kept. No rows give no pieces. Columns other than the two named
ones are ignored.
"""

from __future__ import annotations

from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.llm import textbytes

WINDOW = 2048
END_ID = 1
SENTENCE_COST = 12.0
TOKEN_COST = 64.0
#: Tokens from one cut inside a sentence to the next: about what a sequence pads at most.
STEP = 64
#: Text of one block.
BLOCK_BYTES = 2 << 20
#: Distinct pieces of words whose ids a task keeps; a full cache starts anew (speed only).
CACHE_PIECES = 600_000

_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Byte classes: white space, letters (also both bytes of the two-byte letters À to ÿ), digits, the rest.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
#: Bytes whose words go whole through the tokenizer: control characters, apostrophes
#: (contractions are pieces of their own) and what leads characters outside À to ÿ.
_RARE = np.zeros(256, dtype=bool)
_RARE[[*range(0x09), *range(0x0E, 0x20), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces(chunk: textbytes.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each unit that the tokenizer treats by itself, and whether it is a rare word.

    A plain word falls into runs of letters, single digits and runs of the rest; a rare word
    (one with a byte of ``_RARE``, a multiplication or division sign, or a special token's
    opening) is one unit.
    """
    data, n = chunk.data, len(chunk.data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    word = np.concatenate(([True], (kind[1:] != _SPACE) & (kind[:-1] == _SPACE) | edge[1:-1])) & (kind != _SPACE)
    cut = np.concatenate(([True], (kind[1:] != kind[:-1]) | edge[1:-1])) | (kind == _DIGIT)
    rare = _RARE[data]
    rare[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    word_start = np.flatnonzero(word)
    if rare.any():
        odd = np.zeros(len(word_start), dtype=bool)
        odd[np.searchsorted(word_start, np.flatnonzero(rare), side="right") - 1] = True
        begin = word_start[odd]
        finish = np.append(word_start, n)[1:][odd]
        inside = np.zeros(n + 1, dtype=np.int8)
        np.add.at(inside, begin, 1)
        np.add.at(inside, finish, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        cut = np.where(inside, word | (kind == _SPACE), cut)
    else:
        inside = np.zeros(n, dtype=bool)
    start = np.flatnonzero(cut & (kind != _SPACE))
    stop = np.flatnonzero(np.append(cut[1:] | (kind[1:] == _SPACE), True) & (kind != _SPACE)) + 1
    return start, stop, inside[start]


class PieceIds:
    """Ids of a chunk by a tokenizer that drops white space; distinct pieces are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._known: dict[int, bytes] = {}  # as 32-bit ids: a fraction of a list of numbers

    def _ids(self, raw: bytes, rare: bool) -> list[int]:
        if rare:
            return self._tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        text = raw.decode()
        if not text.isascii():
            text = "".join(map(self._letters.__getitem__, text.lower().encode()))
        return [t.id for t in self._model.tokenize(text)]  # most of this operator's time

    def chunk(self, chunk: textbytes.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: flat ids, index of each piece's first id (one more at the end), each piece's start and end.

        Case of plain ASCII letters does not matter to the tokenizer, so pieces are hashed
        in lower case.
        """
        start, end, rare = pieces(chunk)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64), start, end
        if len(self._known) > CACHE_PIECES:
            self._known = {}
        data = chunk.data
        plain = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
        code = textbytes.span_codes(plain, start, end) ^ rare.astype(np.uint64)
        encoded = pa.array(code).dictionary_encode()
        index = encoded.indices.to_numpy()
        distinct = encoded.dictionary.to_numpy().tolist()
        known = self._known
        ids = [known.get(c) for c in distinct]
        missing = [i for i, found in enumerate(ids) if found is None]
        if missing:
            where = np.zeros(len(distinct), dtype=np.int64)
            where[index[::-1]] = np.arange(len(index) - 1, -1, -1)
            at = where[missing]
            raw, source = plain.tobytes(), data.tobytes()
            for i, a, b, odd in zip(missing, start[at].tolist(), end[at].tolist(), rare[at].tolist()):
                ids[i] = known[distinct[i]] = array("I", self._ids((source if odd else raw)[a:b], odd)).tobytes()
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // array("I").itemsize
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        begin = np.cumsum(size) - size
        per_piece = size[index]
        first = np.concatenate(([0], np.cumsum(per_piece)))
        gather = np.repeat(begin[index] - first[:-1], per_piece) + np.arange(first[-1])
        return flat[gather], first, start, end


def choose_cuts(length: int, position: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cut points of a stream of ``length`` tokens: the cheapest chain through the candidates.

    ``position``: ascending candidate cuts in ``1 .. length``, the last one ``length``, no two
    more than ``window`` apart. Returns ``[0, ..., length]``.
    """
    at = [0, *position.tolist()]
    cost = [0.0, *penalty.tolist()]
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # indices with rising best + position
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = cost[j] + window - here + best[i] + at[i]
        key = best[j] + here
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [length], len(at) - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def candidates(length: int, doc_end: np.ndarray, sentence_end: np.ndarray, window: int, sentence_cost: float,
               token_cost: float, word_end: np.ndarray | None = None, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts and their penalties: document ends, sentence ends, the last of ``word_end`` (ascending) in each
    ``step`` tokens without either, and every ``step`` tokens where these leave a gap of over two steps."""
    step = min(step, window)
    mark = np.zeros(length + 1, dtype=np.uint8)
    mark[sentence_end] = 1
    mark[doc_end] = 2
    place = mark > 0
    if word_end is not None and len(word_end):
        served = np.zeros(length // step + 1, dtype=bool)
        served[np.flatnonzero(place) // step] = True
        last = word_end[np.append(word_end[1:] // step != word_end[:-1] // step, True)]
        place[last[~served[last // step]]] = True
    place[0] = False
    position = np.flatnonzero(place)
    gap = np.diff(position, prepend=0)
    steps = np.where(gap > min(2 * step, window), (gap - 1) // step, 0)
    if steps.any():
        long = np.flatnonzero(steps)
        base = np.repeat(position[long] - gap[long], steps[long])
        nth = np.arange(len(base)) - np.repeat(np.cumsum(steps[long]) - steps[long], steps[long]) + 1
        position = np.sort(np.concatenate((position, base + nth * step)))
    return position, np.array([float(token_cost), float(sentence_cost), 0.0])[mark[position]]


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         sentence_cost: float = SENTENCE_COST, token_cost: float = TOKEN_COST,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, ``start`` (tokens of its document before it), ``length``,
    ``ids`` (binary: little-endian unsigned 32-bit token ids), ``doc_tokens``, ``sequence_id``
    and ``offset`` (tokens before it in its sequence).

    A sequence's pieces follow each other without a gap, in the order of the rows; a sequence
    id is the task's partition number and a counter. Documents end with ``end_id``.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        encoder = PieceIds(path)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0)
            for chunk in textbytes.chunks(batch.column(1), limit=BLOCK_BYTES):
                flat, first, start, end = encoder.chunk(chunk)
                docs_first = first[np.searchsorted(start, chunk.offsets)]
                tokens = np.diff(docs_first) + 1
                doc_end = np.cumsum(tokens)
                doc_start = doc_end - tokens
                length = int(doc_end[-1])
                ids = np.full(length, end_id, dtype=np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(tokens)), tokens - 1)] = flat
                after = np.append(chunk.data, 0x20)[end]
                spaced = _CLASS[after] == _SPACE
                of = np.searchsorted(chunk.offsets, start[spaced], side="right") - 1
                word_end = first[1:][spaced] + of
                sentence_end = word_end[_STOPS[chunk.data[end[spaced] - 1]]]
                cuts = np.array(choose_cuts(length, *candidates(
                    length, doc_end, sentence_end, window, sentence_cost, token_cost, word_end), window))
                edge = np.unique(np.concatenate((cuts, doc_end)))
                begin, finish = edge[:-1], edge[1:]
                size = finish - begin
                doc = np.searchsorted(doc_end, begin, side="right")
                seq = np.searchsorted(cuts, begin, side="right") - 1
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    doc_ids.take(pa.array(chunk.first + doc)),
                    pa.array(begin - doc_start[doc]),
                    pa.array(size),
                    pa.array([raw[4 * a: 4 * b] for a, b in zip(begin.tolist(), finish.tolist())], pa.binary()),
                    pa.array(tokens[doc]),
                    pa.array(seq + sequence),
                    pa.array(begin - cuts[seq]),
                ], names=names)
                sequence += len(cuts) - 1
        del encoder
        textbytes.give_back()

    return rows.mapInArrow(run, schema)
