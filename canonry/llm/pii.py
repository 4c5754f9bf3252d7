"""Personal data: fixed patterns, and spans of a character BiLSTM with a CRF trained in numpy.

``train`` draws a bounded sample of text pieces, labels them (spans of the fixed patterns, and
written forms those patterns do not know, generated and inserted at word borders), and fits the
model in one task: characters enter a forward and a backward LSTM, their states give a score per
tag, and a CRF adds transition scores between tags (begin and inside of each kind, outside).
``find`` carries the trained weights, some tens of kilobytes, to the tasks. Each text is cut into
overlapping windows of equal length; the windows of a batch are run together, and the best tag path of
each is found by Viterbi, searched where a bound on every run of tags allows one to beat "outside" (the rest of
the path is known). The spans of all windows of a text are then reconciled: pieces
that a window's edge cut are joined with their other part, and of overlapping spans those of the
greatest total score stay (weighted interval scheduling). A model's span that overlaps a
fixed pattern's, whose score over "outside" is under ``MARGIN``, that is over ``LONGEST`` characters long or that
has neither a digit nor an at sign (plain or written out) is left out; a window with neither
could give no span and is not run.

The fixed patterns are matched without backtracking over runs, so time is linear in a text's length.

Edge cases: null and empty texts have no spans. A text without word borders is handled like any
other, very long texts in many windows with bounded memory beside the text. Repeated rows
each give a row, an empty table none (the model is then trained on generated pieces alone). Other columns are kept; a column named ``spans`` is
replaced.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Pieces of text the model is trained on, at most, and their length in characters.
SAMPLE_ROWS = 2000
PIECE = 400

HIDDEN = 12
TRAIN_WINDOW = 72
TRAIN_BATCH = 64
TRAIN_STEPS = 260
RATE = 0.03
SEED = 20

#: Windows of a text when spans are looked for, and what neighbours share.
WINDOW = 512
OVERLAP = 64
#: Windows run together.
GROUP = 1536
#: Score over the all-outside path that a span needs.
MARGIN = 4.0

#: A model's span is at most this long: what neighbouring windows share, so that one of them sees it whole.
LONGEST = OVERLAP

#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Character codes: ASCII, then letters and other signs beyond it.
SYMBOLS = 130
_NEVER = -1e4

# ------------------------------------------------------------------ fixed patterns
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
#: Every kind has a digit or an at sign, plain or written out; a span without one is none.
_ANCHOR = re.compile(r"[0-9@]|[(\[]\s?(?i:at)\s?[)\]]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of name characters before it and a dotted name after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _DOMAIN.match(text, at + 1) if begin < at else None
        if host:
            done = host.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Fours of dotted numbers up to 255, counted from the start of each dotted run."""
    for run in _DOTTED.finditer(text):
        parts = [(m.start(), m.end()) for m in _NUMBER.finditer(text, *run.span())]
        for i in range(0, len(parts) - 3, 4):
            four = [text[b:e].lstrip("0") for b, e in parts[i:i + 4]]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in four):
                yield parts[i][0], parts[i + 3][1]


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _passes_luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the fixed patterns in code points, by kind as listed and begin."""
    return [(kind, b, e) for kind, of in zip(KINDS, (emails, addresses, cards, phones)) for b, e in of(text)]


# ------------------------------------------------------------------ labelled pieces
def _written(rng: np.random.Generator, words: list[str]) -> tuple[str, str]:
    """A written form of personal data, mostly one that no fixed pattern knows, with its kind."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: words[rng.integers(len(words))]
    pick = lambda *xs: xs[rng.integers(len(xs))]
    kind = KINDS[rng.integers(len(KINDS))]
    if kind == "email":
        name = word() + pick("", ".", "_", "-") + pick(word(), num(2), "")
        host, end = word() + pick("", num(1)), pick("com", "org", "net", "de", "fr", "io", "co.uk", "example.com")
        at, dot = pick(("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", "."),
                       (" (AT) ", " (DOT) "), ("@", " (dot) "), (" (at) ", "."))
        return kind, (name.strip("._-") or "info") + at + host + dot + end.replace(".", dot)
    if kind == "ip":
        return kind, pick("[.]", " . ", "(.)", ".", "[dot]").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        return kind, pick(" ", "-", ".", "/", "_", " - ").join(num(4) for _ in range(4))
    a, b, c = num(3), num(3), num(4)
    return kind, pick(f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(2)} {num(8)}",
                      f"00{num(2)} {num(2)} {num(8)}", f"0{num(3)}/{num(7)}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}")


def _harmless(rng: np.random.Generator, words: list[str]) -> str:
    """Numbers, keys, repeated words and signs that are no personal data."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = words[rng.integers(len(words))]
    key = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 32))
    return pick(num(rng.integers(1, 20)), num(16), num(16) + " " + num(16), f"{num(2)}:{num(2)}", f"{num(4)}-{num(2)}-{num(2)}",
                f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(3)},{num(3)}.{num(2)}",
                f"({num(4)})", f"{num(1)}.{num(2)}", f"#{num(5)}", f"{num(2)} %", f"@{num(3)}", f"1+{num(2)}", f"p. {num(3)}-{num(3)}",
                f"{num(4)} - {num(4)}", f'{word} = "{key}"', f"{word}: {key.upper()[:20]}", " ".join([word.capitalize()] * 9),
                " ".join([word] * 7), f"{word}-{word}.{word}", f"{word} at {word} dot {word}", "(at", "[dot", "---", "| a |", "$$$", "***", "&&&")


def labelled(pieces: list[str], rng: np.random.Generator, n: int, window: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` labelled texts of ``window`` characters: sampled text with written forms between words of it."""
    words = sorted({w for p in pieces for w in re.findall(r"[a-z]{3,9}", p)}) or ["name", "mail", "info", "office"]
    pieces = [p for p in pieces if p] or [" ".join(words)]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < window:
            p = pieces[rng.integers(len(pieces))]
            cut = rng.integers(len(p))
            part = p[cut:cut + rng.integers(4, window)]
            spans += [(k, b + len(text), e + len(text)) for k, b, e in fixed_spans(part)]
            text += part
            roll = rng.random()
            if roll < 0.4:
                lead = [" ", "\n", ", ", ": ", " ("][rng.integers(5)]
                kind, form = _written(rng, words)
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(form)))
                text += lead + form + [" ", "\n", ", ", ". ", "; "][rng.integers(5)]
            elif roll < 0.9:
                text += " " + _harmless(rng, words) + " "
            else:
                text += "\n"
        # Spans that the window cuts keep the part inside, where that is most of them.
        at = int(rng.integers(0, len(text) - window + 1)) if rng.random() < 0.3 else 0
        out.append((text[at:at + window],
                    [(k, max(b - at, 0), min(e - at, window)) for k, b, e in spans
                     if 2 * (min(e - at, window) - max(b - at, 0)) > e - b]))
    return out


# ------------------------------------------------------------------ model
def codes(text: str) -> np.ndarray:
    """A code per character: ASCII as it is, letters of the Latin blocks and other signs one code each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, points, np.where(points < 0x250, 128, 129)).astype(np.uint8)


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a score that no path takes."""
    mask = np.zeros((TAGS, TAGS))
    for inside in range(2, TAGS, 2):
        mask[:, inside] = _NEVER
        mask[[inside - 1, inside], inside] = 0
    return mask


ALLOWED = _allowed()


def start_weights(rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """``x``: input weights per direction, gate and symbol, ``u``: recurrent, ``o``: states to tags, ``b``: tags,
    ``t``: transitions, ``s``: first tag. Gates: input, forget, output, candidate.

    Gates are cut to 0..1 and the candidate and the state's output to -1..1: straight pieces in place of
    sigmoid and tanh, which cost most of the time otherwise.
    """
    bias = np.array([0.5, 0.8, 0.5, 0.0])[None, :, None, None]
    return {"x": rng.normal(0, 0.2, (2, 4, SYMBOLS, hidden)) + bias, "u": rng.normal(0, 0.15, (2, 4, hidden, hidden)),
            "o": rng.normal(0, 0.3, (2, hidden, TAGS)), "b": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}


def _forward(w: dict, chars: np.ndarray):
    """States and gates of both directions for ``chars`` (steps, texts); the second direction reads from the end."""
    steps, texts = chars.shape
    hidden = w["u"].shape[-1]
    both = np.stack([chars, chars[::-1]], 1)
    h = np.zeros((2, texts, hidden), dtype=w["u"].dtype)
    c = np.zeros_like(h)
    kept = []
    for t in range(steps):
        z = np.stack([w["x"][0][:, both[t, 0]], w["x"][1][:, both[t, 1]]]) + h[:, None] @ w["u"]  # direction, gate, text, hidden
        gates = np.clip(z[:, :3], 0, 1)
        g = np.clip(z[:, 3], -1, 1)
        before, was = c, h
        c = gates[:, 1] * c + gates[:, 0] * g
        cut = np.clip(c, -1, 1)
        h = gates[:, 2] * cut
        kept.append((z, gates, g, before, c, cut, was, h))
    return both, kept


def loss_and_gradient(w: dict, chars: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood of the tag paths ``tags`` (steps, texts), and its gradient."""
    steps, texts = chars.shape
    hidden = w["u"].shape[-1]
    both, kept = _forward(w, chars)
    states = np.stack([k[7] for k in kept])                       # steps, direction, text, hidden
    scores = states[:, 0] @ w["o"][0] + states[::-1, 1] @ w["o"][1] + w["b"]
    # CRF: scaled forward and backward sums over paths.
    step = np.exp(w["t"] + ALLOWED)
    peak = scores.max(-1, keepdims=True)
    seen = np.exp(scores - peak)
    first = w["s"] + ALLOWED[0]
    a, scale = np.empty_like(seen), np.empty((steps, texts, 1))
    for t in range(steps):
        x = seen[t] * (np.exp(first) if t == 0 else a[t - 1] @ step)
        scale[t] = x.sum(-1, keepdims=True)
        a[t] = x / scale[t]
    back = np.ones_like(seen)
    for t in range(steps - 2, -1, -1):
        back[t] = (seen[t + 1] * back[t + 1]) @ step.T / scale[t + 1]
    marginal = a * back
    every = np.arange(texts)
    gold = np.zeros_like(scores)
    gold[np.arange(steps)[:, None], every, tags] = 1
    pairs = np.einsum("tbj,tbk->jk", a[:-1], seen[1:] * back[1:] / scale[1:]) * step
    real = np.zeros_like(pairs)
    np.add.at(real, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    loss = (np.log(scale).sum() + peak.sum() - (scores * gold).sum()
            - (w["t"] + ALLOWED)[tags[:-1], tags[1:]].sum() - first[tags[0]].sum()) / texts
    d = (marginal - gold) / texts
    grad = {"t": (pairs - real) / texts, "s": d[0].sum(0), "b": d.sum((0, 1)),
            "o": np.stack([np.einsum("tbh,tbk->hk", states[:, 0], d), np.einsum("tbh,tbk->hk", states[::-1, 1], d)]),
            "x": np.empty_like(w["x"]), "u": np.zeros_like(w["u"])}
    out = np.stack([d @ w["o"][0].T, d[::-1] @ w["o"][1].T], 1)
    dh = np.zeros((2, texts, hidden), dtype=out.dtype)
    dc = np.zeros_like(dh)
    every_dz = np.empty((2, 4, steps, texts, hidden), dtype=out.dtype)
    for t in range(steps - 1, -1, -1):
        z, gates, g, before, c, cut, was, _ = kept[t]
        i, f, o = gates[:, 0], gates[:, 1], gates[:, 2]
        dh = dh + out[t]
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.stack([dc * g, dc * before, dh * cut, dc * i], 1)
        dz[:, :3] *= (z[:, :3] > 0) & (z[:, :3] < 1)
        dz[:, 3] *= np.abs(z[:, 3]) < 1
        every_dz[:, :, t] = dz
        grad["u"] += was.transpose(0, 2, 1)[:, None] @ dz
        dh = (dz @ w["u"].transpose(0, 1, 3, 2)).sum(1)
        dc = dc * f
    for side in (0, 1):
        one = (both[:, side].ravel()[None, :] == np.arange(SYMBOLS)[:, None]).astype(out.dtype)
        grad["x"][side] = one @ every_dz[side].reshape(4, steps * texts, hidden)
    return loss, grad


def _tags(spans, size: int) -> np.ndarray:
    tags = np.zeros(size, dtype=np.int64)
    for kind, b, e in spans:
        inside = 2 * KINDS.index(kind) + 2
        if not tags[b:e].any():
            tags[b:e] = inside
            tags[b] = inside - 1
    return tags


def fit(pieces: list[str], steps: int = TRAIN_STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after ``steps`` steps of Adam over labelled windows of the pieces."""
    rng = np.random.default_rng(seed)
    w = {k: x.astype(np.float32) for k, x in start_weights(rng).items()}
    rows = labelled(pieces, rng, 24 * TRAIN_BATCH, TRAIN_WINDOW)
    chars = np.stack([codes(t) for t, _ in rows], 1)
    tags = np.stack([_tags(s, TRAIN_WINDOW) for _, s in rows], 1)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(rows), TRAIN_BATCH)
        _, grad = loss_and_gradient(w, chars[:, chosen], tags[:, chosen])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return w


# ------------------------------------------------------------------ decoding
def tag_scores(w: dict, windows: list[np.ndarray]) -> np.ndarray:
    """Scores (steps, windows, tags) of windows of any lengths, the rest of a shorter one unused."""
    hidden = w["u"].shape[-1]
    lengths = np.array([len(x) for x in windows])
    steps = int(lengths.max())
    chars = np.zeros((2, steps, len(windows)), dtype=np.intp)
    for k, x in enumerate(windows):
        chars[0, :len(x), k] = x
        chars[1, :len(x), k] = x[::-1]
    scores = np.empty((2, steps, len(windows), TAGS), dtype=np.float32)
    z, more = np.empty((2, 4, len(windows), hidden), dtype=np.float32)
    for side in (0, 1):
        tables, u, o = w["x"][side], w["u"][side], w["o"][side]
        h = np.zeros((len(windows), hidden), dtype=np.float32)
        c = np.zeros_like(h)
        for t in range(steps):
            for gate in range(4):
                np.take(tables[gate], chars[side, t], axis=0, out=z[gate], mode="clip")
            z += np.matmul(h, u, out=more)
            np.clip(z[:3], 0, 1, out=z[:3])
            np.clip(z[3], -1, 1, out=z[3])
            c *= z[1]
            z[0] *= z[3]
            c += z[0]
            np.clip(c, -1, 1, out=h)
            h *= z[2]
            np.matmul(h, o, out=scores[side, t])
    # The second direction's step t is the window's character length - 1 - t.
    place = lengths[None, :] - 1 - np.arange(steps)[:, None]
    scores[0] += scores[1][np.maximum(place, 0), np.arange(len(windows))[None, :]]
    scores[0] += w["b"]
    return scores[0]


def _bounds(w: dict) -> tuple[np.ndarray, float, float, float]:
    """(per tag, inside, at a window's start, at its end): a run of tags other than "outside" gains at most the
    sum over its steps of score(tag) - score(outside) + per tag, plus ``inside`` (more where it touches an end).

    What a step inside a kind gains by its transition goes to the tag; the other transitions
    then have no cycle that gains, and their dearest chain is a longest path over the few tags.
    """
    t = (w["t"] + ALLOWED).astype(np.float64)
    first = (w["s"] + ALLOWED[0]).astype(np.float64)
    per_tag = np.zeros(TAGS)
    per_tag[2::2] = (t - t[0, 0])[range(2, TAGS, 2), range(2, TAGS, 2)]
    while True:
        far = t - t[0, 0] - per_tag[None, :]
        begin = first - first[0] - per_tag
        for mid in range(1, TAGS):
            begin = np.maximum(begin, begin[mid] + far[mid])
            far = np.maximum(far, far[:, mid, None] + far[None, mid])
        cycle = far[range(1, TAGS), range(1, TAGS)].max()
        if cycle <= 1e-9:
            break
        per_tag[1::2] += cycle
    # Entry, chain and way back; a run that ends its window needs no way back.
    step = t - t[0, 0] - per_tag[None, :]
    inside = max(far[0, k] + step[k, 0] for k in range(1, TAGS))
    opening = max(begin[k] + step[k, 0] for k in range(1, TAGS))
    closing = far[0, 1:].max()
    whole = begin[1:].max()
    at_start = max(0.0, opening - inside)
    return per_tag, inside + 1e-3, at_start, max(0.0, closing - inside, whole - inside - at_start)


def open_ranges(w: dict, scores: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(window, begin, end) of the ranges outside which the best path has the tag "outside".

    A step is in a range if, by the bounds, some run of other tags that holds it may gain: the
    best sums that end and begin at it are kept from step to step.
    """
    per_tag, way_back, at_start, at_end = _bounds(w)
    lead = scores[..., 1] + np.float32(per_tag[1])
    for tag in range(2, TAGS):
        np.maximum(lead, scores[..., tag] + np.float32(per_tag[tag]), out=lead)
    lead -= scores[..., 0]
    lead[0] += np.float32(at_start)
    lead[lengths - 1, np.arange(len(lengths))] += np.float32(at_end)
    lead[np.arange(len(lead))[:, None] >= lengths[None, :]] = _NEVER
    before, after = np.empty_like(lead), np.empty_like(lead)
    sum_to, sum_from = np.zeros_like(lead[0]), np.zeros_like(lead[0])
    for k in range(len(lead)):
        np.maximum(sum_to, 0, out=sum_to)
        before[k] = sum_to
        sum_to += lead[k]
        back = len(lead) - 1 - k
        np.maximum(sum_from, 0, out=sum_from)
        after[back] = sum_from
        sum_from += lead[back]
    lead += before
    lead += after
    may = np.zeros((lead.shape[1], len(lead) + 2), dtype=np.int8)
    may[:, 1:-1] = (lead + way_back > 0).T
    turn = np.diff(may, axis=1)
    which, begins = np.nonzero(turn == 1)
    return list(zip(which.tolist(), begins.tolist(), np.nonzero(turn == -1)[1].tolist()))


def viterbi(w: dict, ranges: list[np.ndarray], opens: np.ndarray, closes: np.ndarray) -> list[np.ndarray]:
    """The best tag path of each range of scores (steps, tags); equal scores go to the tag listed first.

    ``opens``: the range begins its window; ``closes``: it ends it. Elsewhere "outside" lies before and after.
    """
    t = (w["t"] + ALLOWED).astype(np.float32)
    lengths = np.array([len(x) for x in ranges])
    steps = int(lengths.max())
    by_tag = np.zeros((steps, TAGS, len(ranges)), dtype=np.float32)
    for j, x in enumerate(ranges):
        by_tag[:len(x), :, j] = x
    first = (w["s"] + ALLOWED[0]).astype(np.float32)
    best = by_tag[0] + np.where(opens[None, :], first[:, None], t[0][:, None])
    came = np.zeros((steps, TAGS, len(ranges)), dtype=np.int8)
    final = best.copy()
    for k in range(1, steps):
        top = best[0] + t[0][:, None]
        for j in range(1, TAGS):
            way = best[j] + t[j][:, None]
            came[k][way > top] = j
            np.maximum(top, way, out=top)
        best = top + by_tag[k]
        ends = lengths - 1 == k
        final[:, ends] = best[:, ends]
    last = (final + np.where(closes[None, :], np.float32(0), t[:, 0][:, None])).argmax(0)
    out = []
    for j, n in enumerate(lengths):
        path = np.zeros(n, dtype=np.int64)
        path[-1] = last[j]
        for k in range(n - 1, 0, -1):
            path[k - 1] = came[k, path[k], j]
        out.append(path)
    return out


def _spans_of(w: dict, path: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind number, begin, end, score over "outside") of a range's path."""
    t = w["t"]
    out, k = [], 0
    while k < len(path):
        if path[k] == 0:
            k += 1
            continue
        begin, tag = k, int(path[k])
        kind = (tag - 1) // 2
        gain = t[0, tag] + scores[k, tag]
        k += 1
        while k < len(path) and path[k] == 2 * kind + 2:
            gain += t[path[k - 1], path[k]] + scores[k, path[k]]
            k += 1
        gain += t[path[k - 1], 0] - scores[begin:k, 0].sum() - (k - begin + 1) * t[0, 0]
        out.append((kind, begin, k, float(gain)))
    return out


def window_cuts(size: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows of nearly equal length that cover a text, neighbours sharing ``overlap`` characters or more."""
    n = max(1, -(-(size - overlap) // (window - overlap)))
    span = -(-(size - overlap) // n) + overlap if n > 1 else size
    return [(min(i * (span - overlap), max(size - span, 0)), min(i * (span - overlap) + span, size)) for i in range(n)]


def reconcile(found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """One set of spans of a text from those of its windows.

    Spans: kind, begin, end, score, cut on the left, cut on the right. Pieces of one kind that meet, one of them cut
    there, become one span; of overlapping spans, those with the greatest total score stay.
    """
    joined: list[list] = []
    for s in sorted(found, key=lambda s: (s[0], s[1], s[2])):
        last = joined[-1] if joined else None
        if last and last[0] == s[0] and s[1] < last[2] and (last[5] or s[4] or (last[1], last[2]) == (s[1], s[2])):
            last[3] = max(last[3], s[3])
            if s[2] >= last[2]:
                last[2], last[5] = s[2], s[5]
        else:
            joined.append(list(s))
    rows = sorted(joined, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in rows]
    best: list[float] = [0.0]
    take: list[int] = []
    for k, s in enumerate(rows):
        before = int(np.searchsorted(ends[:k], s[1], side="right"))
        with_it = best[before] + s[3]
        take.append(before if with_it > best[k] else -1)
        best.append(max(best[k], with_it))
    out, k = [], len(rows)
    while k:
        if take[k - 1] >= 0:
            out.append(tuple(rows[k - 1][:4]))
            k = take[k - 1]
        else:
            k -= 1
    return out[::-1]


def model_spans(w: dict, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Reconciled model spans of each text."""
    found: list[list] = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    anchors = [np.fromiter((m.start() for m in _ANCHOR.finditer(t)), dtype=np.int64) for t in texts]
    holds = lambda k, b, e: np.searchsorted(anchors[k], b) < np.searchsorted(anchors[k], e)
    cuts = sorted(((e - b, k, b, e) for k, size in enumerate(sizes) if len(anchors[k])
                   for b, e in window_cuts(size) if holds(k, b, e)), reverse=True)
    coded: dict[int, np.ndarray] = {k: codes(texts[k]) for k in {c[1] for c in cuts}}
    for g in range(0, len(cuts), GROUP):
        group = cuts[g:g + GROUP]
        lengths = np.array([c[0] for c in group])
        scores = tag_scores(w, [coded[k][b:e] for _, k, b, e in group])
        ranges = sorted(open_ranges(w, scores, lengths), key=lambda r: r[1] - r[2])
        for r in range(0, len(ranges), GROUP):
            part = ranges[r:r + GROUP]
            parts = [scores[x:y, j] for j, x, y in part]
            paths = viterbi(w, parts, np.array([x == 0 for _, x, _ in part]), np.array([y == lengths[j] for j, _, y in part]))
            for (j, x, y), path, of in zip(part, paths, parts):
                _, k, b, e = group[j]
                found[k] += [(kind, b + x + at, b + x + to, gain, x + at == 0 and b > 0, x + to == e - b and e < sizes[k])
                             for kind, at, to, gain in _spans_of(w, path, of)]
    return [[s for s in reconcile(f) if holds(k, s[1], s[2])] if f else [] for k, f in enumerate(found)]


def all_spans(w: dict, texts: list[str], margin: float = MARGIN) -> list[list[tuple[str, int, int]]]:
    """Spans of the fixed patterns, then the model's (``model_<kind>``), by kind as listed and begin."""
    out = []
    for text, extra in zip(texts, model_spans(w, texts)):
        base = fixed_spans(text)
        taken = sorted((b, e) for _, b, e in base)
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, dtype=int)
        starts = [b for b, _ in taken]
        more = []
        for kind, b, e, gain in extra:
            # Of the fixed spans that begin before this one's end, does any reach beyond its begin?
            n = int(np.searchsorted(starts, e, side="left"))
            if gain >= margin and e - b <= LONGEST and not (n and reach[n - 1] > b):
                more.append((kind, b, e))
        out.append(base + [(f"model_{KINDS[k]}", b, e) for k, b, e in sorted(more)])
    return out


# ------------------------------------------------------------------ Spark
_MODEL = "weights binary"


def to_bytes(w: dict[str, np.ndarray]) -> bytes:
    file = io.BytesIO()
    np.savez(file, **w)
    return file.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return {k: file[k].astype(np.float32) for k in file.files}


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
          steps: int = TRAIN_STEPS) -> bytes:
    """Model weights from a piece of each of at most ``sample_rows`` texts, those of the smallest hash of id and length.


    Rows are thinned by a hash to about twice the number first, so that no task sends its share of a large table to
    the one that sorts. Trained in one task, lost with its executor and then run again; the same pieces give the same weights.
    """
    n = docs.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mixed = F.xxhash64(F.col(id_col).cast("string"), F.length(text), F.lit(SEED))
    at = F.pmod(mixed, F.greatest(F.length(text) - PIECE, F.lit(0)) + 1).cast("int") + 1
    spread = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(SEED + 1)), F.lit(1 << 30))
    some = docs if n <= 2 * sample_rows else docs.where(spread < F.lit(int((1 << 30) * min(1.0, 2 * sample_rows / n))))
    pieces = some.select(mixed.alias("h"), F.substring(text, at, F.lit(PIECE)).alias("piece")).orderBy("h", "piece").limit(sample_rows)

    def learn(batches):
        texts = [x for b in batches for x in b.column("piece").to_pylist()]
        yield pa.RecordBatch.from_pydict({"weights": pa.array([to_bytes(fit(texts, steps))], pa.binary())})

    return bytes(pieces.select("piece").coalesce(1).mapInArrow(learn, _MODEL).first()["weights"])


def find(docs: DataFrame, model: bytes, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """Adds ``spans``: (kind, begin, end) in code points, end exclusive, by kind as listed and begin."""
    kept = [c for c in docs.columns if c != "spans"]
    out = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_whole_text"))
    schema = docs.select(*kept, F.lit(None).cast("array<struct<kind:string,begin:int,end:int>>").alias("spans")).schema
    shape = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        weights = from_bytes(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = [[{"kind": k, "begin": b, "end": e} for k, b, e in s] for s in all_spans(weights, texts, margin)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, shape)], names=[*batch.schema.names[:-1], "spans"])

    return out.mapInArrow(run, schema)


def number_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def names(spans):
    """``kind:begin:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def base_of(spans):
    """The spans of the fixed patterns."""
    return F.filter(spans, lambda s: s["kind"].isin(*KINDS))
