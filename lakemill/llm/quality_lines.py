"""Quality rules by line sequence labelling.

Lines of a document are a sequence that a linear-chain conditional random
field marks as content or boilerplate; Viterbi decoding gives the best marks,
and the share of words in content lines decides retention.

The field is fitted on lines. Labels tell of whole documents, so lines get weak
labels: content is a line of a good document, unless it equals an earlier line
of it; all others are boilerplate. Sequences are the labelled documents as they
are, and documents mixed from runs of lines of a good and of a bad one, which
teach the field to switch. At most `sample` labelled documents of each quality
(chosen by hash of the id) are used, whole. The least content share is the one
that best separates held-out labelled documents, again whole.
Marks, counts and verdicts use whole texts of all documents.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import in_batches
from lakemill.llm.textops import SPACE, Piece, mix, pieces, window_hashes, window_ok

#: Labelled documents of each quality that the field is fitted on.
SAMPLE = 400
#: Longest run of lines of one document in a mixed one.
RUN = 8
#: A longer sequence is fitted as several, which bounds the steps of a round.
SEQUENCE = 64
#: A good document lost weighs as much as this many bad ones kept.
LOST = 3
LEAST_WORDS = 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_SYMBOL = b"#*$%&|<>"
_STOP = b".!?,;:"
FEATURES = ("bias", "log_words", "symbols", "symbols_any", "pipes", "upper", "digits", "stops", "shouts", "repeats", "next_same", "word_length", "no_stop_end", "seen_before", "first", "last")


def line_features(line: bytes, words: list[bytes], seen: bool, first: bool, last: bool) -> tuple[float, ...]:
    """Numbers of about 0 to 1 for a line with words."""
    n = len(words)
    size = len(line)
    less = lambda drop: size - len(line.translate(None, drop))
    symbols = less(_SYMBOL)
    return (
        1.0, np.log1p(n) / 5, min(1.0, symbols / n), float(symbols > 0), min(1.0, line.count(b"|") / n), less(_UPPER) / size, less(_DIGIT) / size,
        min(1.0, less(_STOP) / n), min(1.0, line.count(b"!") / n), 1 - len(set(words)) / n, sum(map(eq, words, words[1:])) / n, min(1.0, size / n / 20),
        float(words[-1][-1:] not in b".!?:;\""), float(seen), float(first), float(last),
    )


def lines_of(raw: bytes) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    """Of a text: which lines have words, their features, their word counts,
    and how many of them equal an earlier line."""
    lines = raw.split(b"\n")
    held = [(k, line, w) for k, line in enumerate(lines) if (w := line.split())]
    seen: set[bytes] = set()
    rows, dup = [], 0
    for j, (_, line, w) in enumerate(held):
        again = line in seen
        dup += again
        seen.add(line)
        rows.append(line_features(line, w, again, j == 0, j + 1 == len(held)))
    return [h[0] for h in held], np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES)), np.array([len(h[2]) for h in held], dtype=np.int64), dup


@dataclass
class Field:
    """State 1 is content. A line's score for state 1 is x @ weight, for state 0 zero."""

    weight: np.ndarray
    step: np.ndarray  # (2, 2): from, to
    start: np.ndarray
    least: float = 0.0  # content share

    def viterbi(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks of the rows of x; sequence s is rows first[s] .. first[s + 1] - 1."""
        score = x @ self.weight
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")  # longest first: at step t the live ones are a prefix
        at, n = first[:-1][order], n[order]
        marks = np.zeros(len(x), dtype=np.int8)
        longest = int(n[0]) if len(n) else 0
        if not longest:
            return marks
        came = np.zeros((len(x), 2), dtype=np.int8)
        live = int((n > 0).sum())
        best = np.stack([np.full(live, self.start[0]), self.start[1] + score[at[:live]]], axis=1)
        for t in range(1, longest):
            live = int(np.searchsorted(-n, -t, side="left"))  # n > t
            via = best[:live, :, None] + self.step
            came[at[:live] + t] = via.argmax(axis=1)
            best[:live] = via.max(axis=1)
            best[:live, 1] += score[at[:live] + t]
        live = int((n > 0).sum())
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            marks[at[:live] + t] = state[:live]
            state[:live] = came[at[:live] + t, state[:live]]
        return marks


def fit(xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch Adam over sequences of lines, each line
    with its label; both labels count alike. Deterministic."""
    cut = [(x[k : k + SEQUENCE], y[k : k + SEQUENCE]) for x, y in zip(xs, ys) for k in range(0, len(x), SEQUENCE)]
    cut.sort(key=lambda s: -len(s[0]))  # longest first: at step t the live ones are a prefix
    d, n = len(cut), np.array([len(x) for x, _ in cut])
    length = int(n[0])
    x, y = np.zeros((length, d, len(FEATURES))), np.zeros((length, d), dtype=np.int64)
    for k, (own, label) in enumerate(cut):
        x[: len(own), k], y[: len(own), k] = own, label
    live = [int(np.searchsorted(-n, -t, side="left")) for t in range(length)]
    is_line = np.arange(length)[:, None] < n
    content = max(1, y.sum()) / is_line.sum()
    balance = np.where(y == 1, 0.5 / content, 0.5 / max(1e-9, 1 - content))
    weight_of = (balance * is_line).sum(axis=0) / n / is_line.sum() * n.mean()
    theta = np.zeros(len(FEATURES) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((length, d, 2, 2))
    for t in range(1, length):
        k = live[t]
        seen[t, np.arange(k), y[t - 1, :k], y[t, :k]] = 1
    last = n - 1, np.arange(d)
    for r in range(rounds):
        w, step, start = theta[: len(FEATURES)], theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.zeros((length, d, 2))
        emit[:, :, 1] = x @ w
        fore, back = np.zeros((length, d, 2)), np.zeros((length, d, 2))
        fore[0] = start + emit[0]
        for t in range(1, length):
            k = live[t]
            fore[t, :k] = np.logaddexp(fore[t - 1, :k, :1] + step[0], fore[t - 1, :k, 1:] + step[1]) + emit[t, :k]
        total = np.logaddexp(*fore[last].T)
        for t in range(length - 1, 0, -1):
            k = live[t]
            after = emit[t, :k] + back[t, :k]
            back[t - 1, :k] = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
        off = np.where(is_line, np.exp(np.minimum(0, fore[:, :, 1] + back[:, :, 1] - total)), 0) - y
        pair = np.exp(np.minimum(0, fore[:-1, :, :, None] + step + (emit[1:] + back[1:])[:, :, None, :] - total[None, :, None, None])) * is_line[1:, :, None, None]
        g_step = np.einsum("ldab,d->ab", pair - seen[1:], weight_of)
        g_w = np.einsum("ld,ldf->f", off * weight_of, x)
        g_start = np.array([-1.0, 1.0]) * (off[0] * weight_of).sum()
        g = np.r_[g_w, g_step.ravel(), g_start] + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** (r + 1))) / (np.sqrt(v / (1 - 0.999 ** (r + 1))) + 1e-8)
    return Field(theta[: len(FEATURES)], theta[-6:-2].reshape(2, 2), theta[-2:])


def weak_labels(raw: bytes, good: bool) -> list[tuple[bytes, int]]:
    """The lines with words of a labelled document, each with its weak label."""
    seen: set[bytes] = set()
    out = []
    for line in raw.split(b"\n"):
        if line.split():
            out.append((line, int(good and line not in seen)))
            seen.add(line)
    return out


def mixed(good: list[tuple[bytes, int]], bad: list[tuple[bytes, int]], rnd: random.Random) -> list[tuple[bytes, int]]:
    """All lines of both, each side's in its order, in alternating runs."""
    left = [list(good), list(bad)]
    side, out = rnd.randrange(2), []
    while left[0] or left[1]:
        n = rnd.randint(1, RUN)
        out += left[side][:n]
        del left[side][:n]
        side = 1 - side
    return out


def sequences(rows: list[tuple[int, bytes]], seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of the lines of (quality, text) rows, and of each
    good one mixed with a bad one and the other way round."""
    rnd = random.Random(seed)
    made = [(q, lines) for q, text in rows if (lines := weak_labels(text, q == 1))]
    good, bad = [x for q, x in made if q == 1], [x for q, x in made if q == 0]
    docs = [x for _, x in made]
    if good and bad:
        docs += [mixed(good[k % len(good)], bad[k % len(bad)], rnd) for k in range(max(len(good), len(bad)))]
    return [lines_of(b"\n".join(line for line, _ in x))[1] for x in docs], [np.array([y for _, y in x]) for x in docs]


def share(field: Field, x: np.ndarray, n_words: np.ndarray) -> float:
    marks = field.viterbi(x, np.array([0, len(x)]))
    return float(n_words @ marks) / max(1, int(n_words.sum()))


_fits: dict[bytes, Field | None] = {}


def fitted(rows: list[tuple[int, bytes]]) -> Field | None:
    """The field for (quality, text) rows, kept for the next call with equal
    rows; None unless both qualities have lines."""
    key = hashlib.sha256(repr(rows).encode()).digest()
    if key not in _fits:
        _fits.clear()
        rows = [r for r in rows if r[1].split()]
        fitting, held = [r for k, r in enumerate(rows) if k % 4], rows[::4]
        _fits[key] = _fit(fitting, held if len({r[0] for r in held}) == 2 else fitting) if len({r[0] for r in fitting}) == 2 else None
    return _fits[key]


def _fit(fitting: list[tuple[int, bytes]], held: list[tuple[int, bytes]]) -> Field:
    field = fit(*sequences(fitting))
    y = np.array([q for q, _ in held])
    shares = np.array([share(field, *lines_of(text)[1:3]) for _, text in held])
    cuts = np.unique(np.r_[0.0, shares, 1.0])
    cuts = (cuts[1:] + cuts[:-1]) / 2
    gain = [((shares < c) & (y == 0)).sum() / (y == 0).sum() - LOST * ((shares < c) & (y == 1)).sum() / (y == 1).sum() for c in cuts]
    best = np.flatnonzero(np.isclose(gain, max(gain)))
    field.least = float(cuts[best[len(best) // 2]])
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field | None:
    """None without labelled documents of both qualities that have words."""
    order = [F.xxhash64(id_col, F.lit(23)), F.col(id_col)]
    picked = [labels.where(F.col(label_col) == q).groupBy(id_col).agg(F.lit(q).alias("y")).orderBy(*order).limit(sample) for q in (0, 1)]
    chosen = picked[0].unionAll(picked[1])  # at most 2 * sample rows
    texts = docs.select(id_col, F.col(text_col).alias("sample_text")).join(F.broadcast(chosen), id_col)
    texts = texts.groupBy(id_col, "y").agg(F.min("sample_text").alias("sample_text"))  # repeated ids count once
    rows = sorted((r[id_col], r["y"], r["sample_text"]) for r in texts.where("sample_text is not null").collect())
    return fitted([(y, t.encode()) for _, y, t in rows])


def counts(piece: Piece) -> tuple[np.ndarray, ...]:
    """Of each row: n_words, word_chars, n_symbols, n_repeat_words."""
    per_row = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][piece.rows])
    chars = per_row(((piece.data & 0xC0) != 0x80) & ~SPACE[piece.data])
    symbols = per_row(SYMBOLS[piece.data])
    w = window_hashes(piece.word_hashes(), 3)
    at = np.flatnonzero(window_ok(piece, 3))
    key = w[at] ^ mix(piece.row_of_word()[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(piece.starts) + 3, dtype=bool)
    for k in range(3):
        cover[at[twice] + k] = True
    repeated = np.diff(np.r_[0, np.cumsum(cover[: len(piece.starts)])][piece.first])
    return piece.n_words, chars, symbols, repeated


NEW = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "content_share": "double", "line_marks": "string", "kept": "boolean"}


#: Bytes of texts that a Python worker gets at once, and that it cuts into words at once.
BATCH = 4 << 20
PIECE = 512 << 10


def _label(batches: Iterator[pa.RecordBatch], text_col: str, field: Field | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new: dict[str, list] = {c: [] for c in NEW}
        for piece in pieces(batch.column(text_col), limit=PIECE):
            n_words, chars, symbols, repeated = counts(piece)
            raw = piece.data.tobytes()
            own = [lines_of(raw[piece.rows[k] : piece.rows[k + 1]]) for k in range(piece.hi - piece.lo)]
            first = np.r_[0, np.cumsum([len(o[0]) for o in own])]
            marks = field.viterbi(np.concatenate([o[1] for o in own]), first) if field else np.ones(first[-1], dtype=np.int8)
            content = np.diff(np.r_[0, np.cumsum(marks * np.concatenate([o[2] for o in own]))][first])
            shares = content / np.maximum(1, n_words)
            failed = (n_words < LEAST_WORDS) | (100 * repeated > 50 * n_words)
            for name, values in (("n_words", n_words), ("word_chars", chars), ("n_symbols", symbols), ("n_dup_lines", [o[3] for o in own]), ("n_repeat_words", repeated), ("base_failed", failed), ("content_share", shares), ("kept", ~failed & (shares >= (field.least if field else 0)))):
                new[name] += list(values)
            new["line_marks"] += ["".join(map(str, marks[first[k] : first[k + 1]])) for k in range(len(own))]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        arrays = {c: pa.array(v, kinds[NEW[c]]) for c, v in new.items()}
        yield pa.RecordBatch.from_arrays([arrays.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)], names=batch.schema.names)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs with the columns of NEW: the counts, base_failed, content_share,
    line_marks (0 or 1 for each line with a word) and kept.

    Null and empty texts have no words and fail. Texts of any length are judged
    whole; time grows with their lines and words. Of marks that tie, the decoder
    takes boilerplate. Repeated rows are judged alike, also under a null id,
    which no label meets. An id with two qualities is in both samples. Without
    usable labels every line is content, so only the base rule decides. Empty
    table: no rows. Columns of docs with these names are replaced.
    """
    field = train(docs, labels, id_col, text_col, label_col, sample)
    out = docs.drop(*NEW).withColumns({c: F.lit(None).cast(kind) for c, kind in NEW.items()})
    return in_batches(out, BATCH).mapInArrow(lambda it: _label(it, text_col, field), out.schema)
