"""Document quality from a linear-chain conditional random field over lines.

Every line that has words is labelled good or bad. Its score is linear in its
own features and in those of the lines before and after it, and neighbouring
labels are tied by a transition table. Forward-backward marginals of "good",
weighted by the bytes of the lines, give the quality of the document; two
more fitted numbers turn that share into a probability.

The field is fitted by L-BFGS on the exact conditional likelihood, with the
label of a document standing for its lines. The sample is bounded: the
``SAMPLE`` labelled training documents that come first by a hash of their id,
less those of more than ``SAMPLE_LINES`` lines. Scoring is one pass over the
whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import lean
from .words import Words, documents, mix, pieces

#: Most documents the field is fitted on, and most lines of one of them.
SAMPLE, SAMPLE_LINES = 4000, 200
#: Score from which a document counts as good.
LIMIT = 0.3

FEATURES = ["upper", "symbols", "digits", "symbol_ends", "bars", "distinct", "word_length", "short_words", "log_words", "repeated", "stops", "beyond_ascii"]  # in the order of line_features
_N = len(FEATURES)

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
for _c in b"!\"#$%&*+/:;<=>?@[]\\^_`{|}~()":
    _SYMBOL[_c] = True


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weight in bytes, row) of every line that has words, in order."""
    w = Words(col)
    data, offs = w.data, w.offs
    full = offs[1:] > offs[:-1]
    begin = np.union1d(offs[:-1][full], np.flatnonzero(data == 10) + 1)
    begin = begin[begin < len(data)]
    if not len(w.start):
        return np.zeros((0, _N)), np.zeros(0), np.zeros(0, np.int64)
    line = np.searchsorted(begin, w.start, "right") - 1
    used, first = np.unique(line, return_index=True)
    n = np.diff(np.append(first, len(line)))
    a, b = begin[used], np.append(begin, len(data))[used + 1]

    def share(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[data], dtype=np.int64))
        return total[b] - total[a]

    def words(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.float64), first) / n

    size = w.end - w.start
    h = w.hashes()
    at = np.repeat(np.arange(len(used)), n)
    _, once = np.unique(mix(h ^ mix(at.astype(np.uint64) + np.uint64(1))), return_index=True)
    row = np.searchsorted(offs, a, "right") - 1
    same = mix(np.add.reduceat(h, first) ^ mix(row.astype(np.uint64) + np.uint64(7)))
    _, back, many = np.unique(same, return_inverse=True, return_counts=True)
    letters = np.maximum(share(_LETTER), 1)
    last = data[w.end - 1]
    width = (b - a).astype(np.float64)
    high = np.zeros(256, bool)
    high[128:] = True
    x = np.stack([
        share(_UPPER) / letters, share(_SYMBOL) / width, share(_DIGIT) / width, words(_SYMBOL[last]), words((data[w.start] == 124) & (size == 1)),
        np.bincount(at[once], minlength=len(used)) / n, np.log(words(size)), words(size <= 3), np.log1p(n), (many[back] > 1).astype(float),
        words((last == 46) | (last == 44)), share(high) / width], axis=1)
    return x, width, row


def _with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bias, the line, the line before and the one after (zero, and a flag, where there is none)."""
    n = len(x)
    out = np.zeros((n, 3 * _N + 3))
    out[:, 0] = 1
    out[:, 1:_N + 1] = x
    joint = row[1:] == row[:-1]
    out[1:, _N + 1:2 * _N + 1][joint] = x[:-1][joint]
    out[:-1, 2 * _N + 1:3 * _N + 1][joint] = x[1:][joint]
    out[:, -2:] = 1
    out[1:, -2][joint] = 0
    out[:-1, -1][joint] = 0
    return out


class Chains:
    """Positions of the lines of many documents, longest first, so that one step serves all documents at once."""

    def __init__(self, row: np.ndarray):
        rows, first, n = np.unique(row, return_index=True, return_counts=True)
        k = np.argsort(-n, kind="stable")
        self.rows, self.first, self.n = rows[k], first[k], n[k]
        longest = int(self.n[0]) if len(n) else 0
        self.live = np.searchsorted(-self.n, -np.arange(longest), "left")

    def marginals(self, score: np.ndarray, trans: np.ndarray):
        """P(good) of every line, the expected transitions and the log partition function.

        ``score``: of "good" over "bad"; ``trans[i, j]``: from label i to j, 1 is good.
        """
        m, unary = len(self.n), np.stack([np.zeros_like(score), score], 1)
        fwd, bwd = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        for t, live in enumerate(self.live):
            at = self.first[:live] + t
            fwd[at] = unary[at]
            if t:
                p = fwd[at - 1]
                fwd[at] += np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
        for t in range(len(self.live) - 2, -1, -1):
            at = self.first[:self.live[t + 1]] + t
            nxt = bwd[at + 1] + unary[at + 1]
            bwd[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        last = fwd[self.first + self.n - 1] if m else np.zeros((0, 2))
        z = np.logaddexp(last[:, 0], last[:, 1])
        of = np.zeros(len(score))
        of[self.first] = z
        of = of[np.repeat(np.sort(self.first), np.diff(np.append(np.sort(self.first), len(score))))] if m else of
        good = np.exp(np.minimum(fwd[:, 1] + bwd[:, 1] - of, 0))
        inner = np.ones(len(score), bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        pair = np.exp(np.minimum(fwd[at - 1][:, :, None] + trans + (unary[at] + bwd[at])[:, None, :] - of[at][:, None, None], 0)).sum(0)
        return good, pair, z.sum()


def _lbfgs(f, x: np.ndarray, steps: int = 80, keep: int = 8) -> np.ndarray:
    """Minimum of ``f`` (value and gradient), with backtracking."""
    v, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            used.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used)):
            d = d + (a - y @ d / (s @ y)) * s
        t = 1.0
        while True:
            nv, ng = f(x + t * d)
            if nv <= v + 1e-4 * t * (g @ d) or t < 1e-8:
                break
            t /= 2
        s, y = t * d, ng - g
        x, done = x + s, v - nv < 1e-7 * max(1, abs(v))
        v, g = nv, ng
        if done:
            break
        if s @ y > 1e-12:
            past = [*past, (s, y)][-keep:]
    return x


@dataclass(frozen=True)
class Field:
    """A fitted field. ``prior`` is the score of a text without words."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float
    prior: float

    def shares(self, x: np.ndarray, width: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted share of good lines of ``n`` rows, and which rows have lines."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        good, _, _ = Chains(row).marginals(_with_neighbours(x, row) @ self.weights, self.trans)
        total = np.bincount(row, width, n)
        return np.bincount(row, width * good, n) / np.maximum(total, 1), total > 0

    def score(self, share: np.ndarray, known: np.ndarray) -> np.ndarray:
        z = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return np.where(known, 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35))), self.prior)


def _fit(x: np.ndarray, width: np.ndarray, row: np.ndarray, label: np.ndarray, ridge: float = 3.0) -> Field:
    """``label``: 0 or 1 of every row."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    prior = float(label.mean())
    v = _with_neighbours(np.clip((x - mean) / scale, -8, 8), row)
    y = label[row].astype(float)
    chains = Chains(row)
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    k = v.shape[1]

    def loss(p):
        w, t = p[:k], p[k:].reshape(2, 2)
        s = v @ w
        good, pair, z = chains.marginals(s, t)
        value = z - s @ y - (t * seen).sum() + ridge * (p @ p) / 2
        return value, np.append(v.T @ (good - y), (pair - seen).ravel()) + ridge * p

    p = _lbfgs(loss, np.zeros(k + 4))
    field = Field(mean, scale, p[:k], p[k:].reshape(2, 2), 1.0, 0.0, prior)
    share, known = field.shares(x, width, row, len(label))
    z = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))[known]
    u = label[known].astype(float)

    def platt(q):
        s = np.clip(q[0] * z + q[1], -35, 35)
        good = 1 / (1 + np.exp(-s))
        return (np.logaddexp(0, s) - u * s).sum() + 0.05 * ((q[0] - 1) ** 2 + q[1] ** 2), np.array([(good - u) @ z, (good - u).sum()]) + 0.1 * np.array([q[0] - 1, q[1]])

    q = _lbfgs(platt, np.array([1.0, 0.0]))
    return Field(mean, scale, p[:k], p[k:].reshape(2, 2), float(q[0]), float(q[1]), prior)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        x, width, row = line_features(b.column("text"))
        n = np.bincount(row, minlength=b.num_rows)
        to = np.cumsum(n)
        keep = np.flatnonzero((n > 0) & (n <= SAMPLE_LINES))
        yield pa.record_batch({
            "doc_id": b.column("doc_id").take(pa.array(keep)), "x": pa.array([x[to[i] - n[i]:to[i]].astype(np.float32).tobytes() for i in keep], pa.binary()),
            "width": pa.array([width[to[i] - n[i]:to[i]].tobytes() for i in keep], pa.binary()), "quality": b.column("quality").take(pa.array(keep))})


def held_out(doc_id):
    """Rows that no label is learnt from: crc32 of the id as text divides by 5. Rows without id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field for ``labels`` (doc_id, quality 0 or 1); None where no document of both classes is left to learn from.

    A document labelled twice counts as its lower label. Held-out rows are never read.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = documents(docs).join(F.broadcast(known), "doc_id").mapInArrow(lean(_lines), "doc_id long, x binary, width binary, quality int").collect()
    rows = list({r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, r.x))}.values())
    label = np.array([r.quality for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return None
    x = [np.frombuffer(r.x, np.float32).reshape(-1, _N).astype(np.float64) for r in rows]
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    return _fit(np.concatenate(x), np.concatenate([np.frombuffer(r.width) for r in rows]), row, label)


def quality(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` (with columns doc_id and text) and ``score`` in 0..1, higher where a good label is likelier.

    Null and empty texts and texts without words get the share of good labels
    in the sample; without a field every score is 0.5. All columns, rows and
    repeats pass through.
    """
    if field is None:
        return docs.withColumn("score", F.lit(0.5))
    wide = docs.withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            x, width, row = line_features(b.column("text"))
            share, known = field.shares(x, width, row, b.num_rows)
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(field.score(share, known)))

    return wide.mapInArrow(lean(run), wide.schema)
