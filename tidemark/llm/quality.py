"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text's features are the shares of its words in hashed cells (square roots, so that common
words don't drown the rest) and statistics of its structure and size. The score is the
logistic of w0 + w.x + sum over i<j of <v_i, v_j> x_i x_j, whose last part is half of
(sum v_i x_i)^2 - sum v_i^2 x_i^2 summed over the factors: linear in the features.

The model is fitted on the driver from a bounded sample of labelled rows (`SAMPLE` of each
label, by the least hashes of doc_id); everything else runs in tasks over whole texts.
doc_id, lang, source and labels are never features, so of the metadata only the text's own
size is left. Empty and null texts have the statistics of an empty text; texts of any length
are read whole, in blocks. Without labels the score is 0.5. A doc_id with several labels
counts as good only if all say so; repeated rows are scored each for itself; an empty table
gives no rows; columns that aren't kept can't clash, and kept ones may have any name but those
of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import of, spread
from ._text import BLOCK, chunks, hashes, lower, release, utf8, words

CELLS = 2048
SAMPLE = 4000  # labelled rows of each label that the model is fitted on, at most
FACTORS, EPOCHS, RATE = 4, 60, 0.02
THRESHOLD = 0.3
STATISTICS = ("letters", "digits", "upper", "marks", "spaces", "other", "pipes", "bangs", "long_words", "mean_word", "distinct", "most_common", "adjacent_repeats", "lines", "short_lines", "log_words", "log_bytes", "marks_per_word", "first_upper", "bias")
_KIND = np.full(256, 5, np.uint8)  # classes of bytes; those from 128 on are letters of other scripts
_KIND[128:] = 0
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"0123456789", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 3), (b" \t\n\r\x0b\x0c", 4)):
    _KIND[list(_chars)] = _k


def _ratio(a, b):
    return a / np.maximum(b, 1)


def features(column: pa.Array):
    """(first row, matrix) of runs of texts: CELLS word cells, then STATISTICS."""
    for first, data, offsets in chunks(*utf8(column), BLOCK):
        for lo in range(0, len(offsets) - 1, 256):
            o = offsets[lo : lo + 257]
            yield first + lo, _matrix(data[o[0] : o[-1]], o - o[0])


def _matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    h = hashes(lower(data), starts, ends)
    out = np.zeros((n, CELLS + len(STATISTICS)), np.float32)
    total = np.bincount(doc, minlength=n)
    cell = np.bincount(doc * CELLS + (h % np.uint64(CELLS)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS)
    out[:, :CELLS] = np.sqrt(cell / np.maximum(total, 1)[:, None])
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 6 + _KIND[data], minlength=n * 6).reshape(n, 6)
    count = lambda on, of_=owner: np.bincount(of_[on], minlength=n)
    breaks = np.flatnonzero(data == 10)
    line_at = np.concatenate([[-1], breaks])
    short = np.zeros(n, int)
    if len(breaks):
        short = np.bincount(owner[breaks[np.diff(line_at) < 40]], minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, most = np.zeros(n), np.zeros(n)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for d in range(n):
        if bounds[d + 1] > bounds[d]:
            x = np.sort(h[bounds[d] : bounds[d + 1]])
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            distinct[d], most[d] = len(at), np.diff(np.append(at, len(x))).max()
    lines = count(data == 10) + 1
    stats = (
        _ratio(kinds[:, 0], size), _ratio(kinds[:, 1], size), _ratio(kinds[:, 2], size), _ratio(kinds[:, 3], size), _ratio(kinds[:, 4], size), _ratio(kinds[:, 5], size),
        _ratio(count(data == 124), total), _ratio(count(data == 33), total), _ratio(np.bincount(doc[ends - starts > 20], minlength=n), total), _ratio(size - kinds[:, 4], total) / 16,
        _ratio(distinct, total), _ratio(most, total), _ratio(np.bincount(doc[same], minlength=n), total), _ratio(lines, total), _ratio(short, lines),
        np.log1p(total) / 10, np.log1p(size) / 12, np.minimum(_ratio(kinds[:, 3], total), 4) / 4, _ratio(np.bincount(doc[_KIND[data[starts]] == 2], minlength=n), total), np.ones(n),
    )
    out[:, CELLS:] = np.stack(stats, axis=1)
    return out


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, size: int = CELLS + len(STATISTICS), factors: int = FACTORS):
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(3).normal(0, 0.05, (size, factors)).astype(np.float32)
        self.mean, self.scale = np.zeros(size, np.float32), np.ones(size, np.float32)
        self.fitted = False

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores before the logistic, of scaled rows: the sum-of-squares identity."""
        return self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        z = self.raw((x - self.mean) * self.scale).astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Machine":
        """Adam on the log loss with both labels weighted alike, and a small L2 penalty."""
        if not len(y) or y.min() == y.max():
            return self
        self.mean[CELLS:] = x[:, CELLS:].mean(axis=0)
        self.scale[CELLS:] = 1 / np.maximum(x[:, CELLS:].std(axis=0), 1e-3)
        x = x - self.mean
        x *= self.scale
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        order, state, step = np.random.default_rng(5), {}, 0
        for _ in range(EPOCHS):
            for at in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
                b, step = x[at], step + 1
                g = ((1 / (1 + np.exp(-np.clip(self.raw(b), -40, 40))) - y[at]) * weight[at] / len(at)).astype(np.float32)
                gv = b.T @ (g[:, None] * (b @ self.v)) - ((b * b).T @ g)[:, None] * self.v
                for name, grad in (("w0", g.sum()), ("w", b.T @ g + 1e-4 * self.w), ("v", gv + 1e-3 * self.v)):
                    m, s = state.get(name, (0.0, 0.0))
                    m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
                    state[name] = m, s
                    move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, getattr(self, name) - move)
        self.fitted = True
        return self


def _sparse(batches):
    for b in batches:
        for first, x in features(b.column(2)):
            row, col = np.nonzero(x)
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(col.astype(np.int32)))
            value = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[row, col]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(x)), b.column(1).slice(first, len(x)), at, value], ["doc_id", "label", "at", "value"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Machine:
    """The machine fitted on at most SAMPLE labelled documents of each label.

    labels: doc_id and a column of 0 and 1; rows with nulls are left out.
    """
    known = of(labels, doc_id="long", **{column: "int"}).where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(column).alias("label"))
    pick = lambda label: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = F.broadcast(pick(0).unionByName(pick(1)))  # 2 * SAMPLE rows at most
    rows = of(docs, doc_id="long", text="string").join(sample, "doc_id").select("doc_id", "label", "text")
    found = rows.mapInArrow(_sparse, "doc_id long, label int, at array<int>, value array<float>").toArrow()
    ids = found.column("doc_id").to_numpy()
    _, take = np.unique(ids, return_index=True)
    x, y = np.zeros((len(take), CELLS + len(STATISTICS)), np.float32), np.zeros(len(take), np.float32)
    at, value, label = (found.column(c).combine_chunks() for c in ("at", "value", "label"))
    for i, j in enumerate(take.tolist()):
        x[i, at[j].values.to_numpy()] = value[j].values.to_numpy()
        y[i] = label[j].as_py()
    del found, at, value, label
    machine = Machine().fit(x, y)
    del x
    release()  # the driver has no more use for it
    return machine


def _scored(machine, text_at: int):
    def run(batches):
        for b in batches:
            score = np.full(b.num_rows, 0.5)
            for first, x in features(b.column(text_at)):
                score[first : first + len(x)] = machine.value.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    return run


def scored(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *keep, score, predicted): predicted is 1 from THRESHOLD on. keep: further text columns."""
    d = spread(of(docs, doc_id="long", text="string", **{c: "string" for c in keep}))
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    names = "".join(f", `{c}` string" for c in keep)
    out = d.mapInArrow(_scored(sent, 1), f"doc_id long, text string{names}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Rows never fitted on: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
