"""Document quality from lines, by a linear-chain conditional random field.

Every line is good or bad. Its features (symbols, capitals, marks, repeated words and word pairs, repetition of an
earlier line, length) and those of its neighbours give the weight of `bad`; neighbours' states depend on each other.
Forward-backward marginals of `bad`, weighted by the lines' lengths, make a document's quality.

Training lines take their document's label at first; in a second round those lines of bad documents that look good
are taken as good, but for each document's worst. Training uses about MAX_ROWS labelled documents at most, picked by a
hash of the id, and of these, if they have more than MAX_LINES lines in all, the share that has about so many, picked by
a hash of the text: none is left out for its length. The score is a monotone function of the length-weighted mean of the
marginals and of nothing else; its two coefficients are fitted to the documents' labels.

Defined results: a null or empty text is one empty line; white lines are no lines; without labelled rows of both kinds
every score is 0.5; an id with contradicting labels counts as good; repeated rows get equal scores; a table without rows
gives none. Memory follows the slab or the longest text's lines; the driver holds about MAX_LINES lines' features.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import fresh_name, labelled_sample, slabs, with_scores
from quillon.llm.linear import logistic, sigmoid
from quillon.runtime import cut, forget, ship

#: Labelled documents to learn from, and all their lines, about and at most.
MAX_ROWS, MAX_LINES = 8_000, 200_000
#: Rows whose CRC-32 of the id leaves HELD_OUT[1] when divided by HELD_OUT[0] are not learnt from.
HELD_OUT = (4, 2)
THRESHOLD = 0.7
_SYMBOLS = b"%$&#*@^~<>{}[]\\/=+_"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
N_OWN = 15


def line_features(text: str) -> np.ndarray:
    """A row for each line that isn't white: its weight (characters), then N_OWN features of about 0 to 1."""
    lines = [s for s in text.split("\n") if s and not s.isspace()] or [""]
    seen: set[str] = set()
    out = np.empty((len(lines), N_OWN + 1), dtype=np.float32)
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "surrogatepass")
        words = line.split()
        n, size = len(words), max(len(raw), 1)
        solid = max(size - n + 1, 1)
        distinct = len(set(words))
        pairs = max(n - 1, 1)
        out[k] = (
            len(line) + 1,
            min(1.0, 5 * (len(raw) - len(raw.translate(None, _SYMBOLS))) / solid),
            (len(raw) - len(raw.translate(None, _UPPER))) / solid,
            min(1.0, raw.count(b"!") / max(n, 1)),
            min(1.0, 2 * raw.count(b"|") / max(n, 1)),
            min(1.0, 5 * (len(raw) - len(raw.translate(None, _DIGITS))) / solid),
            1 - distinct / n if n else 1.0,
            sum(map(operator.eq, words, words[1:])) / pairs,
            1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0,
            line in seen,
            n <= 2,
            n <= 8,
            min(1.0, n / 100),
            min(1.0, solid / max(n, 1) / 20),
            line[-1:] in ".?!",
            not n,
        )
        seen.add(line)
    return out


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and the line after (zeros beyond a document), and a constant."""
    n, d = own.shape
    out = np.zeros((n, 3 * d + 3), dtype=np.float64)
    out[:, :d] = own
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[starts] = True
    last[np.r_[starts[1:], n] - 1] = True
    out[1:, d : 2 * d][~first[1:]] = own[:-1][~first[1:]]
    out[:-1, 2 * d : 3 * d][~last[:-1]] = own[1:][~last[:-1]]
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1.0
    return out


def marginals(bad: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(bad) of each line, expected transitions, log of all partition sums), by forward-backward over all documents at once.

    bad: each line's log weight of `bad` against `good`; trans: log weights of transitions [from, to].
    """
    order = np.argsort(-lengths, kind="stable")
    s, m = starts[order], lengths[order]
    e = np.exp(trans)
    fwd = np.empty((len(bad), 2))
    bwd = np.empty((len(bad), 2))
    emit = np.stack([np.ones(len(bad)), np.exp(np.clip(bad, -30, 30))], axis=1)
    log_z, top = 0.0, int(m[0]) if len(m) else 0
    active = np.searchsorted(-m, -np.arange(top), side="left")  # documents with more than t lines
    for t in range(top):
        at = s[: active[t]] + t
        a = emit[at] if t == 0 else (fwd[at - 1] @ e) * emit[at]
        z = a.sum(1, keepdims=True)
        fwd[at] = a / z
        log_z += float(np.log(z).sum())
    counts = np.zeros((2, 2))
    for t in range(top - 1, -1, -1):
        k = active[t + 1] if t + 1 < top else 0
        at = s[: active[t]] + t
        b = np.ones((len(at), 2))
        if k:
            nxt = emit[at[:k] + 1] * bwd[at[:k] + 1]
            b[:k] = nxt @ e.T
            joint = fwd[at[:k]][:, :, None] * e[None] * nxt[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        bwd[at] = b / b.sum(1, keepdims=True)
    p = fwd * bwd
    return p[:, 1] / p.sum(1), counts, log_z


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    calibration: np.ndarray

    def documents(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(P(bad) of all lines, log odds of each document's length-weighted mean of it) of documents' line features."""
        lengths = np.array([len(f) for f in features])
        starts = np.cumsum(lengths) - lengths
        both = np.concatenate(features).astype(np.float64)
        p = marginals(with_neighbours(both[:, 1:], starts) @ self.weights, starts, lengths, self.trans)[0]
        weight = both[:, 0]
        mean = np.clip(np.add.reduceat(weight * p, starts) / np.add.reduceat(weight, starts), 0.001, 0.999)
        return p, np.log(mean / (1 - mean))[:, None]

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        summary = self.documents([line_features(t) for t in texts])[1]
        return sigmoid(summary @ self.calibration[1:] + self.calibration[0])


def _train(x: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int = 120, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """CRF weights for lines' states y, by Adam on the mean conditional log-likelihood."""
    inner = np.ones(len(y), bool)
    inner[starts] = False
    told = np.zeros((2, 2))
    np.add.at(told, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    par = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(par), np.zeros_like(par)
    for k in range(1, steps + 1):
        p, counts, _ = marginals(x @ par[:-4], starts, lengths, par[-4:].reshape(2, 2))
        grad = np.r_[x.T @ (y - p), (told - counts).ravel()] / len(y) - l2 * par
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        par = par + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return par[:-4], par[-4:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", max_lines: int = MAX_LINES) -> QualityModel:
    """Train the field on lines of labelled documents, and the documents' calibration on its marginals."""
    ship(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, "quality", max_rows, HELD_OUT, id_col, text_col), "labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slabs(batches, "text"):
            made = [line_features(t).tobytes() for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), part.column(1)], ["x", "label"])

    lines = sample.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    part = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, max_lines / max(lines, 1)) * (1 << 20)))
    rows = part.mapInArrow(seen, "x binary, label int").collect()  # about max_lines lines' features
    forget(sample)
    if len({r["label"] for r in rows}) < 2:
        return QualityModel(np.zeros(0), np.zeros((2, 2)), np.zeros(2))
    features = [np.frombuffer(r["x"], np.float32).reshape(-1, N_OWN + 1) for r in rows]
    good = np.array([r["label"] for r in rows])
    lengths = np.array([len(f) for f in features])
    starts = np.cumsum(lengths) - lengths
    x = with_neighbours(np.concatenate(features)[:, 1:].astype(np.float64), starts)
    of_bad = np.repeat(1 - good, lengths)
    weights, trans = _train(x, of_bad, starts, lengths)
    p = marginals(x @ weights, starts, lengths, trans)[0]
    worst = p >= np.repeat(np.maximum.reduceat(p, starts), lengths)
    weights, trans = _train(x, of_bad * ((p > 0.3) | worst), starts, lengths)
    model = QualityModel(weights, trans, np.zeros(2))
    model.calibration = logistic(model.documents(features)[1], good.astype(float), l2=1e-4)
    return model


def score(df: DataFrame, model: QualityModel, name: str, text_col: str = "text") -> DataFrame:
    """`df` with the quality of every row in column `name`. One pass, no shuffle."""
    ship(df.sparkSession)
    return with_scores(df, text_col, name, model.score)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with their columns, whose quality reaches the threshold; all, if labels of both kinds are lacking."""
    name = fresh_name(docs.columns, "quality")
    model = fit(docs, labels)
    if not len(model.weights):
        return docs
    return score(docs, model, name).where(F.col(name) >= threshold).drop(name)
