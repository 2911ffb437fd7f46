"""Best-fit packing by patterns: few-document length patterns, fitted to the length histogram by non-negative least squares.

1. Documents become token ids (words' ids kept by the worker); only those longer than a sequence are cut, into full
   pieces and a last, shorter one. Pieces are narrow rows, written once to the shared folder.
2. Their lengths make a histogram of at most `capacity` numbers, whatever the number of documents.
3. The driver enumerates patterns of up to three lengths that fill a sequence exactly, fits how often each is repeated
   by non-negative least squares (accelerated projected gradient: every pattern column has three entries), rounds as
   far as the histogram lasts, and packs the residual lengths, largest first, each into the fullest place it fits,
   of a short length as many to a sequence as it has room for.
4. The outcome is a list of (pattern, repeats); of each length a run of places. A piece takes the place of its rank
   among the pieces of its length. Ranks are counted in salted groups, so a frequent length is no single task's work.

Defined results: a null or empty text is the closing id alone, a piece of length 1; repeated rows are packed one by one,
in any order among themselves; a table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.batches import slabs
from quillon.llm.bpe_count import Counter, looked_up
from quillon.runtime import cut, ship

#: Words kept by a worker; beyond that the later half goes.
KEPT = 1_000_000
#: Groups that a length's pieces are ranked in.
SALTS = 64
#: Steps of the least-squares fit.
STEPS = 300
#: Repeats from which a pattern is used; of the plans that they give the shorter is kept.
ROUNDED_FROM = (0.3, 1.0)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes; those of words are kept.

    Texts in which added tokens occur go through the library; the words of all others are merged as for token counts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.cutter = Counter(path)
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        cut, distinct = self.cutter.pieces_of(new)
        ids, n = self.cutter.encode(distinct)
        raw, ends = ids.astype("<u4").tobytes(), [0, *(np.cumsum(n) * 4).tolist()]
        of = [raw[a:b] for a, b in zip(ends, ends[1:])]
        self.known.update(zip(new, [of[c[0]] if len(c) == 1 else b"".join([of[k] for k in c]) for c in cut]))

    def texts(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cutter.cut(t) for t in texts]
        found = looked_up(self.known, [[] if c[1] else c[0] for c in cuts], self.learn, KEPT)
        return [b"".join(f) if not c[1] else np.array(self.lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for f, c, t in zip(found, cuts, texts)]


_WORD_IDS: dict[str, WordIds] = {}


def tokenized_pieces(df: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str, closing: int = 0) -> DataFrame:
    """Every document's pieces of at most `capacity` ids, without the ids themselves."""
    end = np.uint32(closing).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _WORD_IDS:
            _WORD_IDS[vocabulary] = WordIds(vocabulary)
        ids_of = _WORD_IDS[vocabulary]
        width = 4 * capacity
        for part in slabs(batches, "text"):
            out: list[tuple] = []
            for doc, raw in zip(part.column(0).to_pylist(), ids_of.texts([t or "" for t in part.column(1).to_pylist()])):
                raw += end
                out += [(doc, k, k * capacity, min(len(raw) - k * width, width) // 4, crc := zlib.crc32(raw[k * width : (k + 1) * width]), crc % SALTS if doc is None else (doc * 0x9E3779B1 >> 7) % SALTS) for k in range(-(-len(raw) // width))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of lengths in `present` with a sum of `capacity`; c, and b too, may be 0: no document."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    found = [np.zeros((0, 3), np.int64)]
    for b in np.flatnonzero(have[: capacity // 2 + 1]).tolist():  # row by row: memory follows the patterns, not the square of the capacity
        c = np.flatnonzero(have[: min(b, capacity - 2 * b) + 1])
        a = capacity - b - c
        keep = have[a] & (a >= b) & (a > 0)
        found.append(np.stack([a[keep], np.full(int(keep.sum()), b), c[keep]], axis=1))
    return np.concatenate(found)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise the squared error of A x against the histogram, rows weighted by length.

    Longer lengths weigh more: they are harder to place later. Columns are scaled by the step that their entries allow.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / size)
    weight[0] = 0.0
    cols = patterns.T

    def forward(x):
        return weight * sum(np.bincount(c, x, size) for c in cols)

    def back(r):
        r = weight * r
        return sum(r[c] for c in cols)

    # a bound of the largest eigenvalue of A'A, by power steps
    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    step = 1.0 / (1.05 * (top or 1.0))
    x = y = np.zeros(len(patterns))
    target, t = weight * histogram, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(forward(y) - target))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan_packing(histogram: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) that hold every piece of the histogram (index: length) just once."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    x = fit_repeats(patterns, left.astype(float), steps) if len(patterns) else np.zeros(0)
    order = np.argsort(-x, kind="stable")
    plans = [_rounded(patterns[order[: int((x >= least).sum())]], x[order], left, capacity) for least in ROUNDED_FROM]
    return plan + min(plans, key=lambda p: sum(n for _, n in p))


def _rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The patterns' repeats, rounded down but at least 1, as far as lengths last; the residual lengths best-fit."""
    left, plan = left.copy(), []
    for k, row in enumerate(patterns.tolist()):
        parts = tuple(v for v in row if v)
        n = min(max(1, int(x[k])), *(int(left[v]) // parts.count(v) for v in parts))
        if n > 0:
            plan.append((parts, n))
            for v in parts:
                left[v] -= n
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The lengths, largest first, each into the fullest sequence that has room for it; equal sequences move as one.

    The fullest sequence stays the fullest while it takes pieces of one length: it takes all that it has room for, then
    the next does, and a new one is opened only where none has room. Each length adds two groups of sequences at most.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room -> sequences' lengths -> how many
    rooms = np.zeros(capacity + 1, bool)
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(group: tuple[int, ...], room: int, count: int) -> None:
        if not room:
            closed.append((group, count))
        else:
            of = open_.setdefault(room, {})
            of[group] = of.get(group, 0) + count
            rooms[room] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                group, count = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
                    rooms[room] = False
            else:
                group, room, count = (), capacity, n
            each = room // length
            full = min(n // each, count)
            rest = min(n - full * each, each - 1) if full < count else 0
            if full:
                put(group + (length,) * each, room - each * length, full)
            if rest:
                put(group + (length,) * rest, room - rest * length, 1)
            if group and (same := count - full - (rest > 0)):
                put(group, room, same)
            n -= full * each + rest
    return closed + [(g, n) for of in open_.values() for g, n in of.items()]


def places_of(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For every length the runs of places, in order: the first rank, sequence and offset of each run."""
    rows, first = [], 0
    for parts, n in plan:
        offset = 0
        for v in parts:
            rows.append((v, n, first, offset))
            offset += v
        first += n
    length, n, seq, offset = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    order = np.argsort(length, kind="stable")
    length, n, seq, offset = length[order], n[order], seq[order], offset[order]
    before = np.cumsum(n) - n  # places of all runs before, over all lengths
    starts = np.searchsorted(length, np.arange(capacity + 2))
    base = np.r_[before, n.sum()][starts]  # the first place of each length
    return {"before": before, "seq": seq, "offset": offset, "base": base}


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows that move are narrow (no text, no ids). The places' table has at most as many runs as there are patterns of
    `capacity` and residual groups: its size is bounded by `capacity`, not by the number of documents.
    """
    spark = ship(df.sparkSession)
    pieces = cut(tokenized_pieces(df, vocabulary, capacity, id_col, text_col), "pieces")
    groups = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    for length, salt, n in pieces.groupBy("length", "salt").count().collect():  # capacity x SALTS rows at most
        groups[length, salt] = n
    placed = places_of(plan_packing(groups.sum(axis=1), capacity, steps), capacity)
    placed["salted"] = np.cumsum(groups, axis=1) - groups
    shared = spark.sparkContext.broadcast(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, salt, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            at = p["base"][length] + p["salted"][length, salt] + rank
            k = np.searchsorted(p["before"], at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p["seq"][k] + at - p["before"][k], pa.int64()), pa.array(p["offset"][k], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return pieces.withColumn("rank", rank.cast("bigint")).mapInArrow(run, PLACED)
