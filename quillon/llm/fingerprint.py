"""Document fingerprints by content-defined chunking.

A gear hash of the last WINDOW bytes runs over each text; where its leading bits are 0 a chunk ends. Chunking is
normalised: up to NORMAL bytes more bits must be 0, beyond it fewer, and no chunk is shorter than LEAST or longer than
MOST. Boundaries follow the bytes around them, so an insertion shifts the rest of a text without changing its chunks. A
fingerprint is the set of a text's chunk digests with their lengths; likeness is containment, weighted by length: the
share of the first text's (distinct) chunk bytes that the second has too.

All texts of a slab are hashed and cut together, a step for all of them at a time.

Defined results: a null text is an empty one, whose fingerprint is empty; an empty text is contained wholly in an empty
one (1.0) and nothing is contained of it in others (0.0). Repeated rows give repeated rows; their order among
themselves is that of their texts. A table without rows gives none. A text longer than a slab is hashed alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import SLAB_BYTES, mix, span_hashes, utf8
from quillon.runtime import ship

WINDOW, LEAST, NORMAL, MOST = 8, 8, 24, 96
#: Leading zero bits that end a chunk before and after NORMAL bytes.
STRICT, LOOSE = 6, 3
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear(data: np.ndarray) -> np.ndarray:
    """For every byte the gear hash of the WINDOW bytes that end there: sums of shifted table values, by doubling."""
    h, reach = _GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach].copy() << np.uint32(reach) if reach < len(h) else 0
        reach *= 2
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks of the texts that `offsets` marks in `data`."""
    h = gear(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
    strict = np.flatnonzero(h >> np.uint32(32 - STRICT) == 0) + 1
    never = len(data) + MOST + 1
    loose, strict = np.r_[loose, never], np.r_[strict, never]
    text = np.flatnonzero(np.diff(offsets))
    at, stop = offsets[text], offsets[text + 1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(text):
        last = np.minimum(at + MOST, stop)
        middle = np.minimum(at + NORMAL, last)
        early = strict[np.searchsorted(strict, at + LEAST)]
        late = loose[np.searchsorted(loose, at + NORMAL)]
        end = np.where(early <= middle, early, np.minimum(late, last))
        found.append((text, at, end))
        more = end < stop
        text, at, stop = text[more], end[more], stop[more]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def records(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chunk records of every text, ordered by text and record: (text, digest << 8 | length)."""
    data, offsets = utf8(texts)
    text, start, end = chunks(data, offsets)
    rec = (span_hashes(data, start, end) >> np.uint64(24)) << np.uint64(8) | (end - start).astype(np.uint64)
    order = np.lexsort((rec, text))
    text, rec = text[order], rec[order]
    new = np.ones(len(rec), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (text[1:] != text[:-1])
    return text[new], rec[new]


def spelled(text: np.ndarray, rec: np.ndarray, n: int) -> list[str]:
    """The records of each of n texts, 6 bytes each, in base64."""
    raw = np.ascontiguousarray(rec.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
    ends = (np.searchsorted(text, np.arange(n + 1)) * 6).tolist()
    return [base64.b64encode(raw[a:b]).decode() for a, b in zip(ends, ends[1:])]


def contained(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """For each of n texts how much of its records in `a`, by length, `b` has for the same text."""
    weight = (a[1] & np.uint64(255)).astype(np.int64)
    whole = np.bincount(a[0], weight, n)
    text, rec = np.r_[a[0], b[0]], np.r_[a[1], b[1]]
    side = np.r_[np.zeros(len(a[0]), bool), np.ones(len(b[0]), bool)]
    order = np.lexsort((side, rec, text))
    text, rec = text[order], rec[order]
    twice = np.flatnonzero((text[1:] == text[:-1]) & (rec[1:] == rec[:-1]))
    shared = np.bincount(text[twice], (rec[twice] & np.uint64(255)).astype(np.int64), n)
    empty = np.bincount(b[0], minlength=n) == 0
    return np.where(whole > 0, shared / np.maximum(whole, 1), empty.astype(float))


def _rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    n = len(texts)
    edited = [t[: len(t) - (k := len(t) // 3)] + f[:k] for t, f in zip(texts, following)]
    own, new, nxt = records(texts), records(edited), records(following)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array(spelled(*own, n), pa.string()),
        pa.array(spelled(*new, n), pa.string()),
        pa.array(contained(own, new, n), pa.float64()),
        pa.array(contained(own, nxt, n), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, context, doc_id, text) in order: each but a context row is followed by its next document."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            row = (*row[:3], row[3] or "")
            if held and held[-1][1] and held[-1][0] == row[0]:
                continue  # one row follows a block, not all of its id
            held.append(row)
            size += len(row[3])
            if size > SLAB_BYTES // 2:
                pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[1]]
                if pairs:
                    yield _rows([a[2] for a, _ in pairs], [a[3] for a, _ in pairs], [b[3] for _, b in pairs])
                held, size = [held[-1]], len(held[-1][3])
    pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[1]]
    if pairs:
        yield _rows([a[2] for a, _ in pairs], [a[3] for a, _ in pairs], [b[3] for _, b in pairs])


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness; the edit borrows from the next document.

    Rows are dealt once into blocks of consecutive ids, and of texts' beginnings where many rows have one id or none. The
    first row of each block goes to the block before it as well (a row for each block), so every block knows what follows
    its last row. Only ids and beginnings are read to find the blocks. A row finds its block by halving, in a step for each
    doubling of their number.
    """
    spark = ship(df.sparkSession)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # ids in order, the first six bytes of the text behind them; no id is below all
    opening = F.conv(F.rpad(F.hex(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 6)), 12, "0"), 16, 10)
    number = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    key = (number * F.lit(1 << 48).cast("decimal(15,0)") + opening.cast("decimal(15,0)")).cast("decimal(38,0)")
    ends = rows.agg(F.percentile_approx(key, [k / blocks for k in range(1, blocks)], 10 * blocks).alias("x")).first()["x"] if blocks > 1 else []
    ends = sorted({int(e) for e in ends or []}, reverse=True)  # at most one for each block
    block = _passed(key, ends)
    firsts = [(r["b"], int(r["k"])) for r in rows.groupBy(block.alias("b")).agg(F.max(key).alias("k")).orderBy("b").collect()]  # a row for each block
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    first, before = [10**37] * (len(ends) + 1), [0] * (len(ends) + 1)  # no key is so large: a block without rows
    for (b, k), (last, _) in zip(firsts, [firsts[-1], *firsts[:-1]]):  # the block that each block's first row follows
        first[b], before[b] = k, last
    dealt = rows.withColumn("key", key).withColumn("own", _passed(F.col("key"), ends))
    is_first = F.col("key") == F.get(_decimals(first), F.col("own"))
    places = F.when(is_first, F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("context")), F.struct(F.get(F.lit(before), F.col("own")).alias("block"), F.lit(1).alias("context"))))
    places = F.coalesce(places, F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("context"))))
    dealt = dealt.select(F.explode(places).alias("at"), "doc_id", "text", "key").select("at.block", "at.context", "doc_id", "text", "key")
    return dealt.repartitionById(blocks, "block").sortWithinPartitions("block", "context", F.desc("key"), F.desc_nulls_last("text")).drop("key").mapInArrow(_followed, SCHEMA)


def _decimals(values: list[int]) -> Column:
    """One literal array of decimal(38,0)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<decimal(38,0)>")  # folded once, in the plan


def _passed(key: Column, ends: list[int]) -> Column:
    """How many of the falling `ends` are above the key: by halving, so its work and form grow with the logarithm of their number."""
    if not ends:
        return F.lit(0)
    steps = [1 << k for k in range(len(ends).bit_length() - 1, -1, -1)]
    limits = _decimals(ends)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(limits, at + step - 1) > key, F.lit(False)), at + step).otherwise(at))
