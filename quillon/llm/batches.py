"""Arrow batches in slabs of bounded size, and hashing of whole slabs with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slab of its own.
SLAB_BYTES = 2_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def slabs(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches whose `column` (strings) holds about `limit` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64, kept between calls."""
    if len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[k] = p
    return _POWERS[0], _POWERS[1]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], dependent on the bytes and their number alone, by differences of one running polynomial."""
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the len(texts) + 1 offsets of their ends."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=offsets[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets


def fresh_name(taken: list[str], name: str) -> str:
    """`name`, with underscores before it until no column of `taken` has it (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def with_scores(df, text_col: str, name: str, score):
    """`df` with a double column: score(texts) of each batch's texts, null texts given as empty. All columns pass unread."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    k = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slabs(batches, df_columns[k]):
            found = score([t or "" for t in part.column(k).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*df_columns, name])

    df_columns = list(df.columns)
    return df.mapInArrow(run, schema)


def labelled_sample(docs, labels, label_col: str, limit: int, remainder: tuple[int, int], id_col: str = "doc_id", text_col: str = "text"):
    """(text, label 0/1) of about `limit` rows at most, picked by a hash of the id among those that may be learnt from.

    remainder (m, r): ids whose CRC-32 leaves r when divided by m are held out. The labels that are kept number `limit`
    at most, whatever the input, so they are broadcast and the texts don't move. Contradicting labels of an id count as
    the larger one. Of documents that share an id one is taken, that of the least hash of its text.
    """
    from pyspark.sql import functions as F

    m, r = remainder
    known = labels.select(F.col(id_col).cast("bigint").alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("key").cast("string")) % m != r).groupBy("key").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, limit / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("bigint").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = texts.join(F.broadcast(picked), "key")
    # ids may repeat, a third of all rows may share one: the hash that stands for an id is found map-side
    least = F.broadcast(told.groupBy("key").agg(F.min(F.xxhash64("text")).alias("least")))  # `limit` rows at most
    once = told.join(least, "key").where(F.xxhash64("text") == F.col("least"))
    return once.groupBy("key").agg(F.max("text").alias("text"), F.max("label").alias("label")).select("text", "label")
