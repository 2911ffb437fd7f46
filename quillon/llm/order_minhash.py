"""Near-duplicates of documents by Order MinHash.

A text's k-mers are its runs of k words, labelled by occurrence, so each is distinct. Each of a family's random orders
picks the smallest `keep` labelled k-mers of a text and keeps them in the order of the text: two texts agree on a sketch
if they share these k-mers in the same order, which falls with their edit distance, not only with the set they share.
Texts that agree on any sketch meet in a bucket. There are three FAMILIES:

* runs of five words, two of them: copies with few edits;
* single words, seven of them: where one word in five is edited, wherever the edits are, 0.8 n of 1.2 n labelled words
  are shared, so a sketch agrees with a probability of 0.0585 and one of 80 with 0.99 (runs of five words may all be
  hit). Unlike texts share common words, but seven of them in one order only by chance: to share a fifth of the words is
  to agree with a probability of 2.5e-9;
* single words, four of them, of texts of at most SHORT words, which have too few words for seven.

Below 10 words the threshold of 0.8 leaves one edit at most, and such texts meet for certain: by their words, and by
their words without any one of them.

Candidates are verified by banded alignment of their words: similarity is 1 - d / (words of the longer text), d the edit
distance, computed bit-parallel in a window that moves along the band which the threshold allows. Links join documents
into classes.

Equal texts are one representative from the start. A bucket's least member is its pivot. Representatives are compared
with one pivot in each of STARS rounds, the least that they meet and are not connected with, then with all such pivots
that are left; so a class of thousands of near copies costs about as many comparisons as it has members, and as many
links. In buckets where some member is not connected after that, the rest is done exactly: members' word histograms,
in tiles of bounded size, give a lower bound of d for every pair that isn't connected, and the pairs that it leaves open
are aligned as well, each member's FIRST of least bounds before all others: most members are connected by then, and need
no more alignments. No pair that meets is lost, and no task gathers a bucket. Members of a bucket's largest class meet
only those outside it, so a large class with a few strangers stays linear.

Defined results: a null text is an empty one, and empty texts are equal; words are parted by ASCII white space; a class
is named by its least id, null if it has none; just one row of each class is kept, of repeated rows any one; a table
without rows gives none. Texts are compared whole, whatever their length. A threshold below 0.8 loses more pairs than
said above. Texts that are much alike but not enough (0.75, say) and share most sketches are aligned pair by pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.batches import fresh_name, mix, slabs, span_hashes, utf8
from quillon.llm.components import joined
from quillon.runtime import cut, forget, ship

#: Words of a k-mer, k-mers of a sketch, sketches, and the most words of a text that has them (0: any).
SHORT = 60
FAMILIES = ((5, 2, 16, 0), (1, 7, 80, 0), (1, 4, 32, SHORT))
#: Texts of at most so many words meet by what is left without one of them, from the least that the threshold leaves an edit.
FEW, LEAST_EDITED = 9, 5
THRESHOLD = 0.8
#: Cells of a word histogram (the first few for short words) and of folded ones that are compared first, and members of a tile's block, about.
CELLS, SHORT_CELLS, COARSE, TILE = 1024, 128, (16, 64, 256), 4096
#: Rounds in which a text is compared with one pivot; the last takes all that are left.
STARS = 2
#: Open pairs of a member that are aligned in a first round; all that are open still follow in a second.
FIRST = 4
#: Tiles of at most so many rows are compared together; rows that a worker holds at least before it does so.
FEW_ROWS, HELD_ROWS = 16, 8192
_U = np.uint64
_N = np.arange(1, sum(f[2] for f in FAMILIES) + 1, dtype=np.uint64)
_ODD = mix(_N * _U(0xA24BAED4963EE407)) | _U(1)
_XOR = mix(_N * _U(0x9FB21C651E98DF25))
_HALF, _MOST = _U(32), _U(0xFFFFFFFF)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of all words of the texts end to end in `data`, and the number of words before each text and in all."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, solid[:-1]] if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.r_[solid[1:], False] if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all texts' words, words before each text and in all, histograms)."""
    data, offsets = utf8(texts)
    starts, ends, bounds = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    cell = np.where(ends - starts < 5, words % _U(SHORT_CELLS), _U(SHORT_CELLS) + words % _U(CELLS - SHORT_CELLS)).astype(np.int64)
    histograms = np.empty((len(texts), CELLS), np.uint8)
    for k in range(0, len(texts), 2048):  # whole numbers for some texts at a time
        some = slice(bounds[k], bounds[min(k + 2048, len(texts))])
        part = histograms[k : k + 2048]
        part[:] = np.minimum(np.bincount((text[some] - k) * CELLS + cell[some], minlength=part.size), 255).reshape(part.shape)
    return words, bounds, histograms


def labelled_kmers(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' occurrence-labelled runs of `size` words in text order, runs before each text and in all)."""
    n = np.diff(bounds)
    run = words.copy()
    for k in range(1, size):  # k-mers as sums of their words' hashes, each turned by its place
        run[: len(words) - k] += mix(words[k:] + _U(k))
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(words)) - np.repeat(bounds[:-1], n) <= np.repeat(np.maximum(n - size, 0), n)
    short = np.flatnonzero((n > 0) & (n < size))
    for t in short.tolist():  # fewer words than a k-mer has: all of them are one
        a, b = bounds[t], bounds[t + 1]
        run[a : a + 1] = _in_order(words[a:b])
        inside[a + 1 : b] = False
    kmer, text = mix(run[inside]), text[inside]
    order = _grouped(kmer, text)
    k, t = kmer[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.arange(len(k))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    again = nth > 0
    kmer[order[again]] = mix(kmer[order[again]] + nth[again].astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    return kmer, np.searchsorted(text, np.arange(len(n) + 1))


def _grouped(kmer: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions in an order that brings a text's equal k-mers together, as they follow each other in the text.

    Sorted are numbers, not indices: a hash of text and k-mer, the position in the low bits. Where two different k-mers
    have one hash (a few slabs in a thousand), indices are sorted by text and k-mer themselves.
    """
    low = _U(max(len(kmer), 2).bit_length())
    mark = (_U(1) << low) - _U(1)
    if low <= 24:
        key = np.sort(mix(kmer + text.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) & ~mark | np.arange(len(kmer), dtype=np.uint64))
        order = (key & mark).astype(np.int64)
        near = np.flatnonzero(key[1:] >> low == key[:-1] >> low)
        a, b = order[near], order[near + 1]
        if ((kmer[a] == kmer[b]) & (text[a] == text[b])).all():
            return order
    return np.lexsort((kmer, text))


def _in_order(words: np.ndarray) -> np.ndarray:
    """One hash of some words in their order."""
    return words[:1] + mix(words[1:] + np.arange(1, len(words), dtype=np.uint64)).sum(dtype=np.uint64)


def least_in_order(kmer: np.ndarray, bounds: np.ndarray, keep: int, first: int, many: int) -> np.ndarray:
    """Hashes of the `keep` least k-mers of each text in their order, in a row for each text, for orders first to first + many.

    bounds: the k-mers before each text, and in all; every text has `keep` at least. Orders compare 32 bits (of equal ones
    that which comes first is less). Only k-mers below a text's share are sorted, about three times as many as are kept;
    where that gives too few, all are.
    """
    sizes = np.diff(bounds)
    out = np.empty((len(sizes), many), dtype=np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    share = np.minimum(1.0, (3 * keep + 8) / sizes)
    limit = np.repeat((share * float(_MOST)).astype(np.uint32), sizes)
    half, h, under = (kmer >> _HALF).astype(np.uint32), np.empty(len(kmer), np.uint32), np.empty(len(kmer), bool)
    for k in range(many):
        np.bitwise_xor(half, np.uint32(_XOR[first + k] >> _HALF), out=h)
        np.multiply(h, np.uint32(_ODD[first + k] & _MOST), out=h)
        np.less_equal(h, limit, out=under)
        at = np.flatnonzero(under)
        found = np.bincount(text[at], minlength=len(sizes))
        if (found < keep).any():
            at = np.flatnonzero(under | (found < keep)[text])
            found = np.bincount(text[at], minlength=len(sizes))
        at = at[_sorted_within(text[at], h[at])]
        start = np.cumsum(found) - found
        picked = np.sort(at[start[:, None] + np.arange(keep)], axis=1)  # the order of the text
        sketch = np.full(len(sizes), _ODD[first + k])
        for j in range(keep):
            sketch = mix(sketch * _U(3) + kmer[picked[:, j]])
        out[:, k] = sketch
    return out


def _sorted_within(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices by text, then by 32-bit hash, then by position; `text` doesn't fall. Sorts numbers, not indices, where they fit."""
    low = max(len(text), 2).bit_length()
    if low + 32 + int(text[-1]).bit_length() > 64:
        return np.lexsort((h, text))
    key = text.astype(np.uint64) << _U(32 + low) | h.astype(np.uint64) << _U(low) | np.arange(len(text), dtype=np.uint64)
    return (np.sort(key) & (_U(1) << _U(low)) - _U(1)).astype(np.int64)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number of words, histogram, signed bucket names) of each text."""
    words, word_bounds, histograms = hashed_words(texts)
    n = np.diff(word_bounds)
    names: list[list[np.ndarray]] = [[] for _ in texts]
    first, known = 0, {}
    for size, keep, many, most in FAMILIES:
        mine = np.flatnonzero((n >= size + keep - 1) & ((n <= most) if most else True))
        if len(mine):
            if size not in known:
                known[size] = labelled_kmers(words, word_bounds, size)
            kmer, bounds = known[size]
            inside = np.repeat(np.isin(np.arange(len(texts)), mine), np.diff(bounds))
            sizes = np.diff(bounds)[mine]
            for t, row in zip(mine.tolist(), least_in_order(kmer[inside], np.r_[0, np.cumsum(sizes)], keep, first, many).view(np.int64)):
                names[t].append(row)
        first += many
    for t in np.flatnonzero((n >= 1) & (n <= FEW)).tolist():
        names[t].append(_short_keys(words[word_bounds[t] : word_bounds[t + 1]]))
    return n, histograms, [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in names]


def _short_keys(words: np.ndarray) -> np.ndarray:
    """Signed hashes of a short text's words and, if it has enough, of what is left without one: equal for texts one edit apart."""
    rests = [words] + [np.delete(words, k) for k in range(len(words)) if len(words) >= LEAST_EDITED]
    return mix(np.concatenate([_in_order(r) for r in rests]) ^ _XOR[0]).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slabs(batches, "text", 1_500_000):
        n, h, names = sketches([t or "" for t in part.column(2).to_pylist()])
        ends = np.r_[0, np.cumsum([len(x) for x in names])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*names, np.zeros(0, np.int64)]), pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), lists, pa.array([r.tobytes() for r in h], pa.binary())], ["id", "digest", "n", "sk", "histogram"])


def word_ids(a: str, b: str) -> tuple[list[int], list[int]]:
    """Both texts as lists of numbers, equal for equal words, without their common beginning and end."""
    x, y = a.split(), b.split()
    k, most = 0, min(len(x), len(y))
    while k < most and x[k] == y[k]:
        k += 1
    e = 0
    while e < most - k and x[-1 - e] == y[-1 - e]:
        e += 1
    ids: dict[str, int] = {}
    return [ids.setdefault(w, len(ids)) for w in x[k : len(x) - e]], [ids.setdefault(w, len(ids)) for w in y[k : len(y) - e]]


def banded_distance(x: list[int], y: list[int], most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, by bit-parallel columns of the band alone.

    The shorter sequence stands upright. A path of at most `most` edits stays on the diagonals from `above` over the main
    one to `below` under it, so each column is a window of that many bits which moves down by one row at a time; what lies
    outside is taken as one worse than its neighbour, which never is too little. The end's diagonal is one bit of the
    window, and never falls.
    """
    if len(x) > len(y):
        x, y = y, x
    longer = len(y) - len(x)
    if longer > most:
        return None
    above, below = (most + longer) // 2, (most - longer) // 2
    size = above + below + 1
    places: dict[tuple[int, int], int] = {}  # by value and block of `size` rows; rows before the first one are empty
    for k, v in enumerate(x, above):
        key = v, k // size
        places[key] = places.get(key, 0) | 1 << k % size
    mask, top, end = (1 << size) - 1, 1 << size - 1, 1 << above - longer
    pos, neg, score = mask ^ ((1 << above) - 1), 0, 0
    block = turn = 0
    get = places.get
    for v in y:
        eq = (get((v, block), 0) >> turn | get((v, block + 1), 0) << size - turn) & mask
        zero = ((eq & pos) + pos ^ pos | eq | neg) & mask
        if not zero & end:
            score += 1
            if score > most:
                return None
        ph = (neg | mask & ~(zero | pos)) << 1 | 1
        pos = ((pos & zero) << 1 | mask & ~(zero | ph)) & mask
        neg = ph & zero
        pos, neg = pos >> 1 | top, neg >> 1  # the next column's window
        turn += 1
        if turn == size:
            block, turn = block + 1, 0
    return score


def compared(a: str, b: str, threshold: float) -> int | None:
    """The word edit distance, if it is within the threshold."""
    na, nb = len(a.split()), len(b.split())
    most = int((1 - threshold) * max(na, nb) + 1e-9)
    x, y = word_ids(a, b)
    shared = sum((Counter(x) & Counter(y)).values())
    if max(len(x), len(y)) - shared > most:
        return None
    return banded_distance(x, y, most)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slabs(batches, "tb"):
            dist = [compared(a, b, threshold) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dist, pa.int32())], ["a", "b", "dist"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b, dist of the pairs. texts: id, text of all that may occur in pairs."""
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verified(threshold), "a bigint, b bigint, dist int"), "verified")


def classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the class's least id), kept (whether the row is the one to keep), n_words and digest of every row."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), _digest(text).alias("digest"), text.alias("text"))
    narrow = cut(rows.mapInArrow(_sketched, "id bigint, digest binary, n int, sk array<bigint>, histogram binary"), "sketches")
    # a text is named by its least id; where another text has that id too, or there is none, by a hash of itself
    least = cut(narrow.groupBy("digest").agg(F.min("id").alias("least")), "least")
    twice = least.groupBy("least").agg(F.count("*").alias("uses")).where("uses > 1 or least is null").select("least", F.lit(True).alias("vague"))
    named = F.when(F.col("least").isNull() | F.col("vague"), F.xxhash64("digest")).otherwise(F.col("least"))
    names = cut(least.join(twice, "least", "left").select("digest", "least", named.alias("rep")), "names")
    own = F.col("id").eqNullSafe(F.col("least"))
    reps = narrow.join(names, "digest").where(own).select("rep", "n", "sk", "histogram")  # more than once where a row is repeated
    members = cut(_members(reps), "members")
    roots = None
    if not members.isEmpty():
        candidates = members.select("rep").distinct()
        shown = cut(reps.join(candidates, "rep", "left_semi").groupBy("rep").agg(F.first("n").alias("n"), F.first("histogram").alias("histogram")), "histograms")
        wanted = names.join(candidates, "rep")
        texts = rows.join(wanted, "digest").where(own).select(F.col("rep").alias("id"), "text")
        texts = cut(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")
        whole, narrow = narrow, cut(narrow.select("id", "digest", "n"), "rows")
        forget(whole)  # sketches and histograms are a large part of what is on the disk
        stars = cut(_stars(members, shown, threshold), "stars")
        known = None
        for k in range(STARS):
            mine = stars if known is None else _apart(stars.join(known.select("a", "b"), ["a", "b"], "left_anti"), roots)
            pairs = mine.select("a", "b") if k + 1 == STARS else mine.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            found = _verify(pairs, texts, threshold)
            known = found if known is None else known.union(found)
            roots = joined(roots, found.where("dist is not null").select("a", "b"))
        wide = None
        for width in (FIRST, None):
            seen = Observation()
            open_ = _open_pairs(members, roots, shown, threshold, width, wide).observe(seen, F.count("a").alias("n"), F.count("bucket").alias("more"))
            open_ = cut(open_, "open")
            if seen.get["n"]:
                found = _verify(open_.where("a is not null").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), texts, threshold)
                known = known.union(found)
                roots = joined(roots, found.where("dist is not null").select("a", "b"))
            if not seen.get["more"]:
                break
            wide = open_.where("bucket is not null").select("bucket").distinct()
    of_text = names.withColumn("root", F.col("rep")) if roots is None else names.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    of_text = cut(of_text.select("digest", "least", "root"), "roots_of_texts")
    named = of_text.groupBy("root").agg(F.min("least").alias("class_id"))
    of_text = of_text.join(cut(named, "names"), "root").select("digest", "root", "class_id")
    out = cut(narrow.select("id", "digest", "n").join(of_text, "digest"), "classes")
    named = F.col("id").eqNullSafe(F.col("class_id"))
    first = F.row_number().over(Window.partitionBy("root").orderBy("digest")) == 1
    both = out.where(named).withColumn("kept", first).union(out.where(~named).withColumn("kept", F.lit(False)))
    return both.select("id", "class_id", "kept", F.col("n").alias("n_words"), "digest")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, without all but one of each class."""
    names = [fresh_name(docs.columns, n) for n in ("key", "digest", "nth")]
    key, digest, nth = names
    chosen = classes(docs, threshold, id_col, text_col).where("kept").select(F.col("id").alias(key), F.col("digest").alias(digest))
    keyed = docs.withColumns({key: F.col(id_col).cast("bigint"), digest: _digest(F.col(text_col))})
    mine = keyed.alias("d").join(chosen.alias("c"), F.col(f"d.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col(f"d.{digest}") == F.col(f"c.{digest}")), "left_semi")
    # equal rows are one: the join has dealt the rows by these columns already
    return mine.withColumn(nth, F.row_number().over(Window.partitionBy(digest, key).orderBy(F.lit(0)))).where(F.col(nth) == 1).drop(*names)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _members(reps: DataFrame) -> DataFrame:
    """bucket, rep and pivot (the bucket's least) of representatives that share a bucket with another.

    Both sides of the join have the same columns dealt the same way, so the sketches are written to a shuffle once.
    """
    all_ = reps.select("rep", F.explode("sk").alias("bucket")).repartition("bucket")
    shared = all_.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("high")).where("pivot != high").select("bucket", "pivot")
    return all_.join(shared, "bucket").select("bucket", "rep", "pivot")


def _stars(members: DataFrame, shown: DataFrame, threshold: float) -> DataFrame:
    """a, b: each pivot and representative that share a bucket, if their lengths allow a link."""
    sizes = shown.select(F.col("rep").alias("a"), F.col("n").alias("na")), shown.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = members.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    near = F.abs(F.col("na") - F.col("nb")) <= (1 - threshold) * F.greatest("na", "nb") + 1e-9
    return pairs.join(sizes[1], "b").join(sizes[0], "a").where(near).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not connected."""
    of = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    both = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _open_pairs(members: DataFrame, roots: DataFrame, shown: DataFrame, threshold: float, width: int | None, wide: DataFrame | None) -> DataFrame:
    """a, b: pairs (a < b) of a bucket that are not connected and that histograms leave open, from buckets in parts; and
    rows of a bucket alone, of those that have more. wide: the only buckets to look at.

    Of each member's pairs in a bucket the `width` with the least bounds are given (all for None). The members of a
    bucket's largest class are dealt into blocks 0 to c, all others into blocks c + 1 and on; a tile is any two blocks but
    two of the former. Of buckets with the same members one is looked at, and of all that a pair shares only the least
    gives it, so a pair comes out once however many sketches agree.
    """
    root = roots.select(F.col("node").alias("rep"), "root")
    members = members if wide is None else members.join(wide, "bucket", "left_semi")
    labelled = members.select("bucket", "rep").distinct().join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sums = [F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("xor"), F.count("*").alias("size")]
    parts = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), *sums).where("low != high")
    parts = parts.groupBy("size", "sum", "xor").agg(F.min("bucket").alias("bucket")).select("bucket")
    mixed = cut(labelled.join(parts, "bucket"), "mixed")
    by_root = mixed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    by_bucket = by_root.groupBy("bucket").agg(F.max_by("root", "size").alias("main"), F.max("size").alias("inner"), F.sum("size").alias("size"))
    count = lambda c: F.ceil(c / TILE).cast("int")
    blocks = by_bucket.select("bucket", "main", count(F.col("inner")).alias("of_main"), count(F.col("size") - F.col("inner")).alias("of_rest"))
    inside = F.col("root") == F.col("main")
    at = F.pmod(F.xxhash64("rep"), F.when(inside, F.col("of_main")).otherwise(F.col("of_rest"))).cast("int")
    placed = mixed.join(blocks, "bucket").withColumn("block", at + F.when(inside, 0).otherwise(F.col("of_main")))
    others = F.sequence(F.when(inside, F.col("of_main")).otherwise(0), F.col("of_main") + F.col("of_rest") - 1)
    meets = placed.withColumn("with", F.explode(others)).select("bucket", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "rep", "root")
    tasks = int(meets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work follows a tile's pairs, not its bytes
    own = mixed.groupBy("rep").agg(F.collect_set("bucket").alias("own"))  # no more than a text has sketches
    full = meets.join(shown.join(own, "rep"), "rep").repartition(tasks, "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "n")
    return full.select("bucket", "one", "two", "block", "rep", "root", "n", "histogram", "own").mapInArrow(_bounded(threshold, width), "a bigint, b bigint, bucket bigint").distinct()


@dataclass
class _Rows:
    """Rows of whole tiles, in the order of tiles and of words: their bucket, tile, block, name, root, number of words, histogram."""

    bucket: np.ndarray
    tile: np.ndarray
    block: np.ndarray
    rep: np.ndarray
    root: np.ndarray
    n: np.ndarray
    histogram: np.ndarray
    own: list[np.ndarray]  # the buckets that are looked at and that the row is in
    within: np.ndarray  # whether the tile is a block with itself

    def __post_init__(self):
        # folded cells give a weaker bound, and leave few pairs to the others
        self.cells = [self.histogram.reshape(len(self.histogram), k, -1).sum(2, dtype=np.int16) for k in COARSE] + [self.histogram]

    def given_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs' buckets are the least that both rows are in."""
        sets: dict[int, frozenset[int]] = {}

        def of(k: int) -> frozenset[int]:
            if k not in sets:
                sets[k] = frozenset(self.own[k].tolist())
            return sets[k]

        out = np.empty(len(a), bool)
        for k in range(0, len(a), 65_536):
            s = slice(k, k + 65_536)
            out[s] = [min(of(i) & of(j)) == bucket for i, j, bucket in zip(a[s].tolist(), b[s].tolist(), self.bucket[a[s]].tolist())]
        return out

    def slack(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """How many edits the threshold allows."""
        return (1 - threshold) * np.maximum(self.n[a], self.n[b]) + 1e-9

    def least(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, least number of edits) of those pairs that the histograms leave open: the surplus of words on either side."""
        low = np.zeros(len(a), np.int64)
        for h in self.cells:
            low = np.empty(len(a), np.int64)
            for k in range(0, len(a), 16_384):
                gap = h[b[k : k + 16_384]] - h[a[k : k + 16_384]]
                up = np.maximum(gap, 0).sum(1)
                low[k : k + 16_384] = np.maximum(up, up - gap.sum(1))
            keep = low <= self.slack(a, b, threshold)
            a, b, low = a[keep], b[keep], low[keep]
        return a, b, low


def _bounded(threshold: float, width: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tiles(batches):
            starts = np.flatnonzero(np.r_[True, rows.tile[1:] != rows.tile[:-1]])
            ends = np.r_[starts[1:], len(rows.tile)]
            large = [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a > FEW_ROWS]
            for a, b, more in chain([_in_small_tiles(rows, starts, ends, threshold, width)], *[_in_tile(rows, *t, threshold, width) for t in large]):
                here = rows.given_here(a, b)
                one, two = rows.rep[a[here]], rows.rep[b[here]]
                yield _as_batch(one, two, more)

    return run


def _as_batch(one: np.ndarray, two: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Pairs, and after them the buckets that have more."""
    pairs, gap = [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], pa.nulls(len(more), pa.int64())
    columns = [pa.concat_arrays([pairs[0], gap]), pa.concat_arrays([pairs[1], gap]), pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(more, pa.int64())])]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket"])


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """The rows of a partition, which is ordered by tiles, in lots of about HELD_ROWS; a tile is never parted."""
    held: list[list[np.ndarray]] = []
    size = 0

    def made(columns: list[np.ndarray]) -> _Rows:
        bucket, one, two, block, rep, root, n, histogram, own = columns
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        return _Rows(bucket, np.cumsum(new), block, rep, root, n, histogram, own, one == two)

    for batch in batches:
        if not batch.num_rows:
            continue
        hist = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        lists = batch.column(8)
        ends, flat, own = lists.offsets.to_numpy(), lists.values.to_numpy(), np.empty(batch.num_rows, object)
        own[:] = [flat[a:b] for a, b in zip(ends, ends[1:])]
        held.append([*[batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)], hist, own])
        size += batch.num_rows
        if size >= HELD_ROWS:
            columns = [np.concatenate(c) for c in zip(*held)]
            inner = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            if len(inner):
                yield made([c[: inner[-1]] for c in columns])
                columns = [c[inner[-1] :] for c in columns]
            held, size = [columns], len(columns[0])
    if size:
        yield made([np.concatenate(c) for c in zip(*held)])


def _in_small_tiles(rows: _Rows, starts: np.ndarray, ends: np.ndarray, threshold: float, width: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, buckets that have more) of open pairs in all tiles of at most FEW_ROWS rows at once."""
    sizes = ends - starts
    end = np.repeat(ends, sizes)
    after = np.where(np.repeat(sizes <= FEW_ROWS, sizes), end - np.arange(len(end)) - 1, 0)
    a = np.repeat(np.arange(len(end)), after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    keep = (rows.root[a] != rows.root[b]) & (rows.within[a] | (rows.block[a] != rows.block[b])) & (np.abs(rows.n[a] - rows.n[b]) <= rows.slack(a, b, threshold))
    a, b, low = rows.least(a[keep], b[keep], threshold)
    first = np.ones(len(a), bool) if width is None else _is_first(a, low, width) | _is_first(b, low, width)
    return a[first], b[first], np.unique(rows.bucket[a[~first]])


def _in_tile(rows: _Rows, start: int, end: int, threshold: float, width: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As above in one tile, in lots of about HELD_ROWS pairs, row by row: of each row's pairs in its turn the least ones.

    Rows of the tile's largest class need no turn, as every pair has another.
    """
    n, root, block = rows.n[start:end], rows.root[start:end], rows.block[start:end]
    names, sizes = np.unique(root, return_counts=True)
    main = names[sizes.argmax()]
    found, held, none = [], 0, rows.bucket[:0]
    for f in np.flatnonzero(root != main):
        lo = np.searchsorted(n, threshold * n[f] - 1e-9, side="left")
        hi = np.searchsorted(n, n[f] / threshold + 1e-9, side="right")
        at = np.arange(lo, hi)
        at = at[(root[at] != root[f]) & (rows.within[start] | (block[at] != block[f])) & ((root[at] == main) | (at > f))]
        if len(at):
            a, b, low = rows.least(np.full(len(at), start + f), start + at, threshold)
            best = slice(None) if width is None or len(a) <= width else np.argsort(low, kind="stable")[:width]
            found.append((a[best], b[best], none if width is None or len(a) <= width else rows.bucket[start : start + 1]))
            held += len(found[-1][0])
            if held >= HELD_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*found))
                found, held = [], 0
    if found:
        a, b, more = (np.concatenate(x) for x in zip(*found))
        yield a, b, np.unique(more)


def _is_first(row: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Whether each pair is one of the `width` least of its row."""
    order = np.lexsort((low, row))
    new = np.r_[True, row[order][1:] != row[order][:-1]] if len(row) else np.zeros(0, bool)
    at = np.arange(len(row))
    rank = at - np.maximum.accumulate(np.where(new, at, 0)) if len(row) else at
    out = np.empty(len(row), bool)
    out[order] = rank < width
    return out
