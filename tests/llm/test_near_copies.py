import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, embed_dedup, order_minhash as o


def by_search(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    r = random.Random(0)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    want = by_search(500, links)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_distance(x, y):
    p = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        q = [i]
        for j, b in enumerate(y, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (a != b)))
        p = q
    return p[-1]


def test_banded_distance():
    r = random.Random(3)
    for _ in range(6000):
        x = [r.randrange(6) for _ in range(r.randint(0, 14))]
        y = [v for v in x if r.random() > 0.15]
        for _ in range(r.randint(0, 3)):
            y.insert(r.randint(0, len(y)), r.randrange(6))
        most, d = r.randint(0, 6), slow_distance(x, y)
        assert o.banded_distance(x, y, most) == (d if d <= most else None)


def test_sketches_depend_on_order_and_not_on_the_batch():
    r = random.Random(4)
    words = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(60)]
    text, turned = " ".join(words), " ".join(words[30:] + words[:30])
    alone, many = o.sketches([text])[2][0], o.sketches(["x y", "", turned, text])[2]
    assert (alone == many[3]).all() and not len(many[1])
    same = np.isin(many[2], many[3]).mean()
    assert same < 0.3  # all words are shared; only those on one side of the turn keep their order


@pytest.mark.parametrize("keep", [1, 3, 7])
def test_least_in_order_equals_a_full_sort(keep):
    """Whatever share of the k-mers is sorted, the `keep` least of all are picked."""
    r = np.random.default_rng(keep)
    sizes = r.integers(keep, 400, 200)
    kmer = r.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    bounds = np.r_[0, np.cumsum(sizes)]
    got = o.least_in_order(kmer, bounds, keep, 0, 5)
    for t in range(len(sizes)):
        own = kmer[bounds[t] : bounds[t + 1]]
        for k in range(5):
            order = ((own >> np.uint64(32)) ^ (o._XOR[k] >> np.uint64(32))) * (o._ODD[k] & np.uint64(0xFFFFFFFF)) & np.uint64(0xFFFFFFFF)
            picked = np.sort(np.argsort(order, kind="stable")[:keep])
            want = o._ODD[k : k + 1].copy()
            for j in picked:
                want = o.mix(want * np.uint64(3) + own[j : j + 1])
            assert got[t, k] == want[0]


def test_repeated_kmers_are_numbered_in_the_order_of_the_text(monkeypatch):
    r = np.random.default_rng(1)
    words = r.integers(0, 40, 5000).astype(np.uint64)
    bounds = np.r_[0, np.sort(r.integers(0, 5000, 30)), 5000]
    for size in (1, 2):
        got = o.labelled_kmers(words, bounds, size)
        monkeypatch.setattr(o, "_grouped", lambda k, t: np.lexsort((k, t)))
        want = o.labelled_kmers(words, bounds, size)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(got, want))
        for a, b in zip(got[1], got[1][1:]):
            assert len(set(got[0][a:b].tolist())) == b - a


def met(a, b):
    """Whether each of the texts `a` meets its counterpart in `b` in a bucket."""
    return np.array([bool(np.isin(x, y).any()) for x, y in zip(o.sketches(a)[2], o.sketches(b)[2])])


def edited(r, n, places):
    words = [f"w{r.randrange(10**9)}" for _ in range(n)]
    return " ".join(words), " ".join(f"n{r.randrange(10**9)}" if k in places else w for k, w in enumerate(words))


@pytest.mark.parametrize("n, share, even", [(600, 0.2, True), (300, 0.2, False), (300, 0.18, True), (300, 0.2, True), (200, 0.15, True), (61, 0.2, True), (50, 0.2, True), (15, 0.2, True), (10, 0.2, False)])
def test_pairs_at_the_threshold_meet(n, share, even):
    r = random.Random(6)
    d = round(n * share)
    pairs = [edited(r, n, {int((k + 0.5) * n / d) for k in range(d)} if even else set(r.sample(range(n), d))) for _ in range(400)]
    assert met(*zip(*pairs)).mean() >= 0.97  # expected: 0.985 or more


def test_short_texts_one_edit_apart_meet(spark):
    r = random.Random(7)
    pairs = [edited(r, n, {k}) for n in range(5, 10) for k in range(n)]
    pairs += [(a, " ".join(a.split()[:k] + a.split()[k + 1 :])) for n in range(5, 10) for a in [edited(r, n, ())[0]] for k in range(n)]
    assert met(*zip(*pairs)).all()
    rows = [(2 * k + j, t) for k, pair in enumerate(pairs[:35]) for j, t in enumerate(pair)]
    assert {(x.id, x.class_id) for x in o.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(k, k - k % 2) for k, _ in rows}
    # a group whose least member is one edit from all, and one that only others connect
    chain = ["a b c d e f", "a b c d e x", "a b c d y x", "a b c z y x"]
    rows = [(k, t) for k, t in enumerate(chain)]
    assert {x.class_id for x in o.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_links_at_the_threshold_are_found_among_all_pairs(spark):
    """Families of copies with 15 to 20 % of their words edited, moved or dropped: links found against all that exist."""
    r = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"w{r.randrange(900)}" for _ in range(r.choice((30, 90, 250)))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for _ in range(int(len(words) * r.uniform(0.15, 0.2))):
                k = r.randrange(len(other))
                if r.random() < 0.5:
                    other[k] = f"n{r.randrange(900)}"
                elif r.random() < 0.5:
                    del other[k]
                else:
                    other.insert(k, f"n{r.randrange(900)}")
            texts.append(" ".join(other))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if o.compared(texts[j], texts[i], 0.8) is not None]
    out = {x.id: x.class_id for x in o.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(links) > 60 and np.mean([out[i] == out[j] for i, j in links]) >= 0.97
    root = by_search(len(texts), links)
    assert all(root[i] == root[out[i]] for i in range(len(texts)))  # and nothing else is joined


def test_a_large_class_and_strangers_in_its_buckets(spark, monkeypatch):
    """Blocks of four rows: a bucket's largest class is dealt apart from the strangers, and every pair across is compared."""
    monkeypatch.setattr(o, "TILE", 4)
    r = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(30)]
    far = [w if r.random() > 0.3 else f"y{k}" for k, w in enumerate(base)]
    texts += [" ".join(far[:k] + [f"z{k}"] + far[k + 1 :]) for k in range(10)]
    out = {x.id: x.class_id for x in o.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == dict(enumerate(expected_classes(texts)))


def family(r, n, edits):
    words = [f"w{r.randrange(4000)}" for _ in range(n)]
    out = [list(words)]
    for e in edits:
        w = list(words)
        for _ in range(e):
            w[r.randrange(len(w))] = f"n{r.randrange(9999)}"
        out.append(w)
    return [" ".join(w) for w in out]


def expected_classes(texts, threshold=0.8):
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or o.compared(texts[j], texts[i], threshold) is not None]
    return by_search(len(texts), links)


def test_classes_equal_brute_force(spark):
    r = random.Random(5)
    texts = []
    for n in (40, 80, 300):
        texts += family(r, n, [1, n // 30, n // 20, n // 15, n // 12])
    passage = " ".join(f"p{k}" for k in range(60))  # a passage that unlike documents share
    texts += [" ".join(f"u{r.randrange(9999)}" for _ in range(60)) + " " + passage for _ in range(12)]
    texts += texts[:4] + ["", "", "one two"]
    rows = [(k * 3 - 20, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    got = {x.id: x for x in o.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = expected_classes(texts)
    assert {k: got[k * 3 - 20].class_id for k in range(len(texts))} == {k: want[k] * 3 - 20 for k in range(len(texts))}
    assert all(x.kept == (x.id == x.class_id) for x in got.values())


def test_members_that_miss_the_pivot_still_join(spark):
    """a - b - c - d in a chain: only neighbours are within the threshold."""
    words = [f"w{k}" for k in range(100)]
    chain = [words]
    for step in range(1, 4):
        w = list(chain[-1])
        for k in range(step * 15, step * 15 + 15):
            w[k] = f"s{step}x{k}"
        chain.append(w)
    rows = [(k + 1, " ".join(w)) for k, w in enumerate(chain)]
    assert {x.class_id for x in o.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_odd_rows_and_one_row_of_each_class_stays(spark, odd_docs, no_docs):
    out = o.classes(odd_docs).collect()
    assert len(out) == odd_docs.count()
    kept = o.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    texts = sorted((r.text or "") for r in rows)
    assert len(rows) == len(set(texts)) == 7  # one of: the fox's three, the empty two, white, long, other, without id, unicode
    assert sum("fox" in t for t in texts) == 1
    assert o.classes(no_docs).count() == 0 and o.keep_one(no_docs).count() == 0


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(0)
    base, rows = r.normal(size=(40, 16)), []
    for k in range(500):
        v = (base[r.integers(40)] + r.normal(size=16) * r.choice([0, 0.05, 0.12, 0.2, 0.3])) * r.uniform(0.5, 2)
        rows.append((k, [float(np.float32(x)) for x in v], int(r.integers(3)) if k % 50 else None))
    rows += [(k + 2000, rows[k % 7][1], rows[k % 7][2]) for k in range(40)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [1.0, None] + [0.0] * 14, 1), (3005, [1.0] * 4, 1), (3006, [2.0] * 4, 1), (3007, [float("inf")] * 4, 1), (None, rows[1][1], rows[1][2])]
    return rows


@pytest.mark.parametrize("tile", [64, 1024])
def test_vector_links_equal_brute_force(spark, vectors, tile):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    out = {r.vec_id: r for r in embed_dedup.link_vectors(df, tile=tile).collect()}
    sound = [i for i, r in enumerate(vectors) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = {i: np.array(vectors[i][1], float) / np.linalg.norm(np.array(vectors[i][1], float)) for i in sound}
    links = [(a, b) for a in sound for b in sound if a < b and vectors[a][2] == vectors[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root = by_search(len(vectors), links)
    ids = [r[0] for r in vectors]
    for i, vid in enumerate(ids):
        if vid is None:
            continue
        mine = [ids[k] for k in range(len(ids)) if root[k] == root[i] and ids[k] is not None]
        assert (out[vid].n_links, out[vid].component_id, out[vid].kept) == (sum(i in x for x in links), min(mine), vid == min(mine))
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


def test_rows_without_id_or_of_equal_id_are_told_apart_by_their_vectors(spark):
    """An id under two labels, an id with two vectors, groups of rows without ids, repeated rows."""
    rows = [
        (None, [1.0, 0.0], 1),
        (5, [1.0, 0.01], 1),
        (9, [0.0, 1.0], 1),
        (9, [0.0, 1.0], 2),
        (8, [0.01, 1.0], 2),
        (7, [-1.0, 0.0], 2),
        (7, [0.0, -1.0], 2),
        (6, [0.0, -2.0], 2),
        (None, [1.0, 1.0, 0.0], 3),
        (None, [2.0, 2.0, 0.0], 3),
        (None, [2.0, 2.0, 0.0], 3),
        (4, [1.0, 2.0], 4),
        (4, [1.0, 2.0], 4),
        (None, None, 4),
        (3, [1.0, 0.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    out = sorted(map(tuple, embed_dedup.link_vectors(df).collect()), key=key)

    def linked(a, b):
        if a[1] is None or b[1] is None or a[2] is None or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i], rows[j])]
    root = by_search(len(rows), links)
    want = []
    for i, (vid, _, _) in enumerate(rows):
        name = min((rows[k][0] for k in range(len(rows)) if root[k] == root[i] and rows[k][0] is not None), default=None)
        want.append((vid, sum(i in x for x in links), name, vid is not None and vid == name))
    assert out == sorted(want, key=key)


@pytest.mark.parametrize("tile, strip", [(16, 8), (300, 64)])
def test_blocks_in_the_first_axis_order_lose_no_link(spark, monkeypatch, tile, strip):
    """Small blocks and strips over vectors that spread along the axis, with one cell that many share."""
    monkeypatch.setattr(embed_dedup, "STRIP", strip)
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 6))
    rows = [(k, [float(x) for x in base[r.integers(60)] + r.normal(size=6) * r.choice([0.01, 0.1, 0.3])], k % 2) for k in range(600)]
    rows += [(1000 + k, [float(x) for x in base[0] + r.normal(size=6) * 1e-3], 0) for k in range(100)]
    out = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=tile).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([x[2] for x in rows])
    hit = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(hit, 1)))]
    root = embed_dedup._spanning(len(rows), *map(np.array, zip(*links)))
    assert out == {rows[k][0]: (int(hit[k].sum()) - 1, rows[root[k]][0]) for k in range(len(rows))}
