import base64
import hashlib
import random

from quillon.llm import fingerprint as f


def slow_records(text):
    """Chunks by definition: bytes one after another, the gear hash summed anew for each."""
    data, out, start = text.encode(), set(), 0
    gear = [int(g) for g in f._GEAR]
    while start < len(data):
        end = min(start + f.MOST, len(data))
        for k in range(start + f.LEAST, min(start + f.MOST, len(data)) + 1):
            h = sum(gear[data[k - 1 - j]] << j for j in range(f.WINDOW)) % (1 << 32)
            if h >> (32 - (f.STRICT if k - start < f.NORMAL else f.LOOSE)) == 0:
                end = k
                break
        out.add(data[start:end])
        start = end
    return out


def test_chunks_follow_the_definition():
    r = random.Random(1)
    texts = ["", "x", "abc" * 100, *["".join(r.choice("abcdefgh éß\n") for _ in range(r.randint(0, 900))) for _ in range(30)]]
    data, offsets = f.utf8(texts)
    text, start, end = f.chunks(data, offsets)
    for k, t in enumerate(texts):
        mine = {bytes(data[a:b]) for x, a, b in zip(text, start, end) if x == k}
        assert mine == slow_records(t)


def test_an_insertion_moves_no_far_chunk():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(800))
    moved = text[:50] + "inserted words " + text[50:]
    a, b = f.records([text]), f.records([moved])
    assert f.contained(a, b, 1)[0] > 0.95


def expected(rows):
    """The contract by definition: descending ids (null last), then texts; edits, digests, containment of distinct chunks."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    size = lambda s: sum(map(len, s))
    like = lambda a, b: size(a & b) / size(a) if a else float(not b)
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a = slow_records(t)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(a, slow_records(e)), 9), round(like(a, slow_records(n)), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in f.fingerprint_documents(df).collect()), key=str)


def test_rows_follow_the_definition(spark, odd_docs, no_docs):
    small = odd_docs.where("doc_id is null or doc_id <> 5")
    assert got(small) == expected([(r.doc_id, r.text) for r in small.collect()])
    assert f.fingerprint_documents(no_docs).count() == 0
    one = small.where("doc_id = 3")
    assert got(one) == expected([(3, "")])
    assert f.fingerprint_documents(odd_docs).count() == odd_docs.count()


def test_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_equal_texts_have_equal_fingerprints(spark):
    rows = {}
    for r in f.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        rows[r.doc_id] = r.fingerprint
        assert len(base64.b64decode(r.fingerprint)) % 6 == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    by: dict = {}
    for k, t in texts.items():
        assert by.setdefault(t, rows[k]) == rows[k]
