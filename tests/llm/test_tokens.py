import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import bpe_count, packing, piece_codec

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "é", "É", "é", "ß", "ẞ", "日", "本", "…", "0", "12", "<|endoftext|>", "<", "|", ">", "İ", "Σ", "ς", "😀", "\x1c", "\x85", " ", "ﬁ", "...", "!!", "-", "_", "aaaa", "%%%", "I'VE", "\x00", "▁", "<s>", "​", "½"]


def texts(n, seed=0):
    r = random.Random(seed)
    return ["", " ", *["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 18))) for _ in range(n)]]


def test_counts_equal_the_library():
    lib, own = Tokenizer.from_file(WORDS), bpe_count.Counter(WORDS)
    some = texts(4000)
    assert own.count(some) == [len(lib.encode(t, add_special_tokens=False).ids) for t in some]


def test_runs_of_one_symbol_merge_from_the_left():
    lib, own = Tokenizer.from_file(WORDS), bpe_count.Counter(WORDS)
    some = ["a" * n for n in range(1, 60)] + ["ha" * n for n in range(1, 40)] + ["%" * n for n in range(1, 40)]
    assert own.count(some) == [len(lib.encode(t, add_special_tokens=False).ids) for t in some]


def test_word_ids_equal_the_library():
    lib, own = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    some = texts(3000, 1)
    for t, raw in zip(some, own.texts(some)):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_codec_equals_the_library_both_ways():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.Codec(PIECES)
    for t in texts(4000, 2):
        ids = lib.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)


def test_decoding_of_broken_bytes():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.Codec(PIECES)
    r = random.Random(5)
    for _ in range(500):
        ids = [r.choice([*range(3, 259), *range(300, 330)]) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


@pytest.mark.parametrize("kept", [1, 50])
def test_full_tables_start_anew(monkeypatch, kept):
    monkeypatch.setattr(bpe_count, "KEPT", kept)
    monkeypatch.setattr(packing, "KEPT", kept)
    monkeypatch.setattr(piece_codec, "KEPT", kept)
    some = texts(300, 3)
    lib, pieces = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter, ids, codec = bpe_count.Counter(WORDS), packing.WordIds(WORDS), piece_codec.Codec(PIECES)
    for k in range(0, len(some), 20):
        part = some[k : k + 20]
        assert counter.count(part) == [len(lib.encode(t, add_special_tokens=False).ids) for t in part]
        assert [len(b) // 4 for b in ids.texts(part)] == counter.count(part)
        assert [x[0] for x in codec.coded(part)] == [",".join(map(str, pieces.encode(t))) for t in part]


def test_count_query_rows(spark, odd_docs, no_docs):
    lib = Tokenizer.from_file(WORDS)
    out = sorted(map(tuple, bpe_count.count_tokens(odd_docs, WORDS).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in odd_docs.collect()]
    assert out == sorted(want, key=str)
    assert bpe_count.count_tokens(no_docs, WORDS).count() == 0


def test_codec_query_rows(spark, odd_docs, no_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = sorted(map(tuple, piece_codec.encoding_digests(odd_docs, PIECES).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = lib.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert out == sorted(want, key=str)
    assert piece_codec.encode_documents(no_docs, PIECES).count() == 0
    full = {r.id: r for r in piece_codec.encode_documents(odd_docs, PIECES).collect()}
    assert full[7].ids == lib.encode(odd_docs.where("doc_id = 7").first().text)


def test_packing_rows(spark, odd_docs, no_docs):
    lib, size = Tokenizer.from_file(WORDS), 64
    rows = packing.pack(odd_docs, WORDS, size).collect()
    want = []
    for r in odd_docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4")
            want.append((r.doc_id, k // size, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert packing.pack(no_docs, WORDS, size).count() == 0


def test_packing_is_close_to_the_least(spark):
    r = np.random.default_rng(0)
    histogram = np.zeros(2049, np.int64)
    np.add.at(histogram, np.clip(r.gamma(1.2, 600, 40_000).astype(int), 1, 2048), 1)
    plan = packing.plan_packing(histogram, 2048)
    got = np.zeros(2049, np.int64)
    for parts, n in plan:
        assert sum(parts) <= 2048
        for p in parts:
            got[p] += n
    assert (got == histogram).all()
    least = -(-int((histogram * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in plan) <= 1.005 * least


@pytest.mark.parametrize("counts", [{300: 6000}, {1: 100_000}, {length: 9091 for length in range(20, 31)}, {1500: 10, 3: 7000, 1: 5}, {2048: 3, 700: 1}])
def test_short_frequent_lengths_share_sequences(counts):
    histogram = np.zeros(2049, np.int64)
    histogram[list(counts)] = list(counts.values())
    plan = packing.plan_packing(histogram, 2048)
    got = np.zeros(2049, np.int64)
    for parts, n in plan:
        assert n > 0 and sum(parts) <= 2048
        for p in parts:
            got[p] += n
    assert (got == histogram).all()
    # of one length capacity // length fit into a sequence; of several, what is filled decides
    least = max(-(-n // (2048 // length)) for length, n in counts.items())
    filled = -(-int((histogram * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in plan) <= max(least, 1.01 * filled + 1)


def test_best_fit_equals_piece_by_piece():
    r = random.Random(4)
    for _ in range(200):
        size = r.randint(3, 40)
        left = np.array([0, *[r.choice([0, 0, 1, 2, 9, 30]) for _ in range(size)]])
        rooms: list[int] = []
        for length in range(size, 0, -1):
            for _ in range(left[length]):
                fits = [k for k, room in enumerate(rooms) if room >= length]
                if fits:
                    rooms[min(fits, key=rooms.__getitem__)] -= length
                else:
                    rooms.append(size - length)
        plan = packing.best_fit(left, size)
        assert sorted(size - sum(parts) for parts, n in plan for _ in range(n)) == sorted(rooms)


def test_another_vocabulary_is_cut_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, ids = Tokenizer.from_file(path), bpe_count.Counter(path), packing.WordIds(path)
    assert not own.known and bpe_count.Counter(WORDS).known
    some = texts(1500, 7) + ["  two  spaces\n\n and lines", "word" * 5000]  # a word of 20,000 characters
    want = [lib.encode(t, add_special_tokens=False).ids for t in some]
    assert own.count(some) == list(map(len, want))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.texts(some)] == want


def test_an_overlong_word():
    some = ["x" * 70_000, "%$" * 20_000 + " end", "\u00e9" * 9_000]
    lib = Tokenizer.from_file(WORDS)
    assert bpe_count.Counter(WORDS).count(some) == [len(lib.encode(t, add_special_tokens=False).ids) for t in some]


@pytest.mark.parametrize("change", [{"type": "WordPiece"}, {"dropout": 0.1}, {"continuing_subword_prefix": "##"}, {"byte_fallback": True}])
def test_vocabularies_of_other_kinds_are_refused(tmp_path, change):
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    spec["model"] |= change
    assert bpe_count.unsupported(spec)
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    assert not bpe_count.unsupported(spec)
    assert bpe_count.unsupported(spec | {"pre_tokenizer": {"type": "Whitespace"}}) and bpe_count.unsupported(spec | {"added_tokens": [{"content": "x", "lstrip": True, "special": True}]})


def test_models_of_other_kinds_are_refused():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES).serialized_model_proto()
    assert piece_codec.unsupported(model) == []
    spec = lambda number, *fields: bytes([number << 3 | 2, sum(map(len, fields)) % 128, *b"".join(fields)])
    normal, trained = spec(3, b"\x18\x01", b"\x20\x00"), spec(2, b"\x18\x02")
    assert piece_codec.unsupported(trained + normal) == []
    assert piece_codec.unsupported(spec(2, b"\x18\x01") + normal) == ["a type other than merges"]
    assert piece_codec.unsupported(trained + spec(3, b"\x12\x03abc", b"\x20\x00")) == ["a normaliser"]
    assert piece_codec.unsupported(trained + spec(3, b"\x18\x00", b"\x20\x00")) == ["no leading space"]
    assert piece_codec.unsupported(trained) == ["white space that is dropped"]
    assert piece_codec.unsupported(trained + normal + spec(1, b"\x0a\x01x", b"\x18\x04")) == ["user-defined symbols"]


def nonnegative_least_squares(a, b, steps=400):
    """By active sets: the column with the steepest gradient enters, columns that would fall below 0 leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(steps):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        if grad.max(initial=-np.inf) < 1e-9:
            break
        active[grad.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                break
            low = active & (z <= 0)
            step = (x[low] / (x[low] - z[low])).min()
            x = x + step * (z - x)
            active &= x > 1e-12
        x = z
    return x


def test_fitted_repeats_equal_an_independent_fit():
    r = np.random.default_rng(0)
    for capacity in (20, 31):
        histogram = np.zeros(capacity + 1)
        some = r.choice(np.arange(1, capacity), 9, replace=False)
        histogram[some] = r.integers(1, 60, 9)
        patterns = packing.exact_patterns(some, capacity)
        weight = np.sqrt(np.arange(capacity + 1) / (capacity + 1))
        a = np.stack([np.bincount(p[p > 0], minlength=capacity + 1) for p in patterns], axis=1) * weight[:, None]
        own, other = packing.fit_repeats(patterns, histogram, 20_000), nonnegative_least_squares(a, weight * histogram)
        error = lambda x: float(((a @ x - weight * histogram) ** 2).sum())
        assert (own >= 0).all() and error(own) == pytest.approx(error(other), rel=1e-3, abs=1e-3)
