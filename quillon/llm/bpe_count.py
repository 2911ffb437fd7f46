"""Token counts by rank-synchronous merging of arrays.

Pre-tokens of a batch lie end to end in one ragged numpy array of symbols. In a round every pre-token finds the lowest
rank among its adjacent pairs and all its occurrences of that pair merge at once (in a run of one symbol every second
one, from the left). Each symbol comes of one merge alone, and a pair that holds a symbol ranks after the merge that
makes it, so this ends where merging one pair at a time would. What is left in a pre-token is its number of tokens.

Counts of words are kept by the worker, so a frequent word is merged once for each table of KEPT words.

Defined results: a null text is an empty one, of 0 tokens; the strings of added tokens count 1 wherever they stand in
a text, as is the library's default; a vocabulary of another kind is refused; repeated rows give repeated rows; a table without rows gives none. Memory follows
the slab (or the longest single text).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import slabs
from quillon.runtime import ship

#: Words kept by a worker; beyond that the later half goes.
KEPT = 1_200_000
#: Symbols merged at once.
SYMBOLS = 400_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_SIMPLE = re.compile("[a-z']+|[0-9]|[^a-z0-9\\s']+")
_PLAIN = re.compile("[\\x21-\\x7e]*\\Z")
#: Texts of these characters alone are cut in one go: each is what it is under the vocabulary's normalisation, but for case.
_EASY = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*+\\Z")
_PRE = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]++|[0-9]|[^\\sa-zß-öø-ÿ0-9]++")
_LETTERS = re.compile("[a-zß-öø-ÿ]+\\Z")
#: What str.split() takes for white space and the vocabulary's patterns do not.
_SOLID = ("\x1c", "\x1d", "\x1e", "\x1f")
_WORD = re.compile("[\\S\x1c-\x1f]+")


def white_split(text: str) -> list[str]:
    """The words between what the patterns take for white space."""
    return _WORD.findall(text) if any(c in text for c in _SOLID) else text.split()


#: The normaliser and pre-tokeniser whose words this module cuts by itself; for all others the library does.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def unsupported(spec: dict) -> list[str]:
    """What a vocabulary in the library's JSON format does that array merging doesn't."""
    model, added = spec["model"], spec.get("added_tokens") or []
    split = spec.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    found = {
        "a type other than merges": model.get("type", "BPE") != "BPE",
        "options of its merges": any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")),
        "no bytes as symbols": not any(s.get("type") == "ByteLevel" for s in steps),
        "a space before each text": any(s.get("add_prefix_space") for s in steps),
        "added tokens that match in other ways": any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) or any(t.get("normalized") for t in added if not t.get("special")),
    }
    return [what for what, there in found.items() if there]


class Counter:
    """Counts tokens of a byte-level BPE vocabulary in its library's JSON format; refuses what it can't count exactly.

    Where the normaliser and pre-tokeniser are the KNOWN ones, words are cut here; else the library cuts every text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if found := unsupported(model):
            raise ValueError(f"the vocabulary has {', '.join(found)}")
        self.known = all(model.get(k) == v for k, v in KNOWN.items())
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.end = model["model"].get("end_of_word_suffix") or ""
        lib = Tokenizer.from_file(path)
        self.normal, self.split = lib.normalizer, lib.pre_tokenizer
        added = [t["content"] for t in model["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
        self.width = max(vocab.values()) + 1
        keys = ids[:, 0] * self.width + ids[:, 1]
        self.made = ids[:, 2]
        self.slots = _slots(keys)
        if len(np.unique(self.made)) != len(self.made):
            raise ValueError("two merges make the same symbol; merging all pairs of a rank at once would not be exact")
        shown = _byte_characters()
        self.first = np.array([vocab.get(shown[b], -1) for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab.get(shown[b] + self.end, -1) for b in range(256)], dtype=np.int64)
        self.counts: dict[str, int] = {}
        self.byte_of = {c: b for b, c in shown.items()}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where there is none."""
        keys, (held, rank) = left * self.width + right, self.slots
        at = _slot(keys, len(held))
        seen = held[at]
        out = np.where(seen == keys, rank[at], len(self.made))
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))  # another pair's slot: look on
        at = at[open_]
        while len(open_):
            at = (at + 1) % len(held)
            seen, mine = held[at], keys[open_]
            hit = seen == mine
            out[open_[hit]] = rank[at[hit]]
            more = ~hit & (seen >= 0)
            open_, at = open_[more], at[more]
        return out

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of the ragged sequences, and how many in each: (symbols, lengths)."""
        none = len(self.made)
        left_of = np.zeros(len(lengths), np.int64)
        done_symbols: list[tuple[np.ndarray, np.ndarray]] = []
        seq = np.repeat(np.arange(len(lengths)), lengths)
        rank = self._ranks(symbols, seq)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            ended = low == none
            if ended.any():
                done_symbols.append((seq[ended], symbols[ended]))
                symbols, seq, rank, low = symbols[~ended], seq[~ended], rank[~ended], low[~ended]
                if not len(symbols):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]  # neighbours that both merge are one symbol repeated: every second one does
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            symbols, seq, rank, at = symbols[keep], seq[keep], rank[keep], new[at]
            stale = np.r_[at, at[at > 0] - 1]
            rank[stale] = self._ranks(symbols, seq, stale)
        parts = [np.concatenate(x) for x in zip(*done_symbols)] if done_symbols else [np.zeros(0, np.int64)] * 2
        order = np.argsort(parts[0], kind="stable")
        left_of[:] = np.bincount(parts[0], minlength=len(lengths))
        return parts[1][order], left_of

    def _ranks(self, symbols: np.ndarray, seq: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of the pair that begins at each place (at those of `at`); none at a sequence's end."""
        at = np.arange(len(symbols)) if at is None else at
        out = np.full(len(at), len(self.made), np.int64)
        inner = at + 1 < len(symbols)
        inner[inner] = seq[at[inner]] == seq[at[inner] + 1]
        out[inner] = self.rank(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    def pre_tokens(self, word: str) -> list[bytes]:
        """The pre-tokens, in bytes, of a word without white space; of a pre-token itself where the library has cut."""
        back = self.byte_of
        if not self.known:
            return [bytes(back[c] for c in word)]
        if _LETTERS.match(word):
            return [word.encode()]
        low = word.lower()
        if _LETTERS.match(low):
            return [low.encode()]
        if _PLAIN.match(word) and "'" not in word:
            return [x.encode() for x in _SIMPLE.findall(low)]
        return [bytes(back[c] for c in x) for x, _ in self.split.pre_tokenize_str(self.normal.normalize_str(word))]

    def encode(self, pre: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, end to end, and the number in each."""
        sizes = np.fromiter(map(len, pre), np.int64, len(pre))
        data = np.frombuffer(b"".join(pre), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        done, counts, k = [], [], 0
        while k < len(pre):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else -1) + SYMBOLS, side="right")))
            a, b = (ends[k - 1] + 1 if k else 0), ends[stop - 1] + 1
            s, n = self.survivors(symbols[a:b].copy(), sizes[k:stop])
            done.append(s)
            counts.append(n)
            k = stop
        return (np.concatenate(done), np.concatenate(counts)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def words(self, text: str) -> tuple[list[str], int]:
        """The words between white space (where the library cuts: the pre-tokens), and the number of added tokens."""
        split = white_split if self.known else self.by_library
        if self.added is None or self.known and "<" not in text:
            return split(text), 0
        parts = self.added.split(text)
        return [w for p in parts for w in split(p)], len(parts) - 1

    def by_library(self, text: str) -> list[str]:
        """The library's pre-tokens, spelled in its characters for bytes."""
        return [x for x, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text) if self.normal else text)] if text else []

    def cut(self, text: str) -> tuple[list[str], int]:
        """(words or pre-tokens, added tokens) of a text: pre-tokens where one pattern finds them, words between white space otherwise."""
        if self.known and _EASY.match(text) and (self.added is None or "<" not in text or not self.added.search(text)):
            return _PRE.findall(text.lower()), 0
        return self.words(text)

    def pieces_of(self, new: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """Each new word as numbers of distinct pre-tokens, and these."""
        places: dict[bytes, int] = {}
        return [[places.setdefault(p, len(places)) for p in self.pre_tokens(w)] for w in new], list(places)

    def learn(self, new: list[str]) -> None:
        """Enter the counts of new words."""
        cut, distinct = self.pieces_of(new)
        n = self.encode(distinct)[1].tolist()
        self.counts.update(zip(new, [n[c[0]] if len(c) == 1 else sum([n[k] for k in c]) for c in cut]))

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.cut(t) for t in texts]
        return [sum(found) + extra for found, (_, extra) in zip(looked_up(self.counts, [c[0] for c in cuts], self.learn, KEPT), cuts)]


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) in an open-addressed table of a power of two, at most a quarter full; -1 where it is empty."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    held, place = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    for k, (key, at) in enumerate(zip(keys.tolist(), _slot(keys, size).tolist())):
        while held[at] >= 0:
            at = (at + 1) % size
        held[at], place[at] = key, k
    return held, place


def halve(table: dict) -> None:
    """Keep the half of the entries that came first: frequent words come early."""
    first = dict(islice(table.items(), len(table) // 2))
    table.clear()
    table.update(first)


def looked_up(table: dict, cuts: list[list[str]], learn, kept: int) -> list[list]:
    """The table's values of all words of each cut; words that it lacks are learnt first, into a halved table if it is full."""
    small = dict.fromkeys(chain.from_iterable(cuts))  # of these texts alone: it stays in the processor's caches
    values = list(map(table.get, small))
    new = [w for w, v in zip(small, values) if v is None]
    if len(table) + len(new) > kept:
        halve(table)
    if new:
        learn(new)
    for w, v in zip(small, values):
        small[w] = table[w] if v is None else v
    return [list(map(small.__getitem__, c)) for c in cuts]


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row. One pass over the rows, no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for part in slabs(batches, "text"):
            texts = part.column(1)
            n = pa.array(c.count([t or "" for t in texts.to_pylist()]), pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
