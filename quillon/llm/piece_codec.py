"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A string's merge encoding is the one way of cutting it into pieces in which every two adjacent pieces, merged anew from
their characters, give just these two pieces. So no merge has to be played through for a whole word: take the longest
piece at each place, check it against the piece before, and where that fails try the next shorter piece, or step back.
A bit for every position remembers where all pieces have failed, so nothing is tried twice.

Longest matches come from an Aho-Corasick automaton over the pieces, and the pair checks are kept in a table.

Defined results: a null text is an empty one, with no ids; characters without a piece become their UTF-8 bytes' pieces;
texts of any length are cut where no piece can span (before a word's space mark, at characters of no longer piece), so
memory follows the longest word and the batch. Repeated rows give repeated rows; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import slabs
from quillon.llm.bpe_count import halve
from quillon.runtime import ship

SPACE = "▁"
#: Words kept by a worker; beyond that the later half goes.
KEPT = 1_200_000
#: Pairs and beginnings of pieces kept.
PAIRS = 400_000
SCHEMA = "id bigint, n_tokens bigint, ids array<int>, decoded string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def unsupported(model: bytes) -> list[str]:
    """What a serialised model does that this codec doesn't. Numbers of fields and types are those of the public format."""
    whole = list(fields(model))
    trainer, normal = (dict(fields(next((v for k, v in whole if k == n), b""))) for n in (2, 3))
    kinds = {dict(fields(v)).get(3, 1) for k, v in whole if k == 1}
    found = {
        "a type other than merges": trainer.get(3, 1) != 2,
        "the space mark at words' ends": bool(trainer.get(24, 0)),
        "a normaliser": bool(normal.get(2)),
        "no leading space": not normal.get(3, 1),
        "white space that is dropped": bool(normal.get(4, 1)),
        "spaces that stay as they are": not normal.get(5, 1),
        "user-defined symbols": 4 in kinds,
    }
    return [what for what, there in found.items() if there]


class Codec:
    """A merge-type model without normalisation: encode to ids and decode as its library does. Other models are refused."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if found := unsupported(lib.serialized_model_proto()):
            raise ValueError(f"the model has {', '.join(found)}")
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.plain = {p: i for i, p in enumerate(self.pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.rank = {p: -lib.get_score(i) for p, i in self.plain.items()}
        self.unknown = lib.unk_id()
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.reached = {p for p in self.plain if self.merged(p) == [p]}  # a piece that merging never makes is no choice
        self.automaton = ahocorasick.Automaton()
        for p in self.reached:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(p) for p in self.plain):
            raise ValueError("a piece spans two words")
        spanned = set("".join(p for p in self.plain if len(p) > 1))
        self.alone = "\n" if "\n" not in spanned else ""
        # marks that no piece holds after a letter or digit: a word may be cut before them, and so recurs more often
        after = {b for p in self.plain for a, b in zip(p, p[1:]) if a.isalnum()}
        marks = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after))
        ends = f"[{marks}{SPACE}{self.alone}]" if marks or self.alone else SPACE
        self.cutter = re.compile(f"{SPACE}*[^\\W\\d_]++(?={ends}|\\Z)|{SPACE}+[^{SPACE}{self.alone}]*|[^{SPACE}{self.alone}]+" + ("|\n" if self.alone else ""))
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, list[str]] = {}
        self.words: dict[str, str] = {}  # a chunk's ids, joined by commas
        self.odd: dict[str, str] = {}  # the decoded text of those chunks whose text it isn't

    def merged(self, text: str) -> list[str]:
        """The merge encoding by definition: join the best pair, the leftmost of equals, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether the merges leave pieces a and b, side by side, as they are."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def shorter(self, piece: str) -> list[str]:
        """All pieces that start `piece`, the longest (itself) first, that merging reaches; a character alone always is one."""
        found = self.prefixes.get(piece)
        if found is None:
            if len(self.prefixes) >= PAIRS:
                self.prefixes.clear()
            heads = [piece[:k] for k in range(len(piece), 0, -1)]
            found = self.prefixes[piece] = [p for p in heads if len(p) == 1 or p in self.reached]
        return found

    def longest(self, text: str) -> list[str]:
        """For each position the longest piece that starts there, or its character."""
        out = list(text)
        for end, p in self.automaton.iter(text):
            k = end + 1 - len(p)
            if len(p) > len(out[k]):
                out[k] = p
        return out

    def segment(self, text: str) -> list[str]:
        """The merge encoding of `text`, by backtracking."""
        if text in self.reached:
            return [text]
        first = [p for _, p in self.automaton.iter_long(text)]  # no step back needed, mostly
        if sum(map(len, first)) == len(text) and all(map(self.fit, first, first[1:])):
            return first
        best, failed, stack = self.longest(text), 0, []  # stack: choices left at a place, the one taken
        at, n = 0, len(text)
        choices, turn = self.shorter(best[0]) if n else [], 0
        while at < n:
            taken = None
            while turn < len(choices):
                p = choices[turn]
                turn += 1
                if not failed >> (at + len(p)) & 1 and (not stack or self.fit(stack[-1][2], p)):
                    taken = p
                    break
            if taken is not None:
                stack.append((choices, turn, taken))
                at += len(taken)
                if at < n:
                    choices, turn = self.shorter(best[at]), 0
                continue
            failed |= 1 << at
            if not stack:
                raise AssertionError(f"no encoding of {text!r}")
            choices, turn, p = stack.pop()
            at -= len(p)
        return [s[2] for s in stack]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.plain.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in p.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:  # neighbours without pieces are one unknown
                out.append(self.unknown)
        return out

    def chunks(self, text: str) -> list[str]:
        """The text with its leading space, cut where no piece spans."""
        return self.cutter.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.ids_of(self.segment(c))]

    def decode(self, ids: list[int]) -> str:
        return self.strip(self.spelled(ids))

    def spelled(self, ids: list[int]) -> str:
        """The pieces' text; runs of bytes read as UTF-8, a replacement character for each byte that is not."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            b = self.of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_text_of(bytes(raw)))
                raw = bytearray()
            if i >= 0 and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    @staticmethod
    def strip(spelled: str) -> str:
        """Without the space that encoding put first."""
        return spelled[1:] if spelled.startswith(" ") else spelled

    def learn(self, chunks: set[str]) -> None:
        for c in chunks:
            ids = self.ids_of(self.segment(c))
            self.words[c] = ",".join(map(str, ids))
            back = self.spelled(ids)
            if back != c.replace(SPACE, " "):
                self.odd[c] = back

    def coded(self, texts: list[str]) -> list[tuple[str, str]]:
        """For every text its ids joined by commas, and the text that they decode to."""
        cut = [self.chunks(t) for t in texts]
        get, out, open_ = self.words.get, [""] * len(cut), []
        for k, c in enumerate(cut):
            found = list(map(get, c))
            try:
                out[k] = ",".join(found)
            except TypeError:  # some chunk is new
                open_.append((k, found))
        new = {c for k, found in open_ for c, x in zip(cut[k], found) if x is None}
        if len(self.words) + len(new) > KEPT:
            halve(self.words)
            self.odd = {c: t for c, t in self.odd.items() if c in self.words}
            new = {c for k, _ in open_ for c in cut[k] if c not in self.words}
        self.learn(new)
        for k, _ in open_:
            out[k] = ",".join(map(self.words.__getitem__, cut[k]))
        odd = self.odd
        return [(ids, self.strip("".join([odd.get(x, x) for x in c] if odd and not odd.keys().isdisjoint(c) else c).replace(SPACE, " "))) for ids, c in zip(out, cut)]


def _text_of(raw: bytes) -> str:
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode("utf-8"))
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _coded(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slabs(batches, "text"):
            ids, coded = part.column(0), c.coded([t or "" for t in part.column(1).to_pylist()])
            joined, spelled = [x[0] for x in coded], [x[1] for x in coded]
            n = [s.count(",") + 1 if s else 0 for s in joined]
            if digests:
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(map(sha, joined), pa.string()), pa.array(map(sha, spelled), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([[int(x) for x in s.split(",")] if s else [] for s in joined], pa.list_(pa.int32())), pa.array(spelled, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return run


def _narrow(df: DataFrame, id_col: str | Column, text_col: str | Column) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and decoded (the ids' text) of every row. One pass over the rows, no shuffle."""
    return _narrow(df, id_col, text_col).mapInArrow(_coded(model, False), SCHEMA)


def encoding_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of the ids and the decoded text."""
    return _narrow(df, id_col, text_col).mapInArrow(_coded(model, True), DIGESTS)
