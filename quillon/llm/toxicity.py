"""Toxicity by weak supervision.

Many voters look at a text. Lexicon voters: each of a fixed list of insults, and word beginnings mined where toxic
training texts have them far more often than others, votes toxic where it begins a word, or, for a mined term that clean
texts use now and then, where it makes up DENSE of the words. Pattern voters, which no label touches: insults addressed to
a second person, dismissals and threats, words with censored letters, shouting, exclamation. The absence of all terms
votes clean.

A generative label model turns votes into posterior labels. A hidden class draws every vote; a vote may also depend on
one other voter's, its parent, so that voters who tell the same evidence are not counted twice. Accuracies, class
balance, the forest of parents (the strongest conditional mutual information that is more than chance) and the tables
along it are estimated together, by expectation maximisation. A linear classifier is trained on the posteriors, and it
alone scores texts; its weights are drawn to those of the fixed words and patterns, which hold where nothing was seen.

Labels are read only to mine terms, and only of rows that are not held out. Training uses about MAX_ROWS labelled rows
at most, picked by a hash of the id; every text is scored whole.

Defined results: null and empty texts score as texts without terms; without labelled rows the fixed words and patterns
alone decide, with rows of one kind nothing is mined; an id with contradicting labels counts as toxic; repeated rows get
equal scores; a table without rows gives none; texts of any length are scanned once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import fresh_name, labelled_sample, slabs, with_scores
from quillon.llm.linear import logistic, sigmoid
from quillon.runtime import cut, forget, ship

#: Labelled rows to learn from, at most.
MAX_ROWS = 20_000
#: Mined terms, at most, and the lengths of word beginnings that are tried.
MAX_TERMS, SHORTEST, LONGEST = 96, 4, 10
#: The share of a text's words from which a term counts as dense.
DENSE = 0.008
#: A term is mined if its share of toxic texts is at least this many times its share of others, and its likelihood ratio
#: against chance is at least this (one in 100,000 terms has it by chance).
LIFT, SURE = 12.0, 20.0
#: Clean texts with a term, at most, for each toxic one with it.
IMPURE = 0.15
#: Rows whose CRC-32 of the id leaves HELD_OUT[1] when divided by HELD_OUT[0] are not learnt from.
HELD_OUT = (3, 1)
THRESHOLD = 0.7
#: Voters depend on each other if twice the rows' mutual information given the class is at least this.
LINKED = 30.0
#: Words that insult in themselves.
INSULTS = ("idiot", "moron", "stupid", "trash", "pathetic", "disgusting", "worthless", "clown", "loser", "scum", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard")
#: Patterns of address, dismissal and threat, and of letters left out.
PATTERNS = {
    "addressed": r"\b(?:you|you're|u|du bist|tu es|t'es|eres)\b(?:\W+\w+){0,3}?\W+(?:" + "|".join(INSULTS) + ")",
    "dismissed": r"\b(?:shut up|get lost|go to hell|drop dead|nobody (?:likes|wants|cares about) you|people like you|halt die klappe|ferme ta gueule|c[aá]llate|l[aá]rgate)\b",
    "threatened": r"\b(?:(?:i|we)(?:'ll| will) (?:kill|hurt|find) you|kill yourself|you (?:should|deserve to) die)\b",
    "censored": r"\b[a-z]{1,2}[*#@$]{1,3}[a-z]{1,4}\b",
}
_PATTERNS = {n: re.compile(p) for n, p in PATTERNS.items()}
#: Strings of which a text that a pattern fits has one; an address also needs a term.
_NEEDED = {
    "dismissed": ("shut up", "get lost", "go to hell", "drop dead", "nobody ", "people like you", "halt die klappe", "ferme ta gueule", "llate", "rgate"),
    "threatened": (" you", "kill yourself", "to die"),
    "censored": ("*", "#", "@", "$"),
}
#: Columns after the terms' own: of votes (density, shouting, exclamation, no term, patterns) and of features (any term, density, one hit, capitals, exclamation, patterns).
_MORE_VOTES, _MORE_FEATURES = 4 + len(PATTERNS), 5 + len(PATTERNS)
_WORD = re.compile(r"\w+")
_UPPER = bytes(range(65, 91))


@dataclass
class LabelModel:
    """Votes in {-1, 0, 1}, explained by a hidden class and, for some voters, by one other voter's vote."""

    prior: float = 0.1
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each voter; -1 for none
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 3, 3)))  # [class, voter, parent's vote + 1, vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        k = np.arange(votes.shape[1])
        above = np.where(self.parent >= 0, votes[:, self.parent], 0) + 1
        ratio = np.log(self.table[1]) - np.log(self.table[0])
        return sigmoid(np.log(self.prior / (1 - self.prior)) + ratio[k, above, votes + 1].sum(1))

    def _estimated(self, votes: np.ndarray, p: np.ndarray) -> None:
        """Class balance and tables for the present forest, from rows that are of class 1 with probability p."""
        self.prior = float(np.clip(p.mean(), 0.005, 0.5))
        n, m = votes.shape
        code = (np.where(self.parent >= 0, votes[:, self.parent], 0) + 1) * 3 + votes + 1 + 9 * np.arange(m)
        of = []
        for q in (1 - p, p):
            counts = np.bincount(code.ravel(), np.repeat(q, m), 9 * m).reshape(m, 3, 3)
            alone = counts.sum(1, keepdims=True) + 0.1
            counts = counts + alone / alone.sum(2, keepdims=True)  # towards what the voter does whatever its parent's vote
            of.append(counts / counts.sum(2, keepdims=True))
        self.table = np.stack(of)

    @classmethod
    def fit(cls, votes: np.ndarray, rounds: int = 3, steps: int = 15, start: np.ndarray | None = None) -> LabelModel:
        """The first round takes voters as independent given the class; each later one finds the forest anew.

        start: first guesses of the rows' probabilities; by default the majority of their votes.
        """
        model = cls(parent=np.full(votes.shape[1], -1))
        p = np.clip(0.5 + 0.45 * np.sign((votes > 0).sum(1) - (votes < 0).sum(1)) if start is None else start, 0.02, 0.98)
        for k in range(rounds):
            if k:
                model.parent = forest(votes, p)
            for _ in range(steps):
                model._estimated(votes, p)
                p = model.posterior(votes)
        return model


def mutual_information(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each two voters the information (in nats, summed over rows) that their votes share given the class."""
    n, m = votes.shape
    onehot = np.concatenate([votes == v for v in (-1, 0, 1)], axis=1).astype(np.float64)
    out = np.zeros((m, m))
    for q in (1 - p, p):
        total = q.sum() + 1e-9
        joint = ((onehot * q[:, None]).T @ onehot).reshape(3, m, 3, m)
        alone = (onehot * q[:, None]).sum(0).reshape(3, m)
        chance = alone[:, :, None, None] * alone[None, None] / total
        out += np.where(joint > 1e-9, joint * np.log(np.maximum(joint, 1e-9) / np.maximum(chance, 1e-12)), 0.0).sum((0, 2))
    return out


def forest(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Each voter's parent: the heaviest forest of pairs that share more than LINKED / 2 nats given the class."""
    shared = mutual_information(votes, p)
    m = len(shared)
    i, j = np.triu_indices(m, 1)
    strong = 2 * shared[i, j] >= LINKED
    i, j = i[strong], j[strong]
    near: list[list[int]] = [[] for _ in range(m)]
    group = list(range(m))
    for k in np.argsort(-shared[i, j], kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        if group[a] != group[b]:
            near[a].append(b)
            near[b].append(a)
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    parent = np.full(m, -1)
    seen: set[int] = set()
    for root in range(m):
        stack = [] if root in seen else [root]
        seen.add(root)
        while stack:
            a = stack.pop()
            for b in near[a]:
                if b not in seen:
                    seen.add(b)
                    parent[b] = a
                    stack.append(b)
    return parent


@dataclass
class ToxicityModel:
    terms: tuple[tuple[str, bool], ...]  # each once: a word beginning, and whether it counts only where dense
    coef: np.ndarray
    label_model: LabelModel | None = None

    def hits(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text how often each term begins a word."""
        automaton = _automaton(tuple(t for t, _ in self.terms))
        out = []
        for t in texts:
            low, found = t.lower(), {}
            for end, k in automaton.iter(low):
                at = end - len(self.terms[k][0])
                if at < 0 or not (low[at].isalnum() or low[at] == "_"):
                    found[k] = found.get(k, 0) + 1
            out.append(found)
        return out

    def views(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(votes, features) of each text. Voters: the terms, their common density, shouting, exclamation, no term at all, patterns."""
        m = len(self.terms)
        votes, feats = np.zeros((len(texts), m + _MORE_VOTES), dtype=np.int8), np.zeros((len(texts), m + _MORE_FEATURES))
        for i, (t, found) in enumerate(zip(texts, self.hits(texts))):
            words = len(t.split())
            for k, n in found.items():
                votes[i, k] = feats[i, k] = n >= DENSE * words if self.terms[k][1] else 1
            raw = t.encode("utf-8", "surrogatepass")
            capitals = (len(raw) - len(raw.translate(None, _UPPER))) / max(len(raw), 1)
            shouts = t.count("!") / max(len(raw), 1)
            share = sum(found.values()) / max(words, 1)
            voted = bool(votes[i, :m].any())
            low = t.lower()
            matched = [(bool(found) if n == "addressed" else any(s in low for s in _NEEDED[n])) and bool(p.search(low)) for n, p in _PATTERNS.items()]
            votes[i, m:] = bool(found) and share >= DENSE, capitals > 0.3, shouts > 0.02, -(not voted), *matched
            feats[i, m:] = voted, min(3.0, share / DENSE), bool(found), capitals, min(1.0, 20 * shouts), *matched
        return votes, feats

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.views(texts)[1] @ self.coef[1:] + self.coef[0])


_AUTOMATA: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    if terms not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            a.add_word(t, k)
        a.make_automaton()
        _AUTOMATA[terms] = a
    return _AUTOMATA[terms]


def beginnings(text: str) -> list[str]:
    """All beginnings of SHORTEST to LONGEST characters of the text's words; with a ~ after it each that is dense."""
    words = _WORD.findall(text.lower())
    seen: Counter = Counter()
    for w, k in Counter(words).items():
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            seen[w[:n]] += k
    return list(seen) + [f"{t}~" for t, k in seen.items() if k >= DENSE * len(words)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for part in slabs(batches, "text"):
        for t in part.column(0).to_pylist():
            seen.update(beginnings(t or ""))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])


def mine_terms(sample: DataFrame) -> list[tuple[str, bool]]:
    """Word beginnings (and whether only their density tells) that mark toxic texts of the sample, the most frequent first."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    odds = n1 / (n1 + n0)
    least = math.ceil(SURE / (2 * math.log(1 / odds)))  # with fewer no term is sure, even if no clean text has it
    toxic = sample.where("label = 1").select("text").mapInArrow(_counted, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("pos")).where(F.col("pos") >= least)
    pos = {r["term"]: r["pos"] for r in toxic.collect()}  # of a bounded sample
    wanted = frozenset(pos)

    def others(batches):
        for b in _counted(batches):
            keep = [t.as_py() in wanted for t in b.column(0)]
            yield b.filter(pa.array(keep, pa.bool_()))

    neg = {r["term"]: r["neg"] for r in sample.where("label = 0").select("text").mapInArrow(others, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("neg")).collect()}
    lift = {t: (p + 0.5) / (n1 + 1) / ((neg.get(t, 0) + 0.5) / (n0 + 1)) for t, p in pos.items()}
    sure = {t: 2 * sum(x * math.log(x / ((p + neg.get(t, 0)) * share)) for x, share in ((p, odds), (neg.get(t, 0), 1 - odds)) if x) for t, p in pos.items()}
    good = sorted((t for t in pos if lift[t] >= LIFT and sure[t] >= SURE and neg.get(t, 0) <= IMPURE * pos[t]), key=lambda t: (-pos[t], "~" in t, -len(t), t))
    chosen: list[tuple[str, bool]] = []
    for t in good:
        word = t.rstrip("~")
        if not any(word.startswith(c) or c.startswith(word) for c, _ in chosen):
            chosen.append((word, t != word))
        if len(chosen) == MAX_TERMS:
            break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Mine terms, fit the label model to the sample's votes, and the classifier to its posteriors."""
    ship(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, "toxic", max_rows, HELD_OUT, id_col, text_col), "labelled")
    mined = mine_terms(sample)
    terms = tuple(mined + [(w, False) for w in INSULTS if not any(w.startswith(t) for t, _ in mined)])
    m = len(terms)
    # the weights of the fixed words and patterns: any word, addressed to someone or not, and a threat are toxic, a dismissal is half so
    by_rule = ToxicityModel(terms, np.r_[-4.0, np.zeros(m), 8.0, np.zeros(4), 2.0, 4.0, 6.0, 2.0])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slabs(batches, "text"):
            v, x = by_rule.views(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["v", "x"])

    rows = sample.select("text").mapInArrow(seen, "v binary, x binary").collect()  # max_rows narrow rows
    forget(sample)
    if not rows:
        return by_rule
    votes = np.stack([np.frombuffer(r["v"], np.int8) for r in rows]).astype(np.int64)
    feats = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float)
    # terms name the class; patterns such as shouting go along with it or not, as the model finds
    model = LabelModel.fit(votes, start=0.05 + 0.9 * votes[:, : len(terms)].any(1))
    return ToxicityModel(terms, logistic(feats, model.posterior(votes), l2=1e-4, towards=by_rule.coef), model)


def score(df: DataFrame, model: ToxicityModel, name: str, text_col: str = "text") -> DataFrame:
    """`df` with the score of every row in column `name`. One pass, no shuffle."""
    ship(df.sparkSession)
    return with_scores(df, text_col, name, model.score)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with their columns, that score below the threshold."""
    name = fresh_name(docs.columns, "toxicity")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)
