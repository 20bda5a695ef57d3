"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insult, threat, target, negation, reporting. Small
transducers each follow one relation over a clause: whether a target stands near an
insult, on either side, whether the insult is negated, whether the clause reports
somebody's words, whether a threat is completed by a target. Their composition, built
once as a table from left to right and one from right to left, runs over the clauses
that hold an insult or a threat, and says on which path each of them lies. Clauses end
at marks, commas and lines.

What counts is not a word but the path: a document's features are the weights of its
clauses summed for each path (bare, targeted, negated, reported, threat), and a
logistic regression learns what each path is worth. So a relation counts as far as
labels bear it out.

Insults and their weights are learned too: words, and stems with many endings, that
separate the toxic from the other documents of a bounded labelled sample, in each of
its halves. The words of the other classes are given. Texts are split by the same
pattern in learning and in scoring, so markup, slashes and dashes hide no word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import give_back, held_out, labelled_sample, logistic

#: Most labelled documents that the lexicon and the weights are learned from.
SAMPLE = 6000
#: An entry of the lexicon is in so many toxic documents at least, and so many times likelier there.
LEAST_DOCS, LEAST_RATIO = 6, 6.0
#: The same in either half of the sample.
HALF_DOCS, HALF_RATIO = 3, 4.0
#: A stem is an entry if it has so many endings.
LEAST_ENDINGS = 12
STEM = range(4, 9)
#: Most tokens that a reader remembers, and the longest of them.
CACHE, LONGEST = 1 << 18, 64

NEUTRAL, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
GIVEN = {
    THREAT: "kill hurt shoot stab strangle murder punch burn hang beat destroy töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours yourself u ur he she they them him her his their du dich dir dein ihr euch sie tu te toi ton vous votre il elle eux tú usted ustedes vosotros él ella ellos",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says say told quote quoted quotes called wrote writes claimed reported according sagte sagt zitiert dit disait écrit cité dijo dice escribió",
}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: A mark between words that ends a clause; one before a digit is part of a number. The end of a line is read as LINE.
LINE = "\0"
MARKS = frozenset(".!?;,:" + LINE)
END = re.compile(rf"[.!?;,:{LINE}](?![\d_])")
#: Relations of an insult, as bits; its path is the first that holds, reported before negated before targeted, or bare.
TARGETED, NEGATED, REPORTED = 1, 2, 4
PATHS = ("bare", "targeted", "negated", "reported", "threat")
PATH_OF = [3 if bits & REPORTED else 2 if bits & NEGATED else 1 if bits & TARGETED else 0 for bits in range(8)]


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, class) -> (next state, log factor for an insult or None, log weight of a threat or None). Missing arcs go to rest with no output.

    relation: the bit that a factor stands for.
    """

    relation: int
    arcs: dict
    rest: dict = field(default_factory=dict)

    def step(self, state: int, kind: int) -> tuple[int, float | None, float | None]:
        return self.arcs.get((state, kind), (self.rest.get(state, 0), None, None))


def within(relation: int, kind: int, span: int, factor: float) -> Transducer:
    """After a word of the class, insults among the next span words get the factor."""
    arcs = {}
    for state in range(span + 1):
        arcs[state, kind] = (span, None, None)
        arcs[state, INSULT] = (max(state - 1, 0), math.log(factor) if state else None, None)
    return Transducer(relation, arcs, {s: max(s - 1, 0) for s in range(span + 1)})


def until_end(relation: int, kind: int, factor: float) -> Transducer:
    arcs = {(0, kind): (1, None, None), (1, kind): (1, None, None), (1, INSULT): (1, math.log(factor), None)}
    return Transducer(relation, arcs, {0: 0, 1: 1})


def threat(span: int, weight: float) -> Transducer:
    """A threat is a threatening verb that a target follows among the next span words."""
    arcs = {}
    for state in range(span + 1):
        arcs[state, THREAT] = (span, None, None)
        if state:
            arcs[state, TARGET] = (0, None, math.log(weight))
    return Transducer(0, arcs, {s: max(s - 1, 0) for s in range(span + 1)})


TARGET_NEAR = within(TARGETED, TARGET, 3, 1.5)
#: From left to right: a target and a negation before an insult, reporting anywhere before it, threats of their own.
GRAMMAR = (TARGET_NEAR, within(NEGATED, NEGATION, 2, 0.5), until_end(REPORTED, REPORT, 0.7), threat(3, 2.0))
#: From right to left: a target after it. A relation that both sides find counts once.
BACKWARDS = (TARGET_NEAR,)


def composed(parts: tuple[Transducer, ...]) -> list[list[tuple[int, int, float]]]:
    """The product of the transducers as one table: state, class -> (state, relations of an insult, weight of a threat)."""
    number, todo, table = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for states in todo:
        row = []
        for kind in range(6):
            steps = [t.step(s, kind) for t, s in zip(parts, states, strict=True)]
            to = tuple(x[0] for x in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            bits = sum(t.relation for t, x in zip(parts, steps, strict=True) if x[1] is not None)
            row.append((number[to], bits, sum(math.exp(x[2]) for x in steps if x[2] is not None)))
        table.append(row)
    return table


def factors(parts: tuple[Transducer, ...]) -> list[float]:
    """What an insult of each set of relations weighs before anything is learned."""
    of = {t.relation: max(x[1] for x in t.arcs.values() if x[1] is not None) for t in parts if t.relation}
    return [math.exp(sum(v for bit, v in of.items() if bits & bit)) for bits in range(8)]


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        self.given = {w: kind for kind, words in GIVEN.items() for w in words.split()}
        self.lengths = sorted({len(x) for x in self.stems})

    def look(self, word: str) -> tuple[int, float]:
        """A given class comes first: labels can't turn a threat or a target into an insult."""
        if word in self.given:
            return self.given[word], 0.0
        if word in self.words:
            return INSULT, self.words[word]
        for k in self.lengths:
            if word[:k] in self.stems and len(word) > k:
                return INSULT, self.stems[word[:k]]
        return NEUTRAL, 0.0


@dataclass
class Counts:
    """Documents, words and stems by label, and the endings of stems in toxic documents."""

    n: Counter
    words: tuple[Counter, Counter]
    stems: tuple[Counter, Counter]
    endings: dict[str, set[str]]

    @staticmethod
    def of(sample: Iterable[tuple[int, str, int]]) -> Counts:
        out = Counts(Counter(), (Counter(), Counter()), (Counter(), Counter()), defaultdict(set))
        for _, text, y in sample:
            own = set(WORD.findall(text.lower()))
            out.n[y] += 1
            out.words[y].update(own)
            out.stems[y].update({w[:k] for w in own for k in STEM if len(w) > k})
            if y:
                for w in own:
                    for k in STEM:
                        if len(w) > k:
                            out.endings[w[:k]].add(w)
        return out

    def __add__(self, other: Counts) -> Counts:
        two = [(a[0] + b[0], a[1] + b[1]) for a, b in ((self.words, other.words), (self.stems, other.stems))]
        endings = defaultdict(set, {k: v | other.endings.get(k, set()) for k, v in self.endings.items()})
        for k, v in other.endings.items():
            endings.setdefault(k, v)
        return Counts(self.n + other.n, *two, endings)

    def weight(self, stems: bool, x: str) -> float:
        c = self.stems if stems else self.words
        return math.log((c[1][x] + 0.5) / (self.n[1] + 1)) - math.log((c[0][x] + 0.5) / (self.n[0] + 1))


def learned(one: Counts, two: Counts) -> Lexicon:
    """Entries and their log ratios, capped, that hold in both halves: words, and stems in the place of the words that they begin."""
    both = one + two
    half = math.log(HALF_RATIO)

    def holds(stems: bool, x: str) -> bool:
        return all((c.stems if stems else c.words)[1][x] >= HALF_DOCS and c.weight(stems, x) >= half for c in (one, two))

    given = {w for words in GIVEN.values() for w in words.split()}
    least, stems = math.log(LEAST_RATIO), both.stems[1]
    ordered = sorted(stems)
    found: dict[str, float] = {}
    for s in sorted((s for s, n in stems.items() if n >= LEAST_DOCS), key=lambda s: (len(s), s)):
        if len(both.endings[s]) < LEAST_ENDINGS or any(s[:k] in found for k in STEM if k < len(s)) or both.weight(True, s) < least or not holds(True, s):
            continue
        # The longest start that the same documents share says more than the shortest.
        at, many = bisect_left(ordered, s), stems[s]
        while at < len(ordered) and ordered[at].startswith(s[: min(STEM)]):
            x = ordered[at]
            if x.startswith(s) and (len(x), x) > (len(s), s) and stems[x] >= 0.9 * many:
                s = x
            at += 1
        found[s] = min(both.weight(True, s), 4.0)
    single = {
        w: min(v, 4.0)
        for w, c in both.words[1].items()
        if c >= LEAST_DOCS and w not in given and (v := both.weight(False, w)) >= least and holds(False, w) and not any(w[:k] in found for k in STEM if k < len(w))
    }
    return Lexicon(single, found)


class Reader(dict):
    """token between blanks -> (class, weight, whether a clause ends before it, and after it) for each of its words. A token without words is one neutral word."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.table, self.back, self.factors = lexicon, composed(GRAMMAR), composed(BACKWARDS), factors(GRAMMAR + BACKWARDS)
        self.same: dict = {}  # nearly all tokens read alike: they share one value
        self.telling: set[str] = set()  # tokens that hold an insult or a threatening verb

    def __missing__(self, token: str) -> tuple[tuple[int, float, bool, bool], ...]:
        bare = token[:-1] if token[-1] in MARKS else token
        if bare.isalpha():
            # One word, and perhaps a mark that ends its clause.
            value = ((*self.lexicon.look(bare), False, bare is not token),)
        elif found := WORD.findall(token):
            ends = [END.search(x) is not None for x in WORD.split(token)]
            # The mark between two words of a token ends the clause of the first.
            value = tuple((*self.lexicon.look(w), k == 0 and ends[0], ends[k + 1]) for k, w in enumerate(found))
        else:
            value = ((NEUTRAL, 0.0, False, END.search(token) is not None),)
        if any(x[0] in (INSULT, THREAT) for x in value):
            self.telling.add(token)
        value = self.same.setdefault(value, value)
        if len(token) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[token] = value
        return value

    def paths(self, text: str | None) -> tuple[list[list[float]], int]:
        """(for each matched clause the weights of its insults and threats on each path, number of words)."""
        tokens = text.lower().replace("\n", f" {LINE} ").split() if text else []
        found = list(map(self.__getitem__, tokens))
        if self.telling.isdisjoint(tokens):
            return [], sum(map(len, found))
        read = list(chain.from_iterable(found))
        hits = [i for i, x in enumerate(read) if x[0] in (INSULT, THREAT)]
        out, done = [], -1
        for i in hits:
            if i <= done:
                continue
            start, stop = i, i + 1
            while start > done + 1 and not read[start][2] and not read[start - 1][3]:
                start -= 1
            while stop < len(read) and not read[stop - 1][3] and not read[stop][2]:
                stop += 1
            done = stop - 1
            own = [0.0] * len(PATHS)
            relations: dict[int, int] = {}
            state = 0
            for at in range(start, stop):
                kind = read[at][0]
                state, bits, threats = self.table[state][kind]
                own[4] += threats
                if kind == INSULT:
                    relations[at] = bits
            state = 0
            for at in range(stop - 1, start - 1, -1):
                state, bits, _ = self.back[state][read[at][0]]
                if at in relations:
                    bits |= relations[at]
                    own[PATH_OF[bits]] += read[at][1] * self.factors[bits]
            if any(own):
                out.append(own)
        return out, len(read)

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """(weights of the matched clauses, number of words)."""
        found, n = self.paths(text)
        return [sum(own) for own in found], n

    def features(self, text: str | None) -> list[float]:
        found, n = self.paths(text)
        sums = [sum(own[k] for own in found) for k in range(len(PATHS))]
        return [*map(math.log1p, sums), max(map(sum, found), default=0.0), math.log1p(len(found)), math.log1p(1000 * sum(sums) / (n + 20)), math.log1p(n)]


FEATURES = len(PATHS) + 4


@dataclass
class Model:
    lexicon: Lexicon
    fit: tuple | None
    prior: float

    def scores(self, reader: Reader, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([reader.features(t) for t in texts], np.float64).reshape(-1, FEATURES)
        if self.fit is None:
            return np.full(len(x), self.prior)
        w, bias, mean, scale = self.fit
        return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """From labelled documents that are not held out. Without documents of both labels every score is the share of toxic ones."""
    sample = labelled_sample(docs, labels, "toxic", bound)
    y = np.array([r[2] for r in sample], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(Lexicon({}, {}), None, float(y.mean()) if len(y) else 0.0)
    # Weights are fitted on documents that the lexicon of the others was learned from, so it can't praise itself.
    quarters = [Counts.of(sample[k::4]) for k in range(4)]
    x = np.empty((len(sample), FEATURES))
    for k in (0, 2):
        reader = Reader(learned(*quarters[2 - k : 4 - k]))
        for j in (k, k + 1):
            x[j::4] = np.array([reader.features(r[1]) for r in sample[j::4]]).reshape(-1, FEATURES)
    return Model(learned(quarters[0] + quarters[1], quarters[2] + quarters[3]), logistic(x, y), float(y.mean()))


def scorer(model: Model) -> Callable[[Column], Column]:
    """The score of a text column; only texts travel to the workers."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.lexicon)
        for texts in batches:
            yield pd.Series(model.scores(reader, texts))
        del reader
        give_back()

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5). Null and empty texts are scored as texts without words; a null id is not held out."""
    out = F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out")
    scored = docs.select(F.col(doc_id), out, scorer(model)(F.col(text)).alias("score"))
    return scored.select(doc_id, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    return docs.filter(scorer(train(docs, labels, bound))(F.col("text")) < 0.5)
