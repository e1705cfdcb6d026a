"""Toxicity: a weighted grammar of clauses.

Small transducers read the words of a clause as classes - insult, threat, target, agent, negation, reported
speech, link, turn, other - and are composed by a product of their states: one machine reads the clause from the
left, one from the right, and a hit is weighed by the states of both beside it.  An insult counts more when a target
stands near on either side.  A threat counts only with a target behind it, more with an agent before it.
Both count little in a negation's scope, which links carry on, one other word survives and a turn ("but") ends, and
half in reported speech, whether the verb stands before or behind.  A document's score is a logistic function of
its clauses' weights; words outside such clauses don't matter.

What counts as an insult beyond a short base list is learned: stems that toxic rows have far more often than
others.  A stem that toxic rows have with OPEN different ends at least inflects freely: it counts with any end, and weighs by its odds.  Other stems give the whole words
that toxic rows have with them; these and the base list count only as whole words, with one of ENDS or without.  Learning reads at most
``FIT_ROWS`` labelled rows of each class, those with the smallest hash of their key, in one task;
rows whose crc32(key as text) mod 3 is 1 are held out.  Near copies among them (half of a row's SKETCH least shingles in one
earlier row) are learned from once.  Scores use the text alone.

Defined results: NULL and empty texts have no clause and the lowest score; without labels
the base list and fixed coefficients are used; a key labelled twice is toxic if one of its
labels says so; of several texts under one labelled key the least is learned from; ties in the order of
labelled rows go to the smaller key; repeated rows are scored each; a NULL key is scored, not held out and
never learned from; very long texts are read whole, clause by clause; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import texts

#: At most so many labelled rows of each class are read to learn.
FIT_ROWS = 3_000
THRESHOLD = 0.7

# Word classes that are not learned, in four languages.
INSULTS = "idiot stupid moron loser pathetic worthless scum dumb filth bastard idiota imbecil estupido imbecile debile dummkopf abschaum".split()
THREATS = "kill murder shoot stab hang strangle beat destroy hurt hunt crush slaughter umbringen töten matar tuer".split()
TARGETS = "you your yours u he she they him them her these those people all du dich dir ihr euch sie tu te toi vous ils elle tú ti usted ellos".split()
AGENTS = "i we im ill gonna ich wir je j nous yo nosotros".split()
NEGATIONS = "not never no isn aren wasn don didn without nicht kein keine nie pas jamais sans nunca sin".split()
REPORTS = "said says wrote claimed called quoted reported told sagte schrieb meinte dit écrit dijo escribió".split()
LINKS = "a an the any such so very really that this is are am be been was were being to of t s will going ein eine der die das ist sind sehr so un une le la les est très es el los muy".split()
TURNS = "but instead however rather sondern aber mais pero sino".split()
#: Ends that a base word or learned form can take.
ENDS = "s es e n en er ers in innen".split()

INSULT, THREAT, TARGET, AGENT, NEGATION, REPORT, LINK, TURN, OTHER = range(9)
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n…]")

#: Learned stems have 3 to 8 letters; they are at least so much likelier in toxic rows, and a
#: log-likelihood ratio of their counts is so large that chance doesn't explain it among a million stems.
STEM = range(3, 9)
MIN_ODDS, MIN_RATIO = 5.0, 27.0
#: Different ends by which a stem is known to inflect freely; odds from which a stem weighs in full.
OPEN, FULL_ODDS = 8, 50.0
#: Part of a stem's toxic rows that a longer one must keep to replace it.
MOST = 0.75
#: Least digests of 5-word shingles by which near copies are told.
SKETCH, SHINGLE = 16, 5
NEAR = 4  # words within which a target or an agent counts
SCOPE = 2  # the word, other than links, at which a negation's scope ends

#: What the machines remember, as bits.
INSULTED, THREATENED, AIMED, LED, NEGATED, REPORTED = (1 << i for i in range(6))
#: Factors of a hit by what stands beside it; without frames each is 1.
FACTORS = {AIMED: 1.5, LED: 1.5, NEGATED: 0.3, REPORTED: 0.5}


@dataclass
class Transducer:
    """States from 0; step(state, class) gives the next state, output(state) the bits a hit beside it is weighed by."""

    n: int
    step: Callable[[int, int], int]
    output: Callable[[int], int]


def _near(kind: int, bit: int) -> Transducer:
    """Remembers for NEAR words that a word of the class was read."""
    return Transducer(NEAR + 1, lambda s, c: NEAR if c == kind else max(0, s - 1), lambda s: bit if s else 0)


def _since(kind: int, bit: int) -> Transducer:
    """Remembers it to the end of the clause."""
    return Transducer(2, lambda s, c: 1 if c == kind else s, lambda s: bit if s else 0)


def _scope() -> Transducer:
    """A negation's scope: other words use it up, turns and reporting verbs end it."""

    def step(s: int, c: int) -> int:
        return SCOPE if c == NEGATION else 0 if c in (TURN, REPORT) else max(0, s - 1) if c == OTHER else s

    return Transducer(SCOPE + 1, step, lambda s: NEGATED if s else 0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The product machine; it has the bits of both."""

    def step(state: int, c: int) -> int:
        a, b = divmod(state, second.n)
        return first.step(a, c) * second.n + second.step(b, c)

    return Transducer(first.n * second.n, step, lambda s: first.output(s // second.n) | second.output(s % second.n))


def tables(*parts: Transducer) -> tuple[list[list[int]], list[int]]:
    """The composed machine as tables: [state][class] -> state, and [state] -> bits."""
    whole = functools.reduce(compose, parts)
    return [[whole.step(s, c) for c in range(OTHER + 1)] for s in range(whole.n)], [whole.output(s) for s in range(whole.n)]


def from_left() -> tuple[list[list[int]], list[int]]:
    return tables(_since(INSULT, INSULTED), _since(THREAT, THREATENED), _near(TARGET, AIMED), _near(AGENT, LED), _scope(), _since(REPORT, REPORTED))


def from_right() -> tuple[list[list[int]], list[int]]:
    return tables(_near(TARGET, AIMED), _since(REPORT, REPORTED))


def weight(kind: int, before: int, behind: int, frames: bool = True) -> float:
    """Weight of an insult or a threat by the bits on its left and right; later ones of a clause count by half."""
    threat, found = kind == THREAT, (before | behind) & (AIMED | REPORTED) | before & NEGATED
    out = 0.5 if before & (THREATENED if threat else INSULTED) else 1.0
    if not frames:
        return out
    if threat:
        if not behind & AIMED:
            return 0.0
        found = found & ~AIMED | before & LED
    return out * math.prod(f for bit, f in FACTORS.items() if found & bit)


def trie_pattern(stems: list[str]) -> str:
    """One pattern for many stems, shared beginnings written once."""
    tree: dict = {}
    for stem in stems:
        node = tree
        for c in stem:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        ways = [re.escape(c) + write(x) for c, x in sorted(node.items()) if c]
        if not ways:
            return ""
        return "(?:" + "|".join(ways) + ")" + ("?" if "" in node else "")

    return write(tree)


@dataclass
class Model:
    """forms: insults beside the base list, as whole words; stems: beginnings of insults, with their weights; without frames hits are weighed alone."""

    forms: list[str] = field(default_factory=list)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -2.5
    per_sum: float = 2.5
    per_top: float = 1.0
    per_part: float = 0.0
    frames: bool = True

    def __post_init__(self) -> None:
        whole = f"{trie_pattern(sorted({*self.forms, *INSULTS}))}(?:{trie_pattern(ENDS)})?(?![^\\W\\d_])"
        opened = f"|{trie_pattern(sorted(self.stems))}" if self.stems else ""
        self._hit = re.compile(rf"\b(?:{whole}|{trie_pattern(THREATS)}(?![^\W\d_]){opened})")
        self._whole = re.compile(whole)
        self._open = re.compile(opened[1:]) if self.stems else None
        kinds = ((LINK, LINKS), (TURN, TURNS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (AGENT, AGENTS), (TARGET, TARGETS), (THREAT, THREATS))
        self._class = {w: c for c, words in kinds for w in words}
        self._left, self._right = from_left(), from_right()

    def classed(self, word: str) -> tuple[int, float]:
        """Its class and own weight."""
        c = self._class.get(word, OTHER)
        if c == OTHER and self._whole.fullmatch(word):
            return INSULT, 1.0
        if c == OTHER and self._open and (found := self._open.match(word)):
            return INSULT, self.stems[found[0]]
        return c, 1.0

    def weigh(self, words: list[str]) -> float:
        """The sum of a clause's weights."""
        classed = [self.classed(word) for word in words]
        (step, bits), (back, back_bits) = self._left, self._right
        behind, state = [0] * len(classed), 0
        for i in range(len(classed) - 1, -1, -1):
            behind[i], state = back_bits[state], back[state][classed[i][0]]
        total, state = 0.0, 0
        for (c, own), after in zip(classed, behind, strict=True):
            if c <= THREAT:
                total += own * weight(c, bits[state], after, self.frames)
            state = step[state][c]
        return total

    def clause_weights(self, text: str) -> list[float]:
        """Weights of the clauses that hold an insult or a threat."""
        low, out, done = text.lower(), [], 0
        for hit in self._hit.finditer(low):
            if hit.start() < done:
                continue
            start = max([done, *(low.rfind(c, done, hit.start()) + 1 for c in ".!?;:\n…")])
            end = _CLAUSE.search(low, hit.start())
            done = end.end() if end else len(low)
            total = self.weigh(_WORD.findall(low, start, done))
            if total:
                out.append(total)
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """By the sum of all weights, the heaviest clause, and the weight among so many words."""
        weights = self.clause_weights(text)
        if not weights:
            return 0.0, 0.0, 0.0
        total = math.fsum(weights)
        return math.log1p(total), min(3.0, max(weights)), math.log1p(100 * total / (20 + len(text.split())))

    def score(self, text: str) -> float:
        total, top, part = self.features(text)
        z = self.bias + self.per_sum * total + self.per_top * top + self.per_part * part
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def without_near_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without those that share half of their sketch with one earlier row of the label; a shared line or footer doesn't make a copy."""
    kept, owners = [], defaultdict(list)
    for i, (text, label) in enumerate(rows):
        w = text.lower().split()
        digests = {zlib.crc32(" ".join(w[j : j + SHINGLE]).encode("utf-8", "surrogatepass")) for j in range(max(1, len(w) - SHINGLE + 1))}
        sketch = sorted(digests)[:SKETCH]
        shared = Counter(owner for x in sketch for owner in owners[label, x])
        if shared and 2 * max(shared.values()) >= len(sketch):
            continue
        kept.append((text, label))
        for x in sketch:
            owners[label, x].append(i)
    return kept


def learn_forms(rows: list[tuple[str, int]]) -> tuple[list[str], dict[str, float]]:
    """Whole words with stems of toxic rows, and weights of stems that inflect freely."""
    toxic, clean, n, whole = Counter(), Counter(), Counter(), (Counter(), Counter())
    for text, label in without_near_copies(rows):
        n[label] += 1
        words = set(_WORD.findall(text.lower()))
        (toxic if label else clean).update({w[:k] for w in words for k in STEM if len(w) >= k})
        whole[label].update(words)
    every = n[0] + n[1]

    def ratio(stem: str) -> float:
        """Log-likelihood ratio of its counts; 0 if it isn't so much likelier in toxic rows."""
        t, c = toxic[stem], clean[stem]
        if (t + 0.5) * (n[0] + 1) < MIN_ODDS * (c + 0.5) * (n[1] + 1):
            return 0.0
        return 2 * (t * math.log(t * every / ((t + c) * n[1])) + (c * math.log(c * every / ((t + c) * n[0])) if c else 0.0))

    telling = {s: r for s in toxic if (r := ratio(s)) >= MIN_RATIO}
    # a longer stem with most of the toxic rows and fewer of the others is the better one; else the shorter
    good = set(telling)
    for stem in telling:
        good -= {s for s in (stem[:k] for k in range(3, len(stem))) if toxic[stem] >= MOST * toxic[s] and clean[stem] < clean[s]}
    good = {s for s in good if not any(s[:k] in good for k in range(3, len(s)))}
    ends = Counter(w[:k] for w in whole[1] for k in STEM if len(w) >= k and w[:k] in good)
    stems = {s for s in good if ends[s] >= OPEN}
    odds = {s: (toxic[s] + 0.5) * (n[0] + 1) / ((clean[s] + 0.5) * (n[1] + 1)) for s in stems}
    forms = {w for w in whole[1] if any(w[:k] in good for k in STEM) and not any(w[:k] in stems for k in STEM) and (whole[1][w] + 0.5) * (n[0] + 1) >= MIN_ODDS * whole[0][w] * (n[1] + 1)}
    return sorted(forms), {s: round(min(1.0, math.log(odds[s]) / math.log(FULL_ODDS)), 6) for s in sorted(stems)}


def fit(rows: list[tuple[str, int]], frames: bool = True) -> Model:
    """Forms, then a ridge logistic regression on the three features by Newton steps."""
    import numpy as np

    if len({label for _, label in rows}) < 2:
        return Model(frames=frames)
    # forms from one half of the rows, coefficients from the other: the sums then are as for unseen text
    model = Model(*learn_forms(rows[::2]), frames=frames)
    x = np.array([(1.0, *model.features(text)) for text, _ in rows[1::2]])
    y = np.array([label for _, label in rows[1::2]], dtype=float)
    if len(x) and 0 < y.sum() < len(y):
        w, ridge = np.zeros(4), np.diag([0.1, 1.0, 1.0, 1.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        model = Model(*learn_forms(rows), *map(float, w), frames=frames)
    return model


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows that are not held out, at most ``fit_rows`` of each class."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out("id"))
    order = F.xxhash64("id")
    picked = known.filter("y = 1").orderBy(order, "id").limit(fit_rows).unionByName(known.filter("y = 0").orderBy(order, "id").limit(fit_rows))
    # at most 2 * fit_rows rows of two numbers
    rows = texts(df, key, text).join(F.broadcast(picked), F.col("k") == F.col("id")).groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(itertools.chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for b in batches))
        model = fit([(t, y) for _, t, y in got])
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(model))])], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model string").first()
    return Model(**json.loads(found.model)) if found else Model()


def score_toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted; ``th`` is left to callers that must tell repeated keys apart."""
    args = asdict(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        run = _model(json.dumps(args)).score
        return pa.array([run(t) for t in column.to_pylist()], pa.float64())

    rows = texts(df, key, text).select(F.col("k").alias(key), held_out("k").alias("held_out"), score("t").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


_MODELS: dict[str, Model] = {}


def _model(args: str) -> Model:
    """Built once in a worker."""
    if args not in _MODELS:
        _MODELS.clear()
        _MODELS[args] = Model(**json.loads(args))
    return _MODELS[args]


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns, that are not predicted toxic."""
    args = json.dumps(asdict(model))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        run = _model(args).score
        return pa.array([run(t or "") for t in column.to_pylist()], pa.float64())

    return df.filter(score(F.col(text)) < THRESHOLD)
