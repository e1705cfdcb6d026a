"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

A candidate is a whole stretch of CANDIDATE characters, LONG of them or more, with a letter and a digit.  Those that a fixed
pattern finds are findings: they stay, and they are what the network learns from, as opposed to candidates that no pattern
touches.  The network reads a candidate with BEFORE characters before and AFTER behind it; a candidate of more than
VALUE characters is read in pieces, whose scores are averaged, so that it counts as a whole.  Characters are embedded, two
layers of convolutions run over them, and what is left after taking the largest and the mean over all places is weighed; all in numpy.

The patterns know some names only, so each finding is learned from three times: as it stands, without its context, and with its letters
and digits drawn anew, which leaves its form.  The others get as much: as they stand, without context, and names made of
the words around.  All distinct windows are learned from, by their hashes, however the documents are dealt: in one task if there are at most FIT of each kind,
otherwise in groups, whose weights are averaged after each round (parameter mixing).  A quarter is set aside: on all of it the scores are calibrated (a logistic
fit) and the threshold is set: of all thresholds that find RECALL of the findings those with the fewest false alarms, and of these the middle.

Defined results: NULL and empty texts hold nothing; without LEAST windows of each kind nothing is learned and the patterns alone
count; a NULL key comes out as NULL; spans of equal start are in the order of KINDS; equal windows are learned from once; repeated rows are scanned
each; texts are scanned whole, however long; an empty table gives no rows; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import small_batches, texts, written

# Patterns, and characters that a finding has at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "learned")

LONG = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LONG)
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
BEFORE, VALUE, AFTER = 24, 64, 8
WINDOW = BEFORE + VALUE + AFTER

#: Windows of each kind that one task learns from alone; more are dealt into groups, SHARDS at most. And those that are needed at least.
FIT, SHARDS, LEAST = 2_000, 32, 20
RECALL = 0.95
EPOCHS, BATCH, RATE = 8, 128, 3e-3
EMBED, WIDE, FIRST, SECOND = 12, 5, 24, 32
_SEED = 7

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind."""
    found = {"assign": [], "access": [], "hex": []}
    if "=" in text or ":" in text:
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text)]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[Span]:
    return [m.span() for m in CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]


def split_candidates(text: str, base: dict[str, list[Span]]) -> tuple[list[Span], list[Span]]:
    """Candidates that a finding touches, and the others."""
    taken, near, rest = sorted(s for spans in base.values() for s in spans), [], []
    ends, most = [], 0
    for _, e in taken:
        most = max(most, e)
        ends.append(most)
    i = 0
    for s, e in candidates(text):
        while i < len(taken) and taken[i][0] < e:
            i += 1
        (near if i and ends[i - 1] > s else rest).append((s, e))
    return near, rest


def windows(text: str, span: Span) -> list[str]:
    """The candidate in pieces, each as BEFORE + VALUE + AFTER characters; NUL stands for none."""
    s, e = span
    starts = list(range(s, max(s + 1, e - VALUE + 1), VALUE))
    if starts[-1] + VALUE < e:
        starts.append(e - VALUE)
    out = []
    for a in starts:
        z = min(a + VALUE, e)
        out.append(text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:z].ljust(VALUE, "\0") + text[z : z + AFTER].ljust(AFTER, "\0"))
    return out


_CODES = np.full(128, 96, dtype=np.int64)
_CODES[0] = 0
_CODES[32:127] = np.arange(1, 96)


def encoded(rows: list[str]) -> np.ndarray:
    """Codes of the characters: 0 none, 1 to 95 printable ASCII, 96 any other."""
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, WINDOW)
    return _CODES[np.minimum(points, 127)]


class Network:
    """Embedding, two convolutions, largest and mean over all places, one weight each."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None) -> None:
        if weights is None:
            r = np.random.default_rng(_SEED)
            draw = lambda *shape: r.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)
            weights = {"e": r.normal(0, 0.5, (97, EMBED)).astype(np.float32), "w1": draw(WIDE * (EMBED + 1), FIRST), "b1": np.zeros(FIRST, np.float32), "w2": draw(3 * FIRST, SECOND), "b2": np.zeros(SECOND, np.float32), "w3": draw(2 * SECOND, 1), "b3": np.zeros(1, np.float32)}
        self.weights = weights

    @staticmethod
    def _slices(x: np.ndarray, k: int) -> np.ndarray:
        """(rows, places, k * channels): k neighbours side by side."""
        return sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - k + 1, -1)

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        inside = np.zeros((*codes.shape, 1), np.float32)
        inside[:, BEFORE : BEFORE + VALUE] = (codes[:, BEFORE : BEFORE + VALUE, None] > 0).astype(np.float32)
        x1 = self._slices(np.concatenate([w["e"][codes], inside], axis=2), WIDE)
        h1 = np.maximum(x1 @ w["w1"] + w["b1"], 0)
        x2 = self._slices(h1, 3)
        h2 = np.maximum(x2 @ w["w2"] + w["b2"], 0)
        top = h2.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h2, top[:, None], 1)[:, 0], h2.mean(axis=1)], axis=1)
        return (pooled @ w["w3"] + w["b3"])[:, 0], (codes, x1, h1, x2, h2, top, pooled)

    def gradients(self, state: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of d * score."""
        w, (codes, x1, h1, x2, h2, top, pooled) = self.weights, state
        g = {"w3": pooled.T @ d[:, None], "b3": np.array([d.sum()], np.float32)}
        dp = d[:, None] * w["w3"][:, 0]
        dh2 = np.repeat(dp[:, None, SECOND:] / h2.shape[1], h2.shape[1], axis=1)
        rows, channels = np.arange(len(d))[:, None], np.arange(SECOND)
        dh2[rows, top, channels] += dp[:, :SECOND]
        dh2 *= h2 > 0
        g["w2"], g["b2"] = np.tensordot(x2, dh2, ((0, 1), (0, 1))), dh2.sum((0, 1))
        dh1 = self._spread(dh2 @ w["w2"].T, 3, h1.shape) * (h1 > 0)
        g["w1"], g["b1"] = np.tensordot(x1, dh1, ((0, 1), (0, 1))), dh1.sum((0, 1))
        dx = self._spread(dh1 @ w["w1"].T, WIDE, (*codes.shape, EMBED + 1))[..., :EMBED]
        g["e"] = (codes.reshape(-1, 1) == np.arange(97)).astype(np.float32).T @ dx.reshape(-1, EMBED)
        return g

    @staticmethod
    def _spread(d: np.ndarray, k: int, shape: tuple) -> np.ndarray:
        out = np.zeros(shape, np.float32)
        d = d.reshape(*d.shape[:2], k, -1)
        for i in range(k):
            out[:, i : i + d.shape[1]] += d[:, :, i]
        return out

    def scores(self, rows: list[str]) -> np.ndarray:
        return np.concatenate([self.forward(encoded(rows[i : i + 512]))[0] for i in range(0, len(rows), 512)]) if rows else np.zeros(0)


def varied(rows: list[str], found: bool, r: np.random.Generator) -> list[str]:
    """Each window as it stands, without context, and with another value: a finding's letters drawn anew, or a name made of the words before."""
    signs, out = string.ascii_letters + string.digits, []
    kinds = (string.digits + "abcdef", string.ascii_uppercase + string.digits, signs, signs)
    for row in rows:
        head, value, tail = row[:BEFORE], row[BEFORE : BEFORE + VALUE].rstrip("\0"), row[BEFORE + VALUE :]
        if found:
            drawn = kinds[r.integers(len(kinds))]
            new = "".join(drawn[r.integers(len(drawn))] if c.isalnum() else c for c in value)
            # a stretch of random signs, long enough to be told from a name
            new = new if len(new) >= 20 else new + "".join(drawn[i] for i in r.integers(len(drawn), size=20 - len(new)))
        else:
            words = re.findall(r"[A-Za-z]{2,}", head + " " + tail) or ["name"]
            new = ("_", "-", ".", "/", "")[r.integers(5)].join(words[i] for i in r.integers(len(words), size=r.integers(2, 6))) + str(r.integers(10_000))
        blank = ("\0" * BEFORE, "\0" * AFTER)
        around = blank if r.random() < 0.5 else (head, tail)
        for before, x, after in ((head, value, tail), (blank[0], value, blank[1]), (around[0], new, around[1])):
            out.append(before + x[:VALUE].ljust(VALUE, "\0") + after)
    return out


class Scanner:
    """A network, the line that turns its score into a probability, and the threshold."""

    def __init__(self, network: Network, slope: float, offset: float, threshold: float) -> None:
        self.network, self.slope, self.offset, self.threshold = network, slope, offset, threshold

    def probabilities(self, pieces: list[list[str]]) -> np.ndarray:
        """Of candidates, each given by its windows."""
        flat = self.network.scores([w for ws in pieces for w in ws])
        at = np.cumsum([0, *(len(ws) for ws in pieces)])[:-1]
        z = np.add.reduceat(flat, at) / np.array([len(ws) for ws in pieces]) if pieces else flat
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, line=np.array([self.slope, self.offset, self.threshold]), **self.network.weights)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Scanner:
        with np.load(io.BytesIO(data)) as file:
            return cls(Network({k: file[k] for k in file.files if k != "line"}), *map(float, file["line"]))


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton steps; a little ridge keeps it finite."""
    x, w = np.stack([z, np.ones_like(z)], axis=1).astype(float), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * w)
    return float(w[0]), float(w[1])


def threshold_of(p: np.ndarray, y: np.ndarray, recall: float = RECALL) -> float:
    """Of the thresholds that find ``recall`` of the positives those with the fewest false alarms, and of these the middle."""
    good, bad = np.sort(p[y == 1])[::-1], np.sort(p[y == 0])
    most = float(good[int(np.ceil(recall * len(good))) - 1])
    below = bad[bad < most]
    return (most + float(below[-1])) / 2 if len(below) else most / 2


def descend(net: Network, moments: tuple | None, codes: np.ndarray, y: np.ndarray, r: np.random.Generator) -> tuple:
    """One round over the windows by Adam, both kinds with equal weight in all; the network changes, the moments and the number of steps come back."""
    ones = int(y.sum())
    share = np.where(y == 1, 0.5 / max(ones, 1), 0.5 / max(len(y) - ones, 1)) * len(y)
    zero = {k: np.zeros_like(v) for k, v in net.weights.items()}
    mean, square, step = moments or (zero, dict(zero), 0)
    order = r.permutation(len(y))
    for i in range(0, len(y), BATCH):
        rows = order[i : i + BATCH]
        z, state = net.forward(codes[rows])
        d = (share[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
        step += 1
        for k, g in net.gradients(state, d).items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return mean, square, step


def fit(found: list[str], other: list[str]) -> Scanner | None:
    """From distinct windows of both kinds, in any fixed order."""
    if min(len(found), len(other)) < LEAST:
        return None
    r = np.random.default_rng(_SEED)
    learned = [*varied([w for i, w in enumerate(found) if i % 4], True, r), *varied([w for i, w in enumerate(other) if i % 4], False, r)]
    n = 3 * sum(1 for i in range(len(found)) if i % 4)
    codes, y = encoded(learned), np.zeros(len(learned), np.float32)
    y[:n] = 1
    net, moments = Network(), None
    for _ in range(max(EPOCHS, 200 * BATCH // len(y))):
        moments = descend(net, moments, codes, y, r)
    aside = [*varied(found[::4], True, r), *varied(other[::4], False, r)]
    truth = np.zeros(len(aside))
    truth[: 3 * len(found[::4])] = 1
    z = net.scores(aside)
    slope, offset = calibrated(z, truth)
    p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
    return Scanner(net, slope, offset, threshold_of(p, truth))


def _group_data(table: pa.Table, aside: bool) -> tuple[np.ndarray, np.ndarray, np.random.Generator, int]:
    """Codes and labels of a group's windows, varied, in an order that doesn't depend on how they came."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "h", "w")), strict=True))
    shard = table.column("shard")[0].as_py()
    r = np.random.default_rng([_SEED, shard, int(aside)])
    learned = [varied([w for k, _, w in rows if k == kind], kind == 1, r) for kind in (1, 0)]
    y = np.repeat(np.array([1, 0], np.float32), [len(x) for x in learned])
    return encoded([*learned[0], *learned[1]]), y, r, shard


def _packed(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return {k: file[k] for k in file.files}


def _round(blob: bytes, turn: int):
    """A group's part of a round: from the given weights and moments to its own."""

    def run(table: pa.Table) -> pa.Table:
        codes, y, _, shard = _group_data(table, False)
        at = _unpacked(blob)
        own = Network({k[2:]: v for k, v in at.items() if k.startswith("w_")})
        moments = tuple({k[2:]: v for k, v in at.items() if k.startswith(m)} for m in ("m_", "s_"))
        state, r = (*moments, int(at["step"][0])), np.random.default_rng([_SEED, shard, turn])
        # a small group goes over its windows more often, for as many steps in all as ``fit`` takes at least
        for _ in range(max(1, -(-200 * BATCH // (EPOCHS * len(y))))):
            state = descend(own, state, codes, y, r)
        mean, square, step = state
        out = {**{f"w_{k}": v for k, v in own.weights.items()}, **{f"m_{k}": v for k, v in mean.items()}, **{f"s_{k}": v for k, v in square.items()}, "step": np.array([float(step)])}
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(y)], pa.int64()), "state": pa.array([_packed(**out)], pa.binary())})

    return run


def _fit_in_groups(windows_of: DataFrame, shards: int) -> Scanner:
    """From all windows: each group of them goes on from the same weights for a round, and the groups' weights and moments are averaged after each.

    Scores of those set aside stay in a table; the logistic fit takes sums over it, the threshold its exact order.
    """
    dealt = windows_of.withColumn("shard", F.pmod(F.floor(F.col("h") / 4), F.lit(shards)).cast("int")).withColumn("aside", F.col("h") % 4 == 0)
    learned, aside = dealt.filter("NOT aside"), dealt.filter("aside")
    # by number, so that small groups aren't put together in one task
    learned, aside = learned.repartition(shards, "shard"), aside.repartition(shards, "shard")
    if aside.select("kind").distinct().count() < 2:
        # few of one kind, and none of them set aside: then all are scored
        aside = dealt.repartition(shards, "shard")
    net = Network()
    start = {**{f"w_{k}": v for k, v in net.weights.items()}, **{f"{m}_{k}": np.zeros_like(v) for m in "ms" for k, v in net.weights.items()}, "step": np.zeros(1)}
    for turn in range(EPOCHS):
        one_round = _round(_packed(**start), turn)
        # a row of 60 KB for each of at most SHARDS groups
        parts = sorted(learned.groupBy("shard").applyInArrow(one_round, "shard int, n long, state binary").collect())
        states, n = [_unpacked(bytes(p.state)) for p in parts], np.array([p.n for p in parts], float)
        start = {k: np.average([x[k] for x in states], axis=0, weights=n).astype(v.dtype) for k, v in start.items()}
        start["step"] = np.floor(start["step"])
    net = Network({k[2:]: v for k, v in start.items() if k.startswith("w_")})
    weights = _packed(**net.weights)

    def scored(table: pa.Table) -> pa.Table:
        codes, y, *_ = _group_data(table, True)
        own = Network(_unpacked(weights))
        z = np.concatenate([own.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)])
        return pa.table({"y": pa.array(y.astype(float)), "z": pa.array(z.astype(float))})

    scores = written(aside.groupBy("shard").applyInArrow(scored, "y double, z double"), "secret_scores")
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * float(w[0]) + float(w[1])))))
        row = scores.select("z", (p - F.col("y")).alias("d"), (p * (1 - p) + 1e-6).alias("v")).agg(F.sum(F.col("z") * F.col("d")), F.sum("d"), F.sum(F.col("v") * F.col("z") ** 2), F.sum(F.col("v") * F.col("z")), F.sum("v")).first()
        step = np.linalg.solve(np.array([[row[2], row[3]], [row[3], row[4]]]) + 0.1 * np.eye(2), np.array([row[0], row[1]]) + 0.1 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    slope, offset = (round(float(x), 5) for x in w)
    likely = scores.select("y", (F.col("z") * slope + offset).alias("v"))
    most = likely.filter("y = 1").agg(F.expr(f"percentile_disc({RECALL}) WITHIN GROUP (ORDER BY v DESC)")).first()[0]
    below = likely.filter((F.col("y") == 0) & (F.col("v") < most)).agg(F.max("v")).first()[0]
    chance = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    return Scanner(net, slope, offset, float((chance(most) + chance(below)) / 2 if below is not None else chance(most) / 2))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", fit_windows: int = FIT) -> bytes | None:
    """A scanner as bytes, learned from all distinct windows of all documents; None if there are too few."""
    rows = texts(df, key, text).select("t")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            have: tuple[dict, dict] = ({}, {})
            for t in batch.column(0).to_pylist():
                near, rest = split_candidates(t, base_spans(t))
                for kind, spans in enumerate((rest, near)):
                    for span in spans:
                        for w in windows(t, span):
                            have[kind][int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=7).digest())] = w
            for kind, rows in enumerate(have):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.string())], ["kind", "h", "w"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        scanner = fit(*([w for k, _, w in got if k == kind] for kind in (1, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([scanner.dump() if scanner else None], pa.binary())], ["model"])

    drawn = written(rows.mapInArrow(every, "kind int, h long, w string").distinct(), "secret_windows")
    n = {row.kind: row.n for row in drawn.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < LEAST:
        return None
    if max(n.values()) > fit_windows:
        return _fit_in_groups(drawn, min(SHARDS, -(-max(n.values()) // fit_windows))).dump()
    # all there are are few enough for one task
    found = drawn.repartition(1).mapInArrow(fitted, "model binary").first()
    return bytes(found.model) if found.model is not None else None


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_learned", pa.int64())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"


def listed(spans: dict[str, list[Span]]) -> str:
    """kind:start:end, by start, then kind."""
    every = sorted((s, KINDS.index(k), e) for k, xs in spans.items() for s, e in xs)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in every)


def learned_spans(found: list[tuple[str, list[Span]]], scanner: Scanner | None) -> list[list[Span]]:
    """For each text those of its candidates that the network takes for secrets."""
    if scanner is None:
        return [[] for _ in found]
    p = iter(scanner.probabilities([windows(t, s) for t, spans in found for s in spans]) >= scanner.threshold)
    return [[s for s in spans if next(p)] for _, spans in found]


def secret_scan(df: DataFrame, model: bytes | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: counts and a hash of what the fixed patterns find, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.load(model) if model else None
        for batch in small_batches(batches):
            rows = batch.column(1).to_pylist()
            base = [base_spans(t) for t in rows]
            more = learned_spans([(t, split_candidates(t, b)[1]) for t, b in zip(rows, base, strict=True)], scanner)
            sha = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
            counts = [pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS[:3]]
            spans = [listed(b | {"learned": m}) for b, m in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([len(m) for m in more], pa.int64())], schema=SCHEMA)

    return texts(df, key, text).mapInArrow(scan, DDL).withColumnRenamed("doc_id", key)


def redact_secrets(df: DataFrame, model: bytes | None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows, all columns, with every span of ``text`` replaced; NULL stays NULL."""

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        scanner, out = Scanner.load(model) if model else None, []
        for t in column.to_pylist():
            base = base_spans(t or "")
            spans = sorted([s for xs in base.values() for s in xs] + learned_spans([(t or "", split_candidates(t or "", base)[1])], scanner)[0])
            parts, at = [], 0
            for s, e in spans:
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if spans else t)
        return pa.array(out, pa.string())

    return df.withColumn(text, redacted(F.col(text)))
