"""Shannon entropy and the search for high-entropy stretches."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rules import ENTROPY_CHARS

# Fixed values.
MAX_CJK_SHARE, MAX_SPACE_SHARE = 0.3, 0.25
_DATA_URI = re.compile(r"(?i)data:[^;]+;base64,")
_CJK = re.compile(r"[一-鿿぀-ゟ゠-ヿ가-힯]")


def shannon_entropy(text: Column) -> Column:
    """Bits per character over code points; 0 for the empty string, NULL for NULL."""

    def of(chars: Column) -> Column:
        # equal characters stand together: where each run ends gives its length
        ends = F.filter(F.transform(chars, lambda c, i: F.when(F.get(chars, i + 1).eqNullSafe(c), -1).otherwise(i + 1)), lambda i: i > 0)
        total = F.size(chars).cast("double")
        return F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("bits")), lambda acc, end: F.struct(end.alias("at"), (acc["bits"] - (end - acc["at"]) / total * F.log2((end - acc["at"]) / total)).alias("bits")))["bits"]

    return F.when(text == "", 0.0).otherwise(F.transform(F.array(F.array_sort(F.split(text, ""))), of)[0])


def entropy_of(counts: dict[str, int], total: int) -> float:
    return -math.fsum(n / total * math.log2(n / total) for n in counts.values())


def plausible(value: str) -> bool:
    """Whether a stretch may be a secret: not one repeated character, no line break or tab, no data URI, little CJK, few spaces."""
    if not value or value == value[0] * len(value) or any(c in value for c in "\n\r\t"):
        return False
    if _DATA_URI.search(value):
        return False
    if len(_CJK.findall(value)) > MAX_CJK_SHARE * len(value):
        return False
    return value.count(" ") + value.count("　") <= MAX_SPACE_SHARE * len(value)


def high_entropy(text: str, threshold: float, min_length: int, sample_chars: int | None = ENTROPY_CHARS) -> list[tuple[int, int, float]]:
    """(start, end, entropy) of stretches within the first ``sample_chars`` characters, or all of them.

    A window of ``min_length`` at or over the threshold grows while it stays there; the
    search goes on behind it whether it is plausible or not. Stretches never overlap.
    """
    if math.log2(min_length) < threshold or len(text) < min_length:
        return []
    sample, found, pos, missed, codes = text[:sample_chars], [], 0, 0, None
    while pos + min_length <= len(sample):
        counts: dict[str, int] = {}
        for c in sample[pos : pos + min_length]:
            counts[c] = counts.get(c, 0) + 1
        if entropy_of(counts, min_length) < threshold:
            pos, missed = pos + max(1, min_length // 3), missed + 1
            if missed > _FEW and min_length <= _COUNTED:
                codes = _codes(sample) if codes is None else codes
                pos, missed = _next_window(codes, pos, min_length, threshold), 0
            continue
        # entropy is log n less the sum of c log c over n; one more character changes one term of the sum
        end, missed, total, low = pos + min_length, 0, math.fsum(_weight(n) for n in counts.values()), False
        while end < len(sample) and end - pos < min_length + _SHORT:
            c = sample[end]
            n = counts.get(c, 0) + 1
            counts[c] = n
            total += _weight(n) - _weight(n - 1)
            size = end + 1 - pos
            bits = math.log2(size) - total / size
            # rounding never decides: near the threshold all counts are summed
            low = bits < threshold - _NEAR or bits < threshold + _NEAR and entropy_of(counts, size) < threshold
            if low:
                break
            end += 1
        if not low and end < len(sample):
            codes = _codes(sample) if codes is None else codes
            end = _grown(codes, pos, end, threshold)
        value = sample[pos:end]
        if plausible(value):
            found.append((pos, end, entropy_of(Counter(value), end - pos)))
        pos = end
    return found


#: Windows in a row, and characters of a stretch, that are looked at one by one before whole blocks of them are.
_FEW, _SHORT = 4, 32
_BLOCK = 4_096
#: Windows up to this length are told by their equal pairs; longer ones have too many forms.
_COUNTED = 24


def _codes(text: str) -> np.ndarray:
    """Numbers from 0 for the characters, equal for equal ones."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    top = int(points.max())
    if top > 0xFFFF:
        return np.unique(points, return_inverse=True)[1].astype(np.int32)
    present = np.zeros(top + 1, bool)
    present[points] = True
    return (np.cumsum(present) - 1).astype(np.uint16)[points]


@lru_cache(maxsize=64)
def _pair_bounds(size: int, threshold: float) -> tuple[int, int]:
    """With at most so many equal pairs a window surely reaches the threshold; with more than so many it never does."""
    low, high = {}, {}

    def parts(left: int, most: int, pairs: int, weight: float) -> None:
        if not left:
            bits = math.log2(size) - weight / size
            low[pairs], high[pairs] = min(bits, low.get(pairs, bits)), max(bits, high.get(pairs, bits))
        for n in range(1, min(left, most) + 1):
            parts(left - n, n, pairs + n * (n - 1) // 2, weight + n * math.log2(n))

    parts(size, size, 0, 0.0)
    bad = [p for p, bits in low.items() if bits < threshold + _NEAR]
    return min(bad, default=size * size) - 1, max((p for p, bits in high.items() if bits >= threshold - _NEAR), default=-1)


def _next_window(codes: np.ndarray, pos: int, size: int, threshold: float) -> int:
    """The first good window from ``pos`` on by steps, or the end: equal pairs of a block of windows are counted at once, and decide most of them."""
    step, (surely, never), block = max(1, size // 3), _pair_bounds(size, threshold), 256
    while pos + size <= len(codes):
        part = codes[pos : pos + block * step + size - 1]
        n = len(part) - size + 1
        pairs = np.zeros(n, np.int32)
        for d in range(1, size):
            ends = np.concatenate([[0], np.cumsum(part[:-d] == part[d:], dtype=np.int32)])
            pairs += ends[size - d : size - d + n] - ends[:n]
        for i in np.flatnonzero(pairs[::step] <= never).tolist():
            at = i * step
            if pairs[at] <= surely or entropy_of(Counter(part[at : at + size].tolist()), size) >= threshold:
                return pos + at
        pos, block = pos + -(-n // step) * step, min(4 * block, _BLOCK)
    return len(codes)


def _grown(codes: np.ndarray, pos: int, end: int, threshold: float) -> int:
    """The end of the stretch that has reached from ``pos`` to ``end``: running sums of a block of characters at once."""
    seen = np.bincount(codes[pos:end])
    seen = np.concatenate([seen, np.zeros(int(codes.max()) + 1 - len(seen), seen.dtype)])
    total, block = math.fsum(_weight(n) for n in seen.tolist() if n > 1), 128
    while end < len(codes):
        part = codes[end : end + block]
        # how often each character has occurred up to its place
        order = np.argsort(part, kind="stable")
        alike = part[order]
        first = np.flatnonzero(np.concatenate([[True], alike[1:] != alike[:-1]]))
        n = np.empty(len(part), np.int64)
        n[order] = np.arange(1, len(part) + 1) - np.repeat(first, np.diff(np.append(first, len(part)))) + seen[alike]
        sums = total + np.cumsum(n * np.log2(n) - (n - 1) * np.log2(np.maximum(n - 1, 1)))
        sizes = np.arange(end - pos + 1, end - pos + len(part) + 1)
        bits = np.log2(sizes) - sums / sizes
        for i in np.flatnonzero(bits < threshold + _NEAR).tolist():
            # rounding never decides here either
            if bits[i] < threshold - _NEAR or entropy_of({c: k for c, k in enumerate((seen + np.bincount(part[: i + 1], minlength=len(seen))).tolist()) if k}, int(sizes[i])) < threshold:
                return end + i
        seen, total = seen + np.bincount(part, minlength=len(seen)), float(sums[-1])
        end, block = end + len(part), min(4 * block, _BLOCK)
    return end


#: By how much a running sum may be off.
_NEAR = 1e-7
_WEIGHTS = [0.0, 0.0]


def _weight(n: int) -> float:
    """n log n, kept for small n."""
    while len(_WEIGHTS) <= min(n, 100_000):
        _WEIGHTS.append(len(_WEIGHTS) * math.log2(len(_WEIGHTS)))
    return _WEIGHTS[n] if n < len(_WEIGHTS) else n * math.log2(n)
