"""The fused per-text kernel that Arrow UDFs run: normalise, match, whitelist, resolve, replace."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

from veilspark.functions import rules as R
from veilspark.functions.entropy import high_entropy
from veilspark.functions.normalize import cap_text, normalize_plain
from veilspark.plans.config import Config, active_rules


@dataclass(slots=True)
class Match:
    rule_name: str
    placeholder: str
    start: int
    end: int
    value: str
    entropy: float = 0.0
    confidence: str = "high"

    def row(self) -> dict:
        return {name: getattr(self, name) for name in self.__slots__}


def luhn(value: str) -> bool:
    digits = [ord(c) - 48 for c in value if "0" <= c <= "9"][::-1]
    if not 13 <= len(digits) <= 19:
        return False
    return (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def resolve(matches: list[Match]) -> list[Match]:
    """As ``spans.resolve_overlaps``."""
    priority = lambda m: R.BY_NAME[m.rule_name].priority if m.rule_name in R.BY_NAME else 0
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.start, priority(m), -m.end)):
        last = kept[-1] if kept else None
        if last is None or m.start >= last.end:
            kept.append(m)
        elif m.start <= last.start and m.end >= last.end:
            kept[-1] = m
        elif last.start <= m.start and last.end >= m.end:
            continue
        elif priority(m) < priority(last) or (priority(m) == priority(last) and m.end - m.start > last.end - last.start):
            kept[-1] = m
    return kept


def splice(text: str, matches: list[Match]) -> tuple[str, int]:
    out, at, count = [], 0, 0
    for m in matches:
        if m.confidence == "high":
            out += [text[at : m.start], m.placeholder]
            at, count = m.end, count + 1
    return "".join([*out, text[at:]]), count


def _classes(members: str, letter: str) -> bytes:
    """A table that maps bytes of the members to the letter, the signs . : - to themselves and all others to a space."""
    return bytes(ord(letter) if chr(b) in members else b if chr(b) in ".:-" else 32 for b in range(256))


_DIGITS, _HEX = _classes("0123456789", "d"), _classes("0123456789abcdefABCDEF", "h")
#: Bytes with which no character from U+0660 on begins; the first digits beyond ASCII are there.
_BELOW = bytes(range(0xD9))


class Profile:
    """What one pass over a text's bytes says of all rules at once: its characters by class, and how many digits there are."""

    def __init__(self, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        # other digits than ASCII ones may be there: then nothing is said of digits
        self.any_digits = not text.isascii() and bool(data.translate(None, _BELOW))
        self.strings = {"d": data.translate(_DIGITS), "h": data.translate(_HEX)}
        self.n_digits = self.strings["d"].count(b"d")

    def may_pass(self, gate: str) -> bool:
        if gate not in R.SHAPES:
            return True
        kind, literals = R.SHAPES[gate]
        return kind == "d" and self.any_digits or any(x in self.strings[kind] for x in literals)

    def may_match(self, rule: str) -> bool:
        return self.any_digits or self.n_digits >= R.LEAST_DIGITS.get(rule, 0)


class Needles:
    """All needles of all rules as one Aho-Corasick automaton: a pass over the lower-cased text names the rules that may match.

    Needles of one character are left to plain searches, which are faster for what is common. A case-sensitive needle is sought in lower case too, which
    only lets more texts through. Without the automaton's library each needle is sought by itself.
    """

    def __init__(self, names: Iterable[str]) -> None:
        self.single: dict[str, tuple[str, ...]] = {}
        by_word: dict[str, set[str]] = {}
        for name in names:
            words = tuple(x.lower() for x in R.NEEDLES[name][1])
            if all(len(x) == 1 for x in words):
                self.single[name] = words
            else:
                for x in words:
                    by_word.setdefault(x, set()).add(name)
        self.by_word = {x: tuple(sorted(rules)) for x, rules in by_word.items()}
        self.find = self._each
        if ahocorasick is not None and self.by_word:
            machine = ahocorasick.Automaton()
            for x in self.by_word:
                machine.add_word(x, x)
            machine.make_automaton()
            self.find = lambda lowered: {x for _, x in machine.iter(lowered)}

    def _each(self, lowered: str) -> set[str]:
        return {x for x in self.by_word if x in lowered}

    def rules(self, lowered: str) -> set[str]:
        """The rules a needle of which the text holds."""
        found = {name for x in self.find(lowered) for name in self.by_word[x]}
        found.update(name for name, words in self.single.items() if any(x in lowered for x in words))
        return found


class Kernel:
    """Compiled once for each Python worker; patterns are those of the plan."""

    def __init__(self, config: Config, only: frozenset[str] | None, placeholder: str | None, entropy: bool) -> None:
        self.config, self.entropy = config, entropy
        own = {rule.name for rule in config.custom_rules}
        self.rules = [(rule, re.compile(rule.pattern), *((None, None) if rule.name in own else (R.NEEDLES.get(rule.name), R.GATES.get(rule.name)))) for rule in active_rules(config, only, placeholder)]
        self.needles = Needles(rule.name for rule, _, needle, _ in self.rules if needle)
        self.gates = {gate: re.compile(gate).search for *_, gate in self.rules if gate}
        white = config.whitelist
        self.strings, self.ips, self.domains = set(white.strings), {x.lower() for x in white.ips}, {x.lower() for x in white.domains} | set(R.DOMAIN_WHITELIST)
        self.private = re.compile("|".join(R.IP_WHITELIST))

    def normalize(self, text: str) -> str:
        return self.prepared(text)[0]

    def prepared(self, text: str) -> tuple[str, bool]:
        """The normalised text, and whether a limit has cut it."""
        p, limit = self.config.preprocess, self.config.limits.max_text_bytes
        head = text if limit is None else cap_text(text, limit)
        return normalize_plain(head, p.url_decode, p.html_unescape, p.strip_zw_chars), len(head) < len(text)

    def whitelisted(self, rule_name: str, value: str) -> bool:
        low = value.lower()
        if low in self.strings:
            return True
        if rule_name in R.IP_RULES:
            return bool(self.private.search(low)) or low in self.ips
        if rule_name == "email":
            return low.rpartition("@")[2] in self.domains
        return low in R.HOSTNAME_WHITELIST

    def matches(self, text: str) -> list[Match]:
        """Resolved matches of a normalised text."""
        found: list[Match] = []
        lowered = text.lower()
        for letter, plain in () if text.isascii() else R.FOLDED.items():
            if letter in text:
                lowered = lowered.replace(letter.lower(), plain)
        most = self.config.limits.ipv6_max_bytes
        long = most is not None and len(text) * 4 > most and len(text.encode("utf-8", "surrogatepass")) > most
        passed: dict[str, bool] = {}
        profile, present = Profile(text), self.needles.rules(lowered)
        for rule, pattern, needle, gate in self.rules:
            if long and rule.name in ("ipv6", "ipv6_hyphen"):
                continue
            if needle and rule.name not in present:
                continue
            if gate:
                if not profile.may_match(rule.name):
                    continue
                if gate not in passed:
                    passed[gate] = profile.may_pass(gate) and self.gates[gate](text) is not None
                if not passed[gate]:
                    continue
            for hit in pattern.finditer(text):
                if hit.end() > hit.start() and not self.whitelisted(rule.name, hit[0]):
                    low = rule.name == "credit_card" and not luhn(hit[0])
                    found.append(Match(rule.name, rule.placeholder, *hit.span(), hit[0], 0.0, "low" if low else "high"))
        if self.entropy:
            e = self.config.entropy
            found += [
                Match("high_entropy", "[SECRET]", start, end, text[start:end], bits)
                for start, end, bits in high_entropy(text, e.threshold, e.min_length, self.config.limits.entropy_chars)
                if not any(start < m.end and end > m.start for m in tuple(found))
            ]
        return resolve(found)

    def scan(self, text: str | None) -> list[dict] | None:
        if text is None:
            return None
        return [m.row() for m in self.matches(self.normalize(text))] if text else []

    def filter(self, text: str | None) -> dict:
        if not text:
            return {"text": text, "matches": None if text is None else [], "replacements": 0, "truncated": False}
        plain, cut = self.prepared(text)
        found = self.matches(plain)
        out, count = splice(plain, found)
        return {"text": out, "matches": [m.row() for m in found], "replacements": count, "truncated": cut}


class LazyKernel:
    """A kernel's arguments; the kernel itself is built in the process that first calls it."""

    def __init__(self, config: Config, only: frozenset[str] | None = None, placeholder: str | None = None, entropy: bool = False) -> None:
        self.args, self.kernel = (config, only, placeholder, entropy), None

    def __getstate__(self) -> dict:
        return {"args": self.args, "kernel": None}

    def __call__(self) -> Kernel:
        if self.kernel is None:
            self.kernel = Kernel(*self.args)
        return self.kernel
