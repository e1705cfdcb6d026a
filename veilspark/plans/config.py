"""Configuration: dataclasses, the YAML source and the safety check for user patterns."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from veilspark.functions.rules import BUILTIN_RULES, ENTROPY_CHARS, IPV6_MAX_BYTES, MAX_TEXT_BYTES, Rule
from veilspark.plans.ambiguity import ambiguous

# Fixed value: it decides which rules are accepted. A quantified group that holds a quantifier itself, as in ``(a+)+``.
NESTED_QUANTIFIER = re.compile(r"\([^()]*(?:[+*]|\{\d+,?\d*\})[^()]*\)[+*]")


def validate_rule(name: str, pattern: str, compatible: bool = False) -> None:
    """Raise ValueError for a pattern that may run away, does not compile or can match nothing.

    ``compatible`` looks for nested quantifiers in the pattern's text only; otherwise its automaton is searched for ambiguous loops too.
    """
    if NESTED_QUANTIFIER.search(pattern):
        raise ValueError(f"rule {name!r}: nested quantifiers may backtrack without end")
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise ValueError(f"rule {name!r}: invalid pattern: {error}") from error
    if compiled.match(""):
        raise ValueError(f"rule {name!r}: the pattern matches the empty string")
    if not compatible and (why := ambiguous(pattern)):
        raise ValueError(f"rule {name!r}: {why}, which may backtrack without end")


@dataclass(frozen=True)
class CustomRule:
    """A user's rule. ``priority`` is kept for completeness; overlaps treat every custom rule as 0."""

    name: str
    pattern: str
    placeholder: str = "[REDACTED]"
    priority: int = 50


@dataclass(frozen=True)
class Preprocess:
    strip_zw_chars: bool = True
    url_decode: bool = True
    html_unescape: bool = True


@dataclass(frozen=True)
class Entropy:
    """``mode`` 'auto' redacts what it finds, 'review' only reports it in scans."""

    enabled: bool = True
    threshold: float = 5.0
    min_length: int = 12
    mode: str = "auto"

    def __post_init__(self) -> None:
        if self.min_length < 1 or self.threshold <= 0:
            raise ValueError("entropy: min_length must be at least 1 and threshold above 0")
        if self.mode not in ("auto", "review"):
            raise ValueError(f"entropy: unknown mode {self.mode!r}")

    @property
    def inert(self) -> bool:
        """A window of min_length characters can't reach the threshold."""
        return math.log2(self.min_length) < self.threshold


@dataclass(frozen=True)
class Limits:
    """How much of a text is searched; None: all of it.

    ``max_text_bytes`` cuts a text, tail and all; results say so in ``truncated``. The IPv6 rules
    are left out of texts over ``ipv6_max_bytes``, and stretches of high entropy are sought in the first ``entropy_chars`` only.
    """

    max_text_bytes: int | None = MAX_TEXT_BYTES
    ipv6_max_bytes: int | None = IPV6_MAX_BYTES
    entropy_chars: int | None = ENTROPY_CHARS


#: Short inputs, as for a text typed by hand; and whole texts, which is what tables, messages and streams are searched by.
COMPATIBLE, WHOLE = Limits(), Limits(None, None, None)


@dataclass(frozen=True)
class Whitelist:
    """``strings`` are compared with lower-cased values as they are; write them in lower case."""

    ips: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()


@dataclass(frozen=True)
class DetectionConfig:
    """The short form: entropy settings only."""

    entropy_threshold: float = 5.0
    entropy_min_length: int = 12
    enable_entropy: bool = True
    entropy_mode: str = "auto"


@dataclass(frozen=True)
class Config:
    """Everything a detector needs. Rules that ``rules`` does not name are enabled."""

    preprocess: Preprocess = Preprocess()
    entropy: Entropy = Entropy()
    rules: Mapping[str, bool] = field(default_factory=lambda: {rule.name: True for rule in BUILTIN_RULES})
    custom_rules: tuple[CustomRule, ...] = ()
    placeholders: Mapping[str, str] = field(default_factory=dict)
    whitelist: Whitelist = Whitelist()
    limits: Limits = COMPATIBLE

    def whole(self) -> Config:
        """The same without limits."""
        return replace(self, limits=WHOLE)

    def is_rule_enabled(self, name: str) -> bool:
        return self.rules.get(name, True)

    def get_placeholder(self, name: str, default: str) -> str:
        return self.placeholders.get(name, default)

    def to_detection_config(self) -> DetectionConfig:
        e = self.entropy
        return DetectionConfig(e.threshold, e.min_length, e.enabled, e.mode)

    @classmethod
    def from_detection_config(cls, short: DetectionConfig | None) -> Config:
        if short is None:
            return cls()
        return cls(entropy=Entropy(short.enable_entropy, short.entropy_threshold, short.entropy_min_length, short.entropy_mode))

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any] | None) -> Config:
        """From parsed YAML. Missing keys take defaults; a given ``rules`` map replaces the default one."""
        raw = dict(raw or {})
        known = {"preprocess", "entropy", "rules", "custom_rules", "placeholders", "whitelist", "limits"}
        parts: dict[str, Any] = {key: raw[key] for key in ("rules", "placeholders") if raw.get(key) is not None}
        for key, kind in (("preprocess", Preprocess), ("entropy", Entropy), ("limits", Limits)):
            if raw.get(key):
                parts[key] = kind(**{k: v for k, v in raw[key].items() if k in kind.__dataclass_fields__})
        if raw.get("whitelist"):
            parts["whitelist"] = Whitelist(**{k: tuple(v or ()) for k, v in raw["whitelist"].items() if k in Whitelist.__dataclass_fields__})
        customs = tuple(CustomRule(**rule) for rule in raw.get("custom_rules") or ())
        for rule in customs:
            validate_rule(rule.name, rule.pattern)
        if unknown := set(raw) - known:
            warnings.warn(f"configuration keys without effect: {sorted(unknown)}", stacklevel=2)
        return cls(custom_rules=tuple(rule for rule in customs if rule.name and rule.pattern), **parts)

    @classmethod
    def load_from_path(cls, path: str) -> Config:
        """Read a YAML file on the driver; ValueError says whether reading or parsing failed."""
        import yaml

        try:
            with open(path, encoding="utf-8") as file:
                content = file.read()
        except OSError as error:
            raise ValueError(f"failed to read config: {error}") from error
        try:
            return cls.from_mapping(yaml.safe_load(content))
        except (yaml.YAMLError, TypeError, AttributeError) as error:
            raise ValueError(f"failed to parse config: {error}") from error

    def with_custom(self, rule: CustomRule) -> Config:
        validate_rule(rule.name, rule.pattern)
        return replace(self, custom_rules=(*self.custom_rules, rule))


def active_rules(config: Config, only: frozenset[str] | None = None, placeholder: str | None = None) -> list[Rule]:
    """The rules a plan runs, in order: built-in ones, then custom ones. ``placeholder`` replaces those of built-in rules."""
    rules = [
        Rule(rule.name, rule.pattern, placeholder or config.get_placeholder(rule.name, rule.placeholder), rule.priority)
        for rule in BUILTIN_RULES
        if config.is_rule_enabled(rule.name) and (only is None or rule.name in only)
    ]
    return rules + [Rule(c.name, c.pattern, c.placeholder, 0) for c in config.custom_rules if only is None or c.name in only]
