"""The detection rules.

``SPECS`` holds fixed values: names, patterns, placeholders and priorities decide
which spans are found, so they are stated as they are.  Order matters, it breaks
ties between spans.
"""

from __future__ import annotations

from dataclasses import dataclass

# Rule name, placeholder, priority (lower wins), pattern.
SPECS: tuple[tuple[str, str, int, str], ...] = (
    ("ipv4", "[IP]", 0, r"(?<![\.\d])(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?![\.\d])"),
    ("ipv4_hex", "[IP]", 2, r"(?<![0-9a-fA-Fx])0x[0-9a-fA-F]{8}(?![0-9a-fA-F])"),
    ("ipv6", "[IP]", 1, r"\[?(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:)\]?"),
    ("ipv6_hyphen", "[IP]", 2, r"(?<![0-9a-fA-F-])[0-9a-fA-F]{4}(?:-[0-9a-fA-F]{4}){7}(?![0-9a-fA-F-])"),
    ("uuid", "[UUID]", 0, r"(?<![a-fA-F\d-])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![a-fA-F\d-])"),
    ("uuid_hex", "[UUID]", 2, r"(?<![a-fA-F\d])[0-9a-fA-F]{32}(?![a-fA-F\d])"),
    ("email", "[EMAIL]", 0, r"(?<![a-zA-Z0-9.%+-])[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}(?![a-zA-Z0-9.%+-])"),
    ("phone_cn", "[PHONE]", 0, r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("phone_cn_sep", "[PHONE]", 3, r"(?<!\d)\(?1[3-9]\d\)?[\s.\-]?\d{4}[\s.\-]?\d{4}(?!\d)"),
    ("phone_intl", "[PHONE]", 0, r"(?<!\d)\+[1-9]\d{0,2}[\s.\-]?(?:\d[\s.\-]?){5,14}\d(?!\d)"),
    ("id_card_cn", "[ID_CARD]", 0, r"(?<![Xx\d])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[Xx\d](?![Xx\d])"),
    ("id_card_cn_sep", "[ID_CARD]", 4, r"(?<![Xx\d])[1-9]\d{5}[\-\s]?(?:19|20)\d{2}[\-\s]?(?:0[1-9]|1[0-2])[\-\s]?(?:0[1-9]|[12]\d|3[01])[\-\s]?\d{3}[\-\s]?[Xx\d](?![Xx\d])"),
    ("ssn_us", "[SSN]", 0, r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    ("api_key_prefix", "[API_KEY]", 0, r"(?:(?i:sk|pk)-(?:[A-Za-z0-9]-?){14,}+|(?i:Bearer)\s+[A-Za-z0-9_\-\.]{10,})"),
    ("aws_access_key", "[AWS_KEY]", 0, r"(?<![A-Za-z0-9])(?i:AKIA)[0-9A-Za-z]{16}(?![A-Za-z0-9])"),
    ("ssh_private_key", "[SSH_KEY]", 0, r"-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|PRIVATE)\s+KEY-----[\s\S]*?-----END\s+(?:RSA|DSA|EC|OPENSSH|PRIVATE)\s+KEY-----"),
    ("ssh_public_key", "[SSH_KEY]", 3, r"(?i)ssh-(?:rsa|ed25519|dss|ecdsa-sha2-nistp(?:256|384|521))\s+AAAA[A-Za-z0-9+/=]{20,}"),
    ("sha_hash", "[HASH]", 6, r"(?<![a-fA-F0-9])[a-fA-F0-9]{64}(?![a-fA-F0-9])"),
    ("github_token", "[GITHUB_TOKEN]", 0, r"(?<![a-zA-Z0-9_])(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{22,}(?![a-zA-Z0-9_])"),
    ("jwt", "[JWT]", 0, r"(?<![a-zA-Z0-9_\-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}(?![a-zA-Z0-9_\-])"),
    ("jwt_multiline", "[JWT]", 5, r"(?<![a-zA-Z0-9_\-])eyJ[A-Za-z0-9_-]{10,}\s*\.\s*\n?\s*[A-Za-z0-9_-]{4,}\s*\.\s*\n?\s*[A-Za-z0-9_-]{4,}(?![a-zA-Z0-9_\-])"),
    ("db_connection_string", "[DB_URL]", 0, r"(?:mysql|postgres|postgresql|mongodb|redis|sqlite|oracle|mssql)(?:\+[a-zA-Z]\w*)?://[^\s]+"),
    ("db_cli", "[DB_CMD]", 5, r"(?:psql|mysql|mongo(?:sh)?|redis-cli|sqlite3|sqlcmd|pg_dump|pg_dumpall)\s+(?:-[a-zA-Z]+\s+\S+\s*)++"),
    ("credential_value", "[CREDENTIAL]", 10, r"(?im)^\s*\w*(?:(?<=[_\\s])|(?<=^))(?i:password|secret|credential|token|api[_\\s]?keys?)(?=[_\\s:=]|[A-Z0-9])\w*\s*[:=]\s*\S{4,}"),
    ("url_query_credential", "[CREDENTIAL]", 4, r"(?i)[?&]\s*(?:user(?:name)?|pass(?:word)?|secret|token|key|auth)\s*=\s*[^&\s]{4,}"),
    ("credential_inline", "[CREDENTIAL]", 5, r"(?i)(?<![a-zA-Z0-9])(?:[a-z_]+_)?(?:password|passwd|pwd|pass(?:word)?|secret|token|credential|auth(?:orization|entication|(?:[_\\s](?:token|key|code|secret)))|(?:(?:encrypt(?:ion)?|sign(?:ing)?|decrypt(?:ion)?|api|master|license|admin)[_\\s]?key))s?\s*[:=]\s*\S{4,}"),
    ("credit_card", "[CARD]", 0, r"(?<![d\-])(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[\-\s]?\d{4}[\-\s]?\d{4}[\-\s]?\d{4}(?![d\-])"),
)

# Addresses, mail domains and host names that are never reported.
IP_WHITELIST = (r"^0\.0\.0\.0$", r"^255\.255\.255\.255$", r"^10\.", r"^172\.(1[6-9]|2[0-9]|3[01])\.", r"^192\.168\.")
DOMAIN_WHITELIST = ("localhost", "localhost.localdomain", "example.com", "example.org", "example.net", "test.com", "test.local")
HOSTNAME_WHITELIST = ("localhost",)
IP_RULES = ("ipv4", "ipv4_hex", "ipv6", "ipv6_hyphen")

# The compatible limits.
MAX_TEXT_BYTES = 100_000
IPV6_MAX_BYTES = 5_000
ENTROPY_CHARS = 1_024

#: A text without any of these strings (lower-cased text for those marked so) cannot
#: match the rule; it is checked before the pattern is tried.
NEEDLES: dict[str, tuple[bool, tuple[str, ...]]] = {
    "ipv4_hex": (False, ("0x",)),
    "ipv6": (False, (":",)),
    "email": (False, ("@",)),
    "phone_intl": (False, ("+",)),
    "api_key_prefix": (True, ("k-", "bearer")),
    "aws_access_key": (True, ("akia",)),
    "ssh_private_key": (False, ("-----BEGIN",)),
    "ssh_public_key": (True, ("h-",)),
    "github_token": (False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    "jwt": (False, ("eyJ",)),
    "jwt_multiline": (False, ("eyJ",)),
    "db_connection_string": (False, ("://",)),
    "db_cli": (False, ("psql", "mysql", "mongo", "redis-cli", "sqlite3", "sqlcmd", "pg_dump")),
    "credential_value": (True, ("password", "secret", "credential", "token", "api")),
    "url_query_credential": (False, ("?", "&")),
    "credential_inline": (True, ("pass", "pwd", "secret", "token", "credential", "auth", "key")),
}
#: A text in which this pattern finds nothing cannot match the rule; rules share gates, and a gate is tried once for each text.
_FOUR_DIGITS, _HEX, _HEX_PARTS = r"\d{4}", r"[0-9a-fA-F]{32}", r"-[0-9a-fA-F]{4}-"
GATES: dict[str, str] = {
    "ipv4": r"\d\.\d{1,3}\.\d",
    "ipv6": r"::|[0-9a-fA-F]:[0-9a-fA-F]",
    "ipv6_hyphen": _HEX_PARTS,
    "uuid": _HEX_PARTS,
    "uuid_hex": _HEX,
    "sha_hash": _HEX,
    "phone_cn": _FOUR_DIGITS,
    "phone_cn_sep": _FOUR_DIGITS,
    "phone_intl": r"\+[1-9]",
    "id_card_cn": _FOUR_DIGITS,
    "id_card_cn_sep": _FOUR_DIGITS,
    "ssn_us": _FOUR_DIGITS,
    "credit_card": _FOUR_DIGITS,
    "credential_value": r"[:=]\s*\S{4}",
    "credential_inline": r"[:=]\s*\S{4}",
}
#: Digits that a match has at least.
LEAST_DIGITS = {"ipv4": 4, "phone_cn": 11, "phone_cn_sep": 11, "phone_intl": 7, "id_card_cn": 17, "id_card_cn_sep": 17, "ssn_us": 9, "credit_card": 16}
#: Gates by the classes of their characters: which class string (d for digits, or h for hexadecimal ones, and the signs beside them) must hold one of the literals.
SHAPES: dict[str, tuple[str, tuple[bytes, ...]]] = {
    _FOUR_DIGITS: ("d", (b"dddd",)),
    GATES["ipv4"]: ("d", (b"d.d",)),
    _HEX: ("h", (b"h" * 32,)),
    _HEX_PARTS: ("h", (b"-hhhh-",)),
    GATES["ipv6"]: ("h", (b"::", b"h:h")),
}
#: Letters outside ASCII that a pattern without regard to case takes for these.
FOLDED = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}


@dataclass(frozen=True)
class Rule:
    """One detection rule; ``priority`` counts for built-in rules only."""

    name: str
    pattern: str
    placeholder: str
    priority: int = 0

    @property
    def java_pattern(self) -> str:
        """The pattern for Spark's own regex functions: Unicode classes, ``^`` after LF only."""
        return "(?Ud)" + self.pattern


BUILTIN_RULES: tuple[Rule, ...] = tuple(Rule(name, pattern, mark, priority) for name, mark, priority, pattern in SPECS)
BY_NAME: dict[str, Rule] = {rule.name: rule for rule in BUILTIN_RULES}
