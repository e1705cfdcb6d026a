"""DuckDB SQL that says what the redaction engine does: normalisation, rules with offsets, whitelist, overlaps, replacement.

DuckDB's patterns have no look-around and it has no NFKC, so guards are consumed as
characters (where a guard must serve two matches, characters outside the guard's class are
doubled first), and texts are taken to be composed already.
"""

from __future__ import annotations

from veilspark.functions.normalize import INVISIBLE
from veilspark.functions.rules import BUILTIN_RULES

_PERCENT = r"""CASE WHEN contains({t}, '%') THEN array_to_string(list_transform(regexp_extract_all({t}, '(?s)%.{{0,2}}|[^%]+'),
    lambda x: CASE WHEN regexp_full_match(x, '%([0-9A-Fa-f]{{2}}|\+[0-9A-Fa-f])') THEN chr(CAST('0x' || replace(substr(x, 2), '+', '') AS INT)) ELSE x END), '') ELSE {t} END"""
_NUMBER = r"""CASE WHEN {n} < 55296 OR {n} BETWEEN 57344 AND 1114111 THEN chr(CAST({n} AS INT)) ELSE '&' || {b} || ';' END"""
_BODY = "regexp_replace(substr(x, 2), ';$', '')"


def _entity() -> str:
    digits = rf"regexp_replace({_BODY}, '^#[xX]?\+?0*(.)', '\1')"
    hexa, deci = f"CAST('0x' || {digits} AS BIGINT)", f"CAST({digits} AS BIGINT)"
    return rf"""CASE WHEN x[1] <> '&' THEN x
    WHEN {_BODY} = 'amp' THEN '&' WHEN {_BODY} = 'lt' THEN '<' WHEN {_BODY} = 'gt' THEN '>' WHEN {_BODY} = 'quot' THEN '"' WHEN {_BODY} = 'apos' THEN '''' WHEN {_BODY} = 'nbsp' THEN ' '
    WHEN regexp_full_match({_BODY}, '#[xX]\+?[0-9a-fA-F]+') THEN CASE WHEN length({digits}) > 6 THEN '&' || {_BODY} || ';' ELSE {_NUMBER.format(n=hexa, b=_BODY)} END
    WHEN regexp_full_match({_BODY}, '#\+?[0-9]+') THEN CASE WHEN length({digits}) > 7 THEN '&' || {_BODY} || ';' ELSE {_NUMBER.format(n=deci, b=_BODY)} END
    ELSE '&' || {_BODY} || ';' END"""


def unescaped(t: str) -> str:
    return f"CASE WHEN contains({t}, '&') THEN array_to_string(list_transform(regexp_extract_all({t}, '(?s)&[^;]*;?|[^&]+'), lambda x: {_entity()}), '') ELSE {t} END"


def normalised(source: str) -> str:
    """CTEs up to ``n(id, text)`` from a query for (id, text)."""
    steps = [f"n0 AS ({source})"]
    steps += [f"n{i} AS (SELECT id, {_PERCENT.format(t='text')} AS text FROM n{i - 1})" for i in (1, 2, 3)]
    return ",\n".join([*steps, f"n4 AS (SELECT id, {unescaped('text')} AS text FROM n3)", f"n AS MATERIALIZED (SELECT id, regexp_replace(text, '{INVISIBLE}', '', 'g') AS text FROM n4)"])


def _before(gaps: str, hits: str) -> str:
    """What stands before match i: gaps up to it and matches before it."""
    return f"array_to_string({gaps}[1:i], '') || array_to_string({hits}[1:i - 1], '')"


def _pieces(pattern: str, text: str = "text") -> str:
    p = pattern.replace("'", "''")
    return f"""(SELECT id, hits, regexp_extract_all({text}, '{p}', GROUP_) AS bodies, gaps, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT id, {text}, regexp_extract_all({text}, '{p}') AS hits, string_split_regex({text}, '{p}') AS gaps FROM SOURCE_ WHERE regexp_matches({text}, '{p}')))"""


def plain(pattern: str, group: int = 0) -> str:
    """start, value of a pattern without guards; with a group, of that group at the end of the match."""
    rows = _pieces(pattern).replace("GROUP_", str(group)).replace("SOURCE_", "n")
    return f"SELECT id, length({_before('gaps', 'hits')}) + length(hits[i]) - length(bodies[i]) AS start, bodies[i] AS value FROM {rows} WHERE bodies[i] <> ''"


def runs(alphabet: str, full: str, part: str = "value", cut: str = "") -> str:
    """A rule whose guards are its own alphabet: whole runs of the alphabet, if long enough, that match in full."""
    rows = _pieces(alphabet).replace("GROUP_", "0").replace("SOURCE_", "n")
    return f"SELECT id, start, {part} AS value FROM (SELECT id, length({_before('gaps', 'hits')}) AS start, bodies[i] AS value FROM {rows}) WHERE regexp_full_match(value, '{full}') {cut}"


def guarded(guard: str, body: str, sides: str | None = None) -> str:
    """Guarded by a class: characters outside it are doubled, so that one guard character can be consumed on each side; ``sides`` names another class for the guards themselves."""
    lead, trail = f"(?:^|[^{sides or guard}])", f"(?:$|[^{sides or guard}])"
    rows = _pieces(f"(?s){lead}({body}){trail}", "t2").replace("GROUP_", "1").replace("SOURCE_", f"(SELECT id, text, regexp_replace(text, '(?s)([^{guard}])', '\\1\\1', 'g') AS t2 FROM n)")
    size = lambda x: f"(length(regexp_replace({x}, '(?s)[^{guard}]', '', 'g')) + length(regexp_replace({x}, '(?s)[{guard}]', '', 'g')) // 2)"
    return rf"""SELECT id, {size('before')} AS start, regexp_replace(body, '(?s)([^{guard}]).', '\1', 'g') AS value
        FROM (SELECT id, before || CASE WHEN before = '' AND starts_with(hit, body) THEN '' ELSE hit[1] END AS before, body FROM (SELECT id, {_before('gaps', 'hits')} AS before, hits[i] AS hit, bodies[i] AS body FROM {rows}))"""


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_SEP, _DASH = r"(?:\s\s|\.\.|--)?", r"(?:--|\s\s)?"
_CARD = r"(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))(?:-|\s\s)?\d{4}(?:-|\s\s)?\d{4}(?:-|\s\s)?\d{4}"
# what credential_inline calls a credential: plain words, authorisations, and keys of something
_PLAIN_WORDS, _AUTH = "password|passwd|pwd|pass|secret|token|credential", r"auth(?:orization|entication|[_s\\](?:token|key|code|secret))"
_KEYS = r"(?:(?:en|de)crypt(?:ion)?|sign(?:ing)?|api|master|license|admin)[_s\\]?key"
_GROUP16 = "[0-9A-Fa-f]{1,4}"
_KEY_KIND = "(?:PRIVATE|OPENSSH|EC|DSA|RSA)"

SPANS: dict[str, str] = {
    "ipv4": runs("[.0-9]{7,}", rf"({_OCTET}\.){{3}}{_OCTET}"),
    "ipv4_hex": runs("[0-9a-fA-Fx]{10,}", "0x[0-9a-fA-F]{8}(x.*)?", "value[1:10]"),
    "ipv6_hyphen": runs("[0-9a-fA-F-]{39,}", "[0-9a-fA-F]{4}(-[0-9a-fA-F]{4}){7}"),
    "uuid": runs("[0-9a-fA-F-]{36,}", "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    "uuid_hex": runs("[0-9a-fA-F]{32,}", "[0-9a-fA-F]{32}"),
    "email": runs("[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9_.-]+", r"[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9_.-]+\.[A-Za-z]{2,}"),
    "phone_cn": runs("[0-9]{11,}", "1[3-9][0-9]{9}"),
    "phone_cn_sep": guarded("0-9", rf"(?:\(\()?1[3-9]\d(?:\)\))?{_SEP}\d{{4}}{_SEP}\d{{4}}"),
    "phone_intl": guarded("0-9", rf"\+\+[1-9]\d{{0,2}}{_SEP}(?:\d{_SEP}){{5,14}}\d"),
    "id_card_cn": guarded("0-9Xx", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[Xx\d]"),
    "id_card_cn_sep": guarded("0-9Xx", rf"[1-9]\d{{5}}{_DASH}(?:19|20)\d{{2}}{_DASH}(?:0[1-9]|1[0-2]){_DASH}(?:0[1-9]|[12]\d|3[01]){_DASH}\d{{3}}{_DASH}[Xx\d]"),
    "ssn_us": guarded("0-9", r"\d{3}--\d{2}--\d{4}"),
    "aws_access_key": runs("[0-9A-Za-z]{20,}", "[Aa][Kk][Ii][Aa][0-9A-Za-z]{16}"),
    "sha_hash": runs("[0-9a-fA-F]{64,}", "[0-9a-fA-F]{64}"),
    "github_token": runs("[0-9A-Za-z_]{26,}", "(ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{22,}"),
    "jwt": guarded("A-Za-z0-9_-", r"eyJ[A-Za-z0-9_-]{10,}\.\.[A-Za-z0-9_-]{10,}\.\.[A-Za-z0-9_-]{10,}"),
    "jwt_multiline": guarded("A-Za-z0-9_-", r"eyJ[A-Za-z0-9_-]{10,}\s*\.\.\s*[A-Za-z0-9_-]{4,}\s*\.\.\s*[A-Za-z0-9_-]{4,}"),
    # the look-behind allows a line start, an underscore or a letter s before the keyword; the look-ahead a word character or the assignment itself
    "credential_value": plain(r"(?im)^(?:\s*\w*[_s]|(?:\s*\n)?)(?:password|secret|credential|token|api[_\\s]?keys?)(?:[_a-z0-9]\w*\s*)?[:=]\s*\S{4,}"),
    "credential_inline": plain(rf"(?i)(?:^|[^a-z0-9])((?:[a-z_]+_)?(?:{_PLAIN_WORDS}|{_AUTH}|{_KEYS})s?\s*[=:]\s*\S{{4,}})", 1),
    # the guards are the letter d and the hyphen
    "credit_card": guarded("0-9-", _CARD, "d-"),
}
SPANS |= {
    "ipv6": plain(rf"\[?(?:(?:{_GROUP16}:){{7}}{_GROUP16}|::(?:{_GROUP16}:){{0,5}}{_GROUP16}|(?:{_GROUP16}:){{1,6}}:{_GROUP16}|(?:{_GROUP16}:){{1,7}}:)\]?"),
    # a sign and at most one hyphen behind it, so often; the last hyphen belongs to it too
    "api_key_prefix": plain(r"[sSſpP][kKK]-[A-Za-z0-9](?:-?[A-Za-z0-9]){13,}-?|[bB][eE][aA][rR][eE][rR]\s+[\w.-]{10,}"),
    "ssh_private_key": plain(rf"(?s)-{{5}}BEGIN\s+{_KEY_KIND}\s+KEY-{{5}}.*?-{{5}}END\s+{_KEY_KIND}\s+KEY-{{5}}"),
    "ssh_public_key": plain(r"(?i)ssh-(?:dss|rsa|ed25519|ecdsa-sha2-nistp(?:521|384|256))\s+a{4}[a-z0-9/=+]{20,}"),
    "db_connection_string": plain(r"(?:sqlite|redis|oracle|mongodb|postgres(?:ql)?|mysql|mssql)(?:[+][A-Za-z]\w*)?:/{2}\S+"),
    "db_cli": plain(r"(?:pg_dump(?:all)?|sqlcmd|sqlite3|redis-cli|mongo(?:sh)?|mysql|psql)\s+(?:-[A-Za-z]+\s+\S+\s*)+"),
    "url_query_credential": plain(r"(?i)[&?]\s*(?:auth|key|token|secret|pass(?:word)?|user(?:name)?)\s*=\s*[^\s&]{4,}"),
}

LUHN = """
    list_sum(list_transform(range(1, length(d) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(d[length(d) + 1 - i] AS INT)
             WHEN CAST(d[length(d) + 1 - i] AS INT) > 4 THEN 2 * CAST(d[length(d) + 1 - i] AS INT) - 9
             ELSE 2 * CAST(d[length(d) + 1 - i] AS INT) END)) % 10 = 0"""
PRIVATE = r"^(0\.0\.0\.0$|255\.255\.255\.255$|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)"


def _listed(rule: str) -> str:
    if rule.startswith("ipv"):
        return rf"regexp_matches(lower(value), '{PRIVATE}')"
    if rule == "email":
        return "lower(regexp_extract(value, '[^@]*$')) IN ('localhost', 'localhost.localdomain', 'example.com', 'example.org', 'example.net', 'test.com', 'test.local')"
    return "lower(value) = 'localhost'"


def found(rules: list[str] | None = None, custom: dict[str, tuple[str, str]] | None = None, placeholder: str | None = None) -> str:
    """CTE ``found``: id, ord, rule_name, placeholder, prio, start, e, value, confidence of every match of every rule."""
    parts = []
    for i, rule in enumerate(BUILTIN_RULES):
        if rules is None or rule.name in rules:
            d = "regexp_replace(value, '[^0-9]', '', 'g')"
            sure = f"CASE WHEN {LUHN} THEN 'high' ELSE 'low' END" if rule.name == "credit_card" else "'high'"
            rows = f"SELECT *, {d} AS d FROM ({SPANS[rule.name]})" if rule.name == "credit_card" else SPANS[rule.name]
            parts.append(f"SELECT id, {i} AS ord, '{rule.name}' AS rule_name, '{placeholder or rule.placeholder}' AS placeholder, {rule.priority} AS prio, start, start + length(value) AS e, value, {sure} AS confidence FROM ({rows}) WHERE NOT {_listed(rule.name)}")
    for i, (name, (pattern, mark)) in enumerate((custom or {}).items()):
        parts.append(f"SELECT id, {100 + i} AS ord, '{name}' AS rule_name, '{mark}' AS placeholder, 0 AS prio, start, start + length(value) AS e, value, 'high' AS confidence FROM ({plain(pattern)})")
    return "found AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def resolved(source: str, entropy: tuple[float, int] | None = None, **more) -> str:
    """CTEs up to ``kept(id, m)``: the matches that are left once overlaps are resolved, in order; with ``entropy`` (threshold, window) stretches that no match overlaps too."""
    m = "{'rule_name': r.rule_name, 'placeholder': r.placeholder, 'prio': r.prio, 'start': r.start, 'e': r.e, 'value': r.value, 'confidence': r.confidence}"
    ctes = found(**more)
    if entropy:
        ctes = ctes.replace("found AS", "by_rule AS", 1) + f""",
{entropy_stretches(*entropy)},
found AS MATERIALIZED (SELECT * FROM by_rule UNION ALL SELECT id, 1000, 'high_entropy', '[SECRET]', 0, p, e, value, 'high' FROM stretch WHERE NOT EXISTS (FROM by_rule r WHERE r.id = stretch.id AND p < r.e AND stretch.e > r.start))"""
    return f"""{normalised(source)},
{ctes},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, prio, e DESC, ord) AS rn FROM found),
fold AS (SELECT id, rn, [{m}] AS kept FROM ranked r WHERE rn = 1
    UNION ALL SELECT f.id, r.rn, CASE WHEN r.start >= f.kept[-1].e THEN list_append(f.kept, {m})
        WHEN r.start <= f.kept[-1].start AND r.e >= f.kept[-1].e THEN list_append(f.kept[1:len(f.kept) - 1], {m})
        WHEN f.kept[-1].start <= r.start AND f.kept[-1].e >= r.e THEN f.kept
        WHEN r.prio < f.kept[-1].prio OR (r.prio = f.kept[-1].prio AND r.e - r.start > f.kept[-1].e - f.kept[-1].start) THEN list_append(f.kept[1:len(f.kept) - 1], {m})
        ELSE f.kept END FROM fold f JOIN ranked r ON r.id = f.id AND r.rn = f.rn + 1),
kept AS (SELECT id, unnest(kept) AS m FROM (SELECT id, arg_max(kept, rn) AS kept FROM fold GROUP BY id))"""


def entropy_stretches(threshold: float, size: int) -> str:
    """CTEs up to ``stretch(id, p, e, value, bits)``: a window at or over the threshold grows by characters while it stays there, and the search goes on behind it.

    Windows under the threshold move on by a third, so the next start is the next good window at a multiple of that.  The entropy of a growing
    stretch is log n less the running sum of each character's change of c log c, over n.
    """
    step = max(1, size // 3)
    plausible = r"""value <> repeat(value[1], length(value)) AND NOT regexp_matches(value, '[\n\r\t]') AND NOT regexp_matches(value, '(?i)data:[^;]+;base64,')
        AND len(regexp_extract_all(value, '[一-鿿぀-ゟ゠-ヿ가-힯]')) <= 0.3 * length(value) AND len(regexp_extract_all(value, '[ \x{3000}]')) <= 0.25 * length(value)"""
    weight = lambda n: f"(CASE WHEN {n} > 1 THEN ({n}) * log2({n}) ELSE 0 END)"
    return f"""txt AS MATERIALIZED (SELECT id, text FROM n WHERE length(text) >= {size}),
ch AS MATERIALIZED (SELECT id, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS c FROM txt),
good AS MATERIALIZED (SELECT id, i AS p FROM (SELECT id, i, string_agg(c, '') OVER w AS v FROM ch WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING))
    WHERE length(v) = {size} AND list_aggregate(string_split(v, ''), 'entropy') >= {threshold} - 1e-9),
grown AS (SELECT id, CAST(-1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS e FROM txt
    UNION ALL SELECT id, p, coalesce(min(i) FILTER (WHERE i >= p + {size} AND bits < {threshold} - 1e-9), max(i) + 1) AS e
    FROM (SELECT id, p, i, log2(i - p + 1) - sum({weight('m')} - {weight('m - 1')}) OVER (PARTITION BY id ORDER BY i) / (i - p + 1) AS bits
        FROM (SELECT s.id, s.p, ch.i, row_number() OVER (PARTITION BY s.id, ch.c ORDER BY ch.i) AS m
            FROM (SELECT grown.id, min(good.p) AS p FROM grown JOIN good ON good.id = grown.id AND good.p >= grown.e AND (good.p - grown.e) % {step} = 0 GROUP BY grown.id) s JOIN ch ON ch.id = s.id AND ch.i >= s.p))
    GROUP BY id, p),
stretch AS (SELECT id, p, e, value, list_aggregate(string_split(value, ''), 'entropy') AS bits FROM (SELECT id, p, e, substr(txt.text, p + 1, e - p) AS value FROM grown JOIN txt USING (id) WHERE p >= 0) WHERE {plausible})"""


def with_(ctes: str, query: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{query}"


def scanned(source: str, query: str, more: str = "", **rules) -> str:
    """``query`` over ``kept`` and further CTEs."""
    return with_(resolved(source, **rules) + (f",\n{more}" if more else ""), query)


def redacted(source: str, query: str, **more) -> str:
    """``query`` over ``done(id, text, replacements)``."""
    return with_(
        resolved(source, **more)
        + """,
high AS (SELECT id, m.start AS start, m.e AS e, m.placeholder AS placeholder, coalesce(lag(m.e) OVER (PARTITION BY id ORDER BY m.start), 0) AS done_to FROM kept WHERE m.confidence = 'high'),
cut AS (SELECT n.id, string_agg(substr(n.text, CAST(done_to + 1 AS BIGINT), CAST(start - done_to AS BIGINT)) || placeholder, '' ORDER BY start) || substr(n.text, CAST(max(e) + 1 AS BIGINT)) AS text, count(*) AS n FROM high JOIN n ON n.id = high.id GROUP BY n.id, n.text),
done AS (SELECT n.id, coalesce(cut.text, n.text) AS text, CAST(coalesce(cut.n, 0) AS INT) AS replacements FROM n LEFT JOIN cut ON cut.id = n.id)""",
        query,
    )
