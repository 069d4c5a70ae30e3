r"""Recognising and redacting credentials in text, inside the JVM.

Word boundaries are spelled out for ASCII because ``\b`` differs between regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.common import let

MARKER = "[REDACTED_SECRET]"
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# Fixed value: white space as ECMAScript counts it.
_NS = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_S = f"[{_NS}]"

# Token families that are replaced as a whole.
TOKEN_PATTERNS = (
    rf"{_B}(?:gh[pousr]_[A-Za-z0-9_]{{16,}}|github_pat_[A-Za-z0-9_]{{16,}}|npm_[A-Za-z0-9]{{20,}}){_B}",
    rf"{_B}sk-(?:proj-|ant-)?[A-Za-z0-9_-]{{20,}}{_B}",
    rf"{_B}xox[baprs]-[A-Za-z0-9-]{{12,}}{_B}",
    rf"{_B}(?:glpat-[A-Za-z0-9_-]{{16,}}|hf_[A-Za-z0-9]{{20,}}|AIza[A-Za-z0-9_-]{{30,}}){_B}",
    rf"{_B}(?:AKIA|ASIA)[A-Z0-9]{{16}}{_B}",
    rf"{_B}eyJ[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{8,}}{_B}",
)
# Families whose leading part stays readable (group 1).
PREFIX_PATTERNS = (
    rf"(?i){_B}([a-z][a-z0-9+.-]{{1,20}}://)[^{_NS}/@:]+:[^{_NS}/@]+@",
    rf"(?i){_B}((?:Bearer|Basic){_S}+)[A-Za-z0-9+/_.=-]{{8,}}",
    rf"""(?i)([?&](?:X-Amz-Signature|X-Goog-Signature|sig)=)[^&{_NS}"'<>]+""",
)
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----"
CLI_SECRET = (rf"(?i)--(?:[a-z]+-)*(?:api-key|token|password|secret|client-secret|access-key)"
              rf"""(?:{_S}+|=)(?:"[^"]+"|'[^']+'|[^{_NS};]+)""")
CREDENTIAL_KEY = (
    r"(?i)(?:^|[_.-])(?:api[_-]?key|access[_-]?key(?:[_-]?id)?|secret(?:[_-]?(?:access[_-]?)?key)?"
    r"|client[_-]?secret|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|password|passwd"
    r"|private[_-]?key|authorization|cookie|set[_-]?cookie|credentials?)$"
)
REFERENCE = (
    r"(?i)^(?:\[REDACTED(?:_SECRET)?\]|<redacted>|needs-rebinding|\$\{[A-Z_][A-Z0-9_]*\}"
    r"|\$[A-Z_][A-Z0-9_]*|process\.env\.[A-Z_][A-Z0-9_]*)$"
)
_VALUE = rf"""(?:"([^"]*)"|'([^']*)'|(\$\{{[A-Z_][A-Z0-9_]*\}}|[^{_NS},;&}}\]]+))"""
_KEY = r"([A-Za-z_][A-Za-z0-9_.-]{0,127})"
# The value is only looked at, so that "https:" cannot swallow a later "?token=".
ASSIGNMENT = rf"""(?:^|[{_NS}"'?&,{{]){_KEY}(?=["']?{_S}*[:=]{_S}*{_VALUE})"""
ASSIGNMENT_WHOLE = rf"""(?m)(^|[{_NS}"'?&,{{]){_KEY}(["']?{_S}*[:=]{_S}*){_VALUE}"""
# Every sensitive key contains one of these words, and ends in one form of them before the sign.
KEY_WORDS = ("key", "secret", "token", "passw", "authorization", "cookie", "credential")
KEY_BEFORE_SIGN = (rf"""(?i)(?:key(?:[_-]?id)?|secret|token|password|passwd|authorization|cookie|credentials?)["']?{_S}*[:=]""")


def credential_key(key: Column) -> Column:
    """Whether a name in any case style ends in a credential word."""
    humps = F.regexp_replace(key, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    humps = F.regexp_replace(humps, r"([a-z0-9])([A-Z])", "$1_$2")
    return humps.rlike(CREDENTIAL_KEY)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_S}+|{_S}+$", "")


def is_blank(text: Column) -> Column:
    return js_trim(text) == ""


def populated_text(value: Column) -> Column:
    """A value that is present and not a reference or placeholder."""
    return F.coalesce((value != "") & ~js_trim(value).rlike(REFERENCE), F.lit(False))


# Literals without which a pattern cannot match; finding them is far cheaper than the pattern.
_LITERALS = (
    ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "npm_"), ("sk-",), ("xox",),
    ("glpat-", "hf_", "AIza"), ("AKIA", "ASIA"), ("eyJ",),
)
_LOWER_LITERALS = (("://",), ("bearer", "basic"), ("signature=", "sig="))


def _has_any(text: Column, literals: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(literals[0]))
    for literal in literals[1:]:
        found = found | F.contains(text, F.lit(literal))
    return found


def known_token(text: Column) -> Column:
    lower = F.lower(text)
    known = ((F.contains(text, F.lit("PRIVATE KEY-----")) & text.rlike(PRIVATE_KEY))
             | (F.contains(text, F.lit("--")) & text.rlike(CLI_SECRET)))
    for pattern, literals in zip(TOKEN_PATTERNS, _LITERALS):
        known = known | (_has_any(text, literals) & text.rlike(pattern))
    for pattern, literals in zip(PREFIX_PATTERNS, _LOWER_LITERALS):
        known = known | (_has_any(lower, literals) & text.rlike(pattern))
    return known


def assigned_keys(text: Column) -> Column:
    """Sensitive keys that are assigned a populated value, in order of appearance."""
    groups = [F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(i)) for i in (1, 2, 3, 4)]
    pairs = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "kabc")])

    def sensitive(pair: Column) -> Column:
        value = F.concat(pair["a"], pair["b"], pair["c"])  # at most one of them is not empty
        return credential_key(pair["k"]) & populated_text(value)
    return F.transform(F.filter(pairs, sensitive), lambda p: p["k"])


def has_credentials(text: Column) -> Column:
    """Plain-text check: token families, command-line secrets, sensitive assignments."""
    words = _has_any(F.lower(text), KEY_WORDS) & text.rlike(KEY_BEFORE_SIGN)
    assigned = F.when(words, F.size(assigned_keys(text)) > 0).otherwise(False)
    return F.coalesce(known_token(text) | assigned, F.lit(False))


def redact_text(text: Column) -> Column:
    """struct(value, count): recognised credentials replaced by a marker.

    A private key or command-line secret replaces everything, and so does a text that still has a
    hit after the replacements.
    """
    same = F.struct(text.alias("value"), F.lit(0).cast("bigint").alias("count"))
    return F.when(~has_credentials(text), same).otherwise(redact_hit(text))


def redact_hit(text: Column) -> Column:
    """``redact_text`` for a text that is known to hold a credential."""
    def replaced(state: Column, pattern: str, marker: str) -> Column:
        return let(state, lambda s: F.struct(
            F.regexp_replace(s["value"], pattern, marker).alias("value"),
            (s["count"] + F.regexp_count(s["value"], F.lit(pattern))).cast("bigint").alias("count")))
    state = F.struct(text.alias("value"), F.lit(0).cast("bigint").alias("count"))
    for pattern in TOKEN_PATTERNS:
        state = replaced(state, pattern, MARKER)
    for pattern in PREFIX_PATTERNS:
        state = replaced(state, pattern, f"$1{MARKER}")
    state = let(state, lambda s: let(_redact_assignments(s["value"]), lambda a: F.struct(
        a["text"].alias("value"), (s["count"] + a["n"]).cast("bigint").alias("count"))))
    whole = lambda n: F.struct(F.lit(MARKER).alias("value"), n.cast("bigint").alias("count"))
    result = let(state, lambda s: F.when((s["count"] > 0) & ~has_credentials(s["value"]), s).otherwise(
        whole(F.greatest(s["count"], F.lit(1).cast("bigint")))))
    return F.when(text.rlike(PRIVATE_KEY) | text.rlike(CLI_SECRET), whole(F.lit(1))).otherwise(result)


def _redact_assignments(text: Column) -> Column:
    """Rewrite the sensitive assignments only: cut the text at every assignment and rejoin."""
    between = F.split(text, ASSIGNMENT_WHOLE, -1)
    parts = {name: F.regexp_extract_all(text, F.lit(ASSIGNMENT_WHOLE), F.lit(i)).alias(name)
             for name, i in (("all", 0), ("pre", 1), ("key", 2), ("sep", 3), ("ref", 6))}

    def swap(m: Column) -> Column:
        keep = ~credential_key(m["key"]) | ((m["ref"] != "") & m["ref"].rlike(REFERENCE))
        return F.when(keep, F.struct(m["all"].alias("t"), F.lit(0).alias("n"))).otherwise(
            F.struct(F.concat(m["pre"], m["key"], m["sep"], F.lit(f'"{MARKER}"')).alias("t"),
                     F.lit(1).alias("n")))
    swapped = F.transform(F.arrays_zip(*parts.values()), swap)
    joined = F.array_join(F.zip_with(
        between, F.transform(swapped, lambda s: s["t"]),
        lambda b, m: F.concat(F.coalesce(b, F.lit("")), F.coalesce(m, F.lit("")))), "")
    total = F.aggregate(swapped, F.lit(0), lambda acc, s: acc + s["n"])
    return F.struct(joined.alias("text"), total.alias("n"))


def redact_or_mask(text: Column) -> Column:
    """The text, or only the marker when anything in it is a credential."""
    return F.when(has_credentials(text), F.lit(MARKER)).otherwise(text)
