"""Redaction of secrets, hosts and addresses from any text column; the order of the steps matters."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import entropy

# Fixed values, needed for equal results: patterns, their order and what takes their place.
VALUE = r"""(?!\[REDACTED)([^\s'"]+|'[^']*'|"[^"]*")"""
RISKY = r"[A-Za-z0-9_]*(?:pass|key|secret|token|auth|cred|pwd|passphrase|url|uri|host|port|user)[A-Za-z0-9_]*"
NAMED_KEYS = r"\b(?:GOOGLE_API_KEY|OPENAI_API_KEY|ANTHROPIC_API_KEY|DEEPSEEK_API_KEY)\s*=\s*|--(?:google-api-key|openai-api-key|anthropic-api-key|deepseek-api-key)=|(?:^|\s)--(?:google-api-key|openai-api-key|anthropic-api-key|deepseek-api-key)\s+"
SECRETS = [
    ("private_key", r"(?is)-----BEGIN\s+[A-Z ]+\s+PRIVATE\s+KEY-----.*?-----END\s+[A-Z ]+\s+PRIVATE\s+KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("uri", r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:@/]+:[^\s:@/]+@[^\s]+", "[REDACTED_URI_CREDENTIALS]"),
    ("phrase", r"(?i)\b(password|passwd|pwd|secret)\s+[A-Za-z0-9!@#$%^&*()\-_=+,.?]{6,}", "$1 [REDACTED]"),
    ("phrase", r"(?i)(?<!-)(?<![\w-])\b(password|passwd|pwd|secret)\b\s*[=:]\s*\S+", "$1 [REDACTED]"),
    ("aws", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED_AWS_KEY]"),
    ("slack", r"\bxoxb-[0-9]{11,13}-[a-zA-Z0-9]{24}\b", "[REDACTED_SLACK_TOKEN]"),
    ("bearer", r"(?i)\bbearer\s+([a-zA-Z0-9\-._~+/]+=*)\b", "Bearer [REDACTED_TOKEN]"),
    ("google", r"\bAIzaSy[a-zA-Z0-9_-]{30,45}\b", "[REDACTED_GOOGLE_KEY]"),
    ("anthropic", r"\bsk-ant-[a-zA-Z0-9_-]{40,}\b", "[REDACTED_ANTHROPIC_KEY]"),
    ("deepseek", r"\bsk-[a-zA-Z0-9_-]{32}\b", "[REDACTED_DEEPSEEK_KEY]"),
    ("openai", r"\bsk-[a-zA-Z0-9_-]{32,}\b", "[REDACTED_OPENAI_KEY]"),
    ("named_key", rf"(?i)({NAMED_KEYS}){VALUE}", "$1[REDACTED]"),
    ("github", r"\bgh[psouhr]_[A-Za-z0-9]{20,}\b", "[REDACTED_GITHUB_PAT]"),
    ("github", r"\bgithub_pat_[A-Za-z0-9_]+\b", "[REDACTED_GITHUB_PAT]"),
    ("token", r"\bsk_live_[A-Za-z0-9_]+\b", "[REDACTED_TOKEN]"),
    ("token", r"\bsk-(?:proj-|ant-api03-)?[A-Za-z0-9]{20,}\b", "[REDACTED_TOKEN]"),
    ("token", r"\bnpm_[A-Za-z0-9]{36}\b", "[REDACTED_TOKEN]"),
    ("environment", rf"(?i)(export\s+{RISKY}=){VALUE}", "$1[REDACTED]"),
    ("environment", rf"(?i)\b({RISKY})={VALUE}", "$1=[REDACTED]"),
    ("flag", rf"(?i)(--password=|\b--password\s+|\b--pass=|\b--pass\s+|--token=|--token\s+|--api-key=|--api-key\s+){VALUE}", "$1[REDACTED]"),
]
SHORT_PASSWORD = (r"(?i)\b(mysql|mysqldump|mongo|influx)\b", rf"((?<!\S)-p){VALUE}", "$1[REDACTED]")
ADDRESSES = [
    ("ip", r"(?<![\d\.])(?:\d{1,3}\.){3}\d{1,3}(?![\d\.])", "[REDACTED_IP]"),
    ("ip", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b|\b[0-9a-fA-F]{1,4}::[0-9a-fA-F]{1,4}\b|\b::[0-9a-fA-F]{1,4}\b|\b[0-9a-fA-F]{1,4}::\b|\b::1\b", "[REDACTED_IP]"),
]
FILES = [
    "py", "json", "db", "sh", "xml", "yml", "yaml", "md", "txt", "c", "cpp", "h", "go", "java", "js", "ts", "html", "css", "sqlite", "sqlite3", "rs", "toml",
    "lock", "sql", "cfg", "conf", "ini", "git", "egg-info", "class", "jar", "png", "jpg", "jpeg", "gif", "svg", "zip", "tar", "gz", "log", "out",
]
DOMAINS = [
    "com", "net", "org", "io", "edu", "gov", "info", "biz", "co", "dev", "cloud", "tech", "me", "ai", "cc", "xyz", "us", "uk", "de", "fr", "jp", "au",
    "ca", "in", "br", "cn", "ru", "local", "internal", "lan", "corp", "home", "intranet", "private", "localdomain",
]
BLACKLIST = [
    r"\bvault\b", r"\baws\s+configure\b", r"\bgh\s+auth\b", r"\bkubectl\s+.*?\bcreate\s+secret\b", r"\bgithub_pat_[a-zA-Z0-9_]+\b", r"\bsk_live_[a-zA-Z0-9_]+\b",
    r"\bnpm_[a-zA-Z0-9]{36}\b", r"\bsk-(?:proj-|ant-api03-)?[a-zA-Z0-9]{20,}\b", r"\bgh[psouhr]_[a-zA-Z0-9]{20,}\b", r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:@/]+:[^\s:@/]+@[^\s]+\b", r"\b(?:password|passwd|pwd|secret)\b\s*[=:]\s*\S+",
]
HOST = "[REDACTED_HOST]"
# End of fixed values.

_NAME = r"[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*"
_NOT_FILE = r"(?!(?i:" + "|".join(FILES) + r")\b)"
_LAST = rf"\.{_NOT_FILE}[a-zA-Z]{{2,}}\b(?!\.?[a-zA-Z0-9-])"
HOSTS = [
    (r"(?<=@|://)[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+\b", HOST),
    (rf"((?:^|\s)(?:-h|--host)(?:\s+|=)){_NAME}{_LAST}", "$1" + HOST),
    (rf"(^|[\s=]){_NAME}{_LAST}(?=:(?:\d|/))", "$1" + HOST),
    (rf"\b{_NAME}\.(?i:" + "|".join(DOMAINS) + r")\b(?!\.?[a-zA-Z0-9-])", HOST),
    (r"(?i)\b(https?|ftp|ssh)://[a-zA-Z0-9-.]+\b", "$1://" + HOST),
    (r"\b([a-zA-Z0-9_.-]+)@[a-zA-Z0-9-.]+\b", "$1@" + HOST),
]


# What a text must hold for the pattern of the same place to match: some of the lower-case words in each group, then a cheaper pattern.
_PHRASE = ("password", "passwd", "pwd", "secret")
_RISKY_NAME = r"(?i)(?:pass|key|secret|token|auth|cred|pwd|url|uri|host|port|user)[a-z0-9_]*="
Signs = tuple[list[tuple[str, ...]], str | None]
SECRET_SIGNS: list[Signs] = [
    ([("-----begin",), ("private",)], None), ([("://",), ("@",)], None), ([_PHRASE], None), ([_PHRASE, ("=", ":")], None), ([("akia", "asia")], "AKIA|ASIA"), ([("xoxb-",)], None),
    ([("bearer",)], None), ([("aizasy",)], None), ([("sk-ant-",)], None), ([("sk-",)], None), ([("sk-",)], None), ([("api_key", "api-key")], None),
    ([("ghp_", "ghs_", "gho_", "ghu_", "ghh_", "ghr_")], None), ([("github_pat_",)], None), ([("sk_live_",)], None), ([("sk-",)], None), ([("npm_",)], None),
    ([("export",), ("=",)], _RISKY_NAME), ([("=",)], _RISKY_NAME), ([("--pass", "--token", "--api-key")], None),
]
ADDRESS_SIGNS: list[Signs] = [([(".",)], r"\d\.\d"), ([(":",)], "[0-9a-fA-F]:[0-9a-fA-F:]|::")]
HOST_SIGNS: list[Signs] = [
    ([("@", "://")], None), ([("-h",), (".",)], None), ([(":",), (".",)], r":[\d/]"), ([(".",)], r"\.(?i:" + "|".join(DOMAINS) + r")\b"), ([("://",)], None), ([("@",)], None),
]


def _shows(text: Column, low: Column, signs: Signs) -> Column:
    """Whether the text, ``low`` in lower case, holds the signs."""
    groups, pattern = signs
    tests = [reduce(Column.__or__, [low.contains(w) for w in words]) for words in groups]
    return reduce(Column.__and__, [*tests, *([text.rlike(pattern)] if pattern else [])])


def _then(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of the value, which is computed once however often the step names it."""
    return F.transform(F.array(value), step)[0]


def _of_one(f: Callable[..., Column], *given: object) -> Callable[[Column], Column]:
    return lambda t: f(*given, t)


def _replaced(text: Column, steps: list[tuple[str, str, Signs]]) -> Column:
    """The steps in order. Patterns are slow and seldom match, so one is only tried where the text shows its signs, or was changed by an earlier one."""

    def run(first: Column) -> Column:
        shown = _then(F.lower(first), lambda low: F.array(*[_shows(first, low, signs) for _, _, signs in steps]))

        def one(shown: Column, pattern: str, to: str, t: Column) -> Column:
            return F.when(shown | (t != first), F.regexp_replace(t, pattern, to)).otherwise(t)

        def chain(shown: Column) -> Column:
            text = first
            for k, (pattern, to, _) in enumerate(steps):
                text = _then(text, _of_one(one, shown[k], pattern, to))
            return text

        return _then(shown, chain)

    return _then(text, run)


_HOST_STEPS = [(pattern, to, signs) for (pattern, to), signs in zip(HOSTS, HOST_SIGNS, strict=True)]
_STEPS = [
    *[(pattern, to, signs) for (_, pattern, to), signs in zip(SECRETS, SECRET_SIGNS, strict=True)],
    (*SHORT_PASSWORD[1:], ([("mysql", "mongo", "influx"), ("-p",)], SHORT_PASSWORD[0])),
    *[(pattern, to, signs) for (_, pattern, to), signs in zip(ADDRESSES, ADDRESS_SIGNS, strict=True)],
    *_HOST_STEPS,
]


def redact_hosts(text: Column) -> Column:
    """Names after @ or ://, host arguments, name:port, and names with a known top-level domain; files stay."""
    return _replaced(text, _HOST_STEPS)


def _looks_random(token: Column) -> Column:
    n = F.length(token)
    mixed = token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]")
    return F.when(n >= 24, entropy(token) > 4.3).when((n >= 16) & mixed, entropy(token) > 3.9).otherwise(False)


def redact_entropy(text: Column) -> Column:
    """Long tokens of a base64-like alphabet whose characters are near random."""

    def step(t: Column) -> Column:
        tokens = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b([a-zA-Z0-9_+/=-]{16,})\b"), 1))
        return F.aggregate(F.filter(tokens, _looks_random), t, lambda acc, x: F.replace(acc, x, F.lit("[REDACTED_ENTROPY]")))

    return _then(text, step)


def valid_patterns(patterns: list[str]) -> list[str]:
    """Those that compile."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def redact(text: Column, custom: list[str] = ()) -> Column:
    """All steps in order; ``custom`` regexes come last, without case, and invalid ones are skipped."""
    text = redact_entropy(_replaced(text, _STEPS))
    for pattern in valid_patterns(list(custom)):
        text = F.regexp_replace(text, f"(?i){pattern}", "[REDACTED_CUSTOM]")
    return text


def redaction_counts(text: Column) -> Column:
    """How often each kind of secret and address occurs in the text before redaction, as a map."""

    def counted(low: Column) -> Column:
        kinds: dict[str, Column] = {}
        for (kind, pattern, _), signs in zip([*SECRETS, *ADDRESSES], [*SECRET_SIGNS, *ADDRESS_SIGNS], strict=True):
            n = F.when(text.isNull(), None).when(_shows(text, low, signs), F.regexp_count(text, F.lit(pattern))).otherwise(0)
            kinds[kind] = kinds[kind] + n if kind in kinds else n
        return F.create_map(*[x for k, n in kinds.items() for x in (F.lit(k), n)])

    return _then(F.lower(text), counted)


def glob_or_regex(pattern: str) -> str:
    """``re:`` patterns are searched as they are; globs must match the whole text."""
    return pattern[3:] if pattern.startswith("re:") else "^" + fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


def is_blacklisted(text: Column, user: list[str] = ()) -> Column:
    """Matches a built-in pattern or one of the user's globs and regexes."""
    patterns = [*BLACKLIST, *valid_patterns([glob_or_regex(p) for p in user])]
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?is){p}" if p.startswith("^") else f"(?i){p}")
    return out


def scrub_paths(text: Column, homes: list[str], users: list[str]) -> Column:
    """Home folders become ~ and user names [USER], longest first."""
    for home in sorted(homes, key=len, reverse=True):
        text = F.regexp_replace(text, re.escape(home.rstrip("/")) + r"(?=/|\s|$)", "~")
    for user in sorted(users, key=len, reverse=True):
        text = F.regexp_replace(text, rf"\b{re.escape(user)}\b", "[USER]")
    return text
