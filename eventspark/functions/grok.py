"""Named log patterns, compiled once to one Java expression with numbered groups."""

from __future__ import annotations

import re

from .regex import group_names, java

_IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))"
_HOST = r"[0-9A-Za-z][0-9A-Za-z\-\.]*"
_NUMBER = r"(?:[+-]?(?:(?:[0-9]+(?:\.[0-9]+)?)|\.[0-9]+))"
_COMMON = r'(?P<clientip>\S+) \S+ (?P<ident>\S+) \[(?P<timestamp>[^\]]+)\] "(?P<verb>\w+) (?P<request>\S+)(?: HTTP/(?P<httpversion>[0-9.]+))?" (?P<response>\d{3}) (?P<bytes>\d+|-)'

#: What each pattern name stands for. Any other name stands for OTHER.
PATTERNS = {
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "GREEDYMULTILINE": r"[\s\S]*",
    "INT": r"(?:[+-]?(?:[0-9]+))",
    "NUMBER": _NUMBER,
    "BASE10NUM": _NUMBER,
    "BASE16NUM": r"(?:0[xX]?[0-9a-fA-F]+)",
    "POSINT": r"[1-9][0-9]*",
    "NONNEGINT": r"[0-9]+",
    "IP": _IPV4,
    "IPV4": _IPV4,
    "IPV6": r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}",
    "IPORHOST": r"(?:[0-9A-Za-z][0-9A-Za-z\-\.]*|(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))",
    "HOSTNAME": _HOST,
    "HOSTPORT": _HOST + r":\d+",
    "PORT": r"\d+",
    "MAC": r"(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}",
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+\-\.]*",
    "URIPATH": r"/[A-Za-z0-9$.+!*'(){},~:;=@#%&/\-]*",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;\-_\?\[\]]*",
    "URI": r"[A-Za-z][A-Za-z0-9+\-\.]*://[^\s]*",
    "USER": r"[a-zA-Z0-9._-]+",
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "EMAILADDRESS": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "MONTH": r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHDAY": r"(?:0?[1-9]|[12][0-9]|3[01])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"\d{4}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"[0-5][0-9]",
    "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?",
    "TIME": r"(?:2[0123]|[01]?[0-9]):(?:[0-5][0-9]):(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIMESTAMP_ISO8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "HTTPDATE": r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
    "DATE": r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}",
    "DATESTAMP": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    "LOGLEVEL": r"(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|SEVERE)",
    "SYSLOGFACILITY": r"<\d+>",
    "SYSLOGHOST": _HOST,
    "SYSLOGPROG": r"[^\[\]:]+(?:\[\d+\])?",
    "HTTPVERB": r"\b\w+\b",
    "RAWREQUEST": r".*",
    "COMMONAPACHELOG": _COMMON,
    "COMBINEDAPACHELOG": _COMMON + r' "(?P<referrer>[^"]*)" "(?P<agent>[^"]*)"',
    "PATH": r"(?:/[\w_%!$@:.,+~-]*)+",
    "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+",
    "WINPATH": r"[A-Za-z]:\\(?:[\w._-]+\\)*[\w._-]*",
    "QS": r'"(?:[^"\\]|\\.)*"',
    "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"',
    "UUID": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
}
OTHER = r"\S+"

_CALL = re.compile(r"%\{(\w+)(?::([^:}]+))?(?::(\w+))?\}")


def compile_pattern(source: str, extra: dict[str, str] | None = None) -> tuple[str, list[tuple[str, str, int]]]:
    """A Java expression, and (field, type, group) for each capture; type is int, float or string."""
    known = PATTERNS | (extra or {})
    hints: dict[str, str] = {}

    def put(m: re.Match) -> str:
        name, target, kind = m.groups()
        body = known.get(name, OTHER)
        if target is None:
            return f"(?:{body})"
        hints[target] = kind if kind in ("int", "float") else "string"
        return f"(?P<{_safe(target)}>{body})"

    def _safe(target: str) -> str:
        return target if re.fullmatch(r"[A-Za-z_][\w.\[\]@-]*", target) else "f" + re.sub(r"\W", "_", target)

    whole = _CALL.sub(put, source)
    captures = [(name, hints.get(name, "string"), k) for k, name in enumerate(group_names(whole), 1) if name]
    return java(whole), captures
