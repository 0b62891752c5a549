"""Redaction of credentials in text: sixteen detectors in a fixed order, each run only where one of its literals occurs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: What may stand right before a token: a word break (ASCII), or the escape that glues it to other text.
GLUE = r"(?:(?<![A-Za-z0-9_])|%[0-9A-Fa-f]{2}|\\[nrt]|\\u[0-9A-Fa-f]{4})"
#: Kind, literals (any case), what precedes the secret, the secret. Without the third part the whole match goes.
DETECTORS = (
    ("private_key", ("private key",), "", r"(?s:-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\z))"),
    ("private_key", ("-----end",), "", r"(?m:(?:^[ \t]*[A-Za-z0-9+/=]+[ \t]*\r?\n)*^[ \t]*[A-Za-z0-9+/=]*[ \t]*\r?\n?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)"),
    ("aws_access_key", ("akia", "asia", "agpa", "aida", "aroa", "aipa", "anpa", "anva", "abia", "acca"), GLUE, r"(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ABIA|ACCA)[0-9A-Z]{16}(?![0-9A-Z])"),
    ("aws_secret_key", ("aws_secret", "aws-secret", "awssecret", "secret_access_key", "secretaccesskey", "secret-access-key"), r"""(?i:(?:aws[_-]?secret[_-]?(?:access[_-]?)?key|secret[_-]?access[_-]?key)["']?\s*[:=]\s*["']?)""", r"[A-Za-z0-9/+=]{40}"),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), GLUE, r"gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}"),
    ("api_key", ("sk-",), GLUE, r"sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}"),
    ("slack_token", ("xox",), GLUE, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", ("aiza",), GLUE, r"AIza[0-9A-Za-z_\-]{35}"),
    ("stripe_key", ("_live_", "_test_"), GLUE, r"(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", ("eyj",), GLUE, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("url_credentials", ("://",), r"[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://", r"""[^\s/:@'"]+:[^\s/@'"]+(?=@)"""),
    ("bearer_token", ("bearer",), r"(?i:(?<![A-Za-z0-9_])bearer\s+)", r"[A-Za-z0-9\-._~+/]{20,}=*"),
    ("basic_auth", ("authorization",), r"""(?i:authorization["']?\s*[:=]\s*["']?basic\s+)""", r"[A-Za-z0-9+/]{8,}={0,2}"),
    ("cli_credential", ("-password", "-passwd", "-token", "-secret", "-api-key", "-apikey"), r"""(?i:(?:^|[^A-Za-z0-9_]|\\[nrt]|%[0-9A-Fa-f]{2})--?(?:password|passwd|token|secret|api-?key|auth-token|access-token)["']?(?:\s*,\s*|\s+|=)["']?)""", r"""[A-Z0-9$%@#*&^~+=/\\_][^\s"']*|[a-z][^\s"']*[A-Z0-9$%@#*&^~+=/\\_][^\s"']*|[a-z]{12,}"""),
    ("cli_credential", ("curl",), r"""(?i:(?<![A-Za-z0-9_])curl(?![A-Za-z0-9_])[^\n|;&]*?\s(?:-u|--user)(?:\s+|=)["']?)""", r"""[^\s"':]+:[^\s"']+"""),
    ("generic_secret", ("key", "secret", "token", "passw", "auth"), r"""(?i:(?:api[_-]?key|secret|token|passw(?:or)?d|auth)["']?\s*[:=]\s*["']?)""", r"""[^\s"',;]{8,}"""),
)


def redact(s: Column) -> Column:
    """s with what the detectors find replaced by ``[REDACTED:kind]``; texts of fewer than 8 bytes, and marks already there, stay.

    The text is lower-cased once and searched for literals; a detector without one of its own does not run.
    """
    low = F.lower(s)
    has = lambda literals: reduce(lambda a, b: a | b, [low.contains(x) for x in literals])
    gates = F.array(*[has(literals) for _, literals, _, _ in DETECTORS])

    def run(gate: Column, text: Column, kind: str, before: str, secret: str) -> Column:
        mark = f"[REDACTED:{kind}]"
        pattern, to = (f"({before})(?!\\[REDACTED:)(?:{secret})", "$1" + mark) if before else (secret, mark)
        return let(text, lambda x: F.when(gate, F.regexp_replace(x, pattern, to)).otherwise(x))

    def chain(gate: Column) -> Column:
        return reduce(lambda text, d: run(gate[d[0]], text, d[1][0], *d[1][2:]), enumerate(DETECTORS), s)

    return F.when(F.octet_length(s) >= 8, let(gates, lambda gate: F.when(F.exists(gate, lambda g: g), chain(gate)).otherwise(s))).otherwise(s)
