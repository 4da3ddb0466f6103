"""Text safety as Spark columns: injection signals, shield rules, secret redaction, address classes, routing of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of foreign roles, and phrasings that override instructions.
ROLE_MARKERS = (r"(?i)<\|im_start\|>", r"(?i)<\|begin_of_text\|>", r"(?i)</?(?:system|assistant)>", r"(?i)\[/?INST\]", r"(?i)###\s*(?:Instruction|System)\b")
OVERRIDES = (
    r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions|directions|rules)\b",
    r"(?i)\bforget\s+what\s+you\s+(?:were|are)\s+told\b",
    r"(?i)\bdisregard\s+the\s+system\s+prompt\b",
    r"(?i)\byou\s+are\s+now\s+(?:a|an)\s+[^.!?\n\r]{1,80}",
)
# Code points that hide or reorder text.
HIDDEN = {"unicode_bidi": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", "zero_width": r"[\x{200B}-\x{200D}\x{FEFF}]", "unicode_tag": r"[\x{E0020}-\x{E007F}]"}
# Rules of the shield with the parts of their names.
SHIELD = {
    "RoleTakeover.IgnorePriorInstructions": r"(?i)(ignore|forget|disregard)\s+(all\s+)?(prior|previous|above)\s+instructions?",
    "RoleTakeover.YouAreNow": r"(?i)you\s+are\s+now\s+(a|an|the)\s+",
    "RoleTakeover.SystemTag": r"(?i)<\s*/?\s*system\s*>",
    "RoleTakeover.ImStart": r"<\|im_start\|>",
    "RoleTakeover.PseudoRole": r"(?im)^[ \t]*(system|assistant|user)\s*:\s*",
    "IndirectExfil.JavascriptUrl": r"(?i)\bjavascript:",
    "IndirectExfil.UntilFurtherNotice": r"(?i)until\s+further\s+notice,\s+(the\s+)?(user|operator)",
    "Markup.BeginEndPrompt": r"(BEGIN|END)\s+PROMPT",
}
# What is redacted, in order; group 1 stays.
REDACTIONS = (
    ("credential_url", r"(?i)\b([a-z][a-z0-9+.-]*://)([^/\s:@]+):([^/\s@]+)@", "$1[REDACTED]@"),
    ("authorization_header", r"(?i)\b(Authorization\s*:\s*(?:Bearer|Basic)\s+)([^\s\"'`,;]+)", "$1[REDACTED]"),
    ("cookie_header", r"(?im)^([ \t]*(?:Cookie|Set-Cookie)\s*:\s*)[^\r\n]+", "$1[REDACTED]"),
    ("json_secret", r'(?i)("[A-Za-z0-9_-]*(?:(?:api|access|refresh|auth|session)[_-]?token|api[_-]?key|client[_-]?secret|password|passwd|secret|cookie|authorization)[A-Za-z0-9_-]*"\s*:\s*")([^"]+)(")', "$1[REDACTED]$3"),
    ("dotenv_secret", r"(?im)^([ \t]*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*(?:API_KEY|ACCESS_TOKEN|AUTH_TOKEN|REFRESH_TOKEN|SESSION_TOKEN|PRIVATE_KEY|CLIENT_SECRET|SECRET|PASSWORD|PASSWD|COOKIE)[A-Za-z0-9_]*\s*=\s*)(['\"]?)([^\r\n'\"]+)(\2)", "$1$2[REDACTED]$4"),
    ("key_value_secret", r"(?i)\b([A-Za-z_][A-Za-z0-9_]*(?:(?:api|access|refresh|auth|session)[_-]?token|api[_-]?key|client[_-]?secret|password|passwd|secret|cookie)[A-Za-z0-9_]*\s*[:=]\s*)(['\"]?)(?!\[REDACTED\])([^\s'\",}]+)(\2)", "$1$2[REDACTED]$4"),
    ("bearer_token", r"\b(Bearer\s+)([A-Za-z0-9._~+/-]{12,})\b", "$1[REDACTED]"),
    ("provider_token", r"\b(?:sk-(?:proj-)?[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9-]{10,})\b", "[REDACTED]"),
)
# Forms of a query that call for exact terms, with the reason given.
HYBRID_FORMS = (
    (r"(^|[\s`'\"])-{1,2}[A-Za-z0-9][\w-]*", "CLI flag token"),
    (r"\b[A-Z0-9]+_[A-Z0-9_]+\b", "constant or error-code token"),
    (r"(?i)\b[A-Za-z0-9_.-]+\.(?:ts|tsx|js|mjs|cjs|json|md|py|go|rs|java|cpp|c|h|yaml|yml|toml|lock)\b", "file-like token"),
    (r"[./\\][A-Za-z0-9_.-]+", "path-like token"),
    (r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\b", "identifier-like token"),
    (r"\b[A-Za-z_][A-Za-z0-9_]*\([^)]*\)", "function-call-like token"),
    (r"(?i)\b(?:PR|issue)\s*#?\d+\b", "issue or PR reference"),
    (r"#\d+\b", "numbered reference"),
)
# Fixed value: what an answer says that abstains.
ABSTAINED = r"(?i)\b(do not have enough|not enough|insufficient|cannot answer|can't answer|not contain|not in the provided context)\b"


def injection_signals(text: Column) -> Column:
    """Kinds of signals found, in order: role markers, overrides, kinds of hidden characters."""
    hit = lambda patterns, kind: F.when(F.greatest(*[text.rlike(p).cast("int") for p in patterns]) == 1, kind)
    return F.array_compact(F.array(hit(ROLE_MARKERS, "system_role_marker"), hit(OVERRIDES, "instruction_override"), *[F.when(text.rlike(p), kind) for kind, p in HIDDEN.items()]))


def shield_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(p)).cast("long") for name, p in SHIELD.items()}


def redact(text: Column) -> Column:
    for _, pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redaction_counts(text: Column) -> dict[str, Column]:
    """Matches of each rule on what the rules before it left."""
    out = {}
    for name, pattern, replacement in REDACTIONS:
        out[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, replacement)
    return out


def search_mode(query: Column) -> Column:
    """Struct (mode, reason): hybrid for queries with exact tokens, else dense."""
    trimmed, out = F.trim(query), F.struct(F.lit("dense").alias("mode"), F.lit("prose query").alias("reason"))
    for pattern, reason in reversed(HYBRID_FORMS):
        out = F.when(trimmed.rlike(pattern), F.struct(F.lit("hybrid").alias("mode"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def address_class(host: Column) -> Column:
    """Class of a dotted IPv4 address; what can't be parsed is ``blocked``."""
    part = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b = part(1), part(2)
    return (
        F.when(a.isNull() | (F.greatest(a, b, part(3), part(4)) > 255), "blocked")
        .when(a == 127, "loopback").when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 169) & (b == 254), "link_local").when((a == 100) & b.between(64, 127), "shared").when(a >= 224, "multicast").when(a == 0, "unspecified").otherwise("public")
    )


def abstention(answer: Column, included: Column) -> Column:
    return F.when(included == 0, "no_retrieved_context").when(answer.rlike(ABSTAINED), "model_abstained_from_context")
