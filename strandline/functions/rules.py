"""Ladders and labels over names, paths and actions; column functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.citations import BLANK

#: Endings of source files by language.
LANGUAGES = ((".tsx", "tsx"), (".ts", "typescript"), (".php", "php"))
#: Names of lock files.
LOCKFILES = ("bun.lock", "bun.lockb", "composer.lock", "deno.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
#: Names of configuration files.
CONFIGURATION = (
    ".editorconfig", ".env.example", ".gitattributes", ".gitignore", "dockerfile", "composer.json", "eslint.config.js", "eslint.config.mjs",
    "package.json", "phpstan.neon", "phpstan.neon.dist", "phpunit.xml", "playwright.config.ts", "prettier.config.js",
)
#: Patterns of paths by label, over lower-case paths.
PATHS = {
    "configuration": r"\.(ini|jsonc|toml|ya?ml)$|(^|/)(config|\.github)(/|$)",
    "schema": r"(^|/)(database/)?migrations?(/|$)|\.(graphql|prisma|sql)$|(^|/)openapi\.(json|ya?ml)$",
    "generated": r"(^|/)(dist|build|coverage|generated|node_modules|vendor)(/|$)|\.d\.tsx?$|\.generated\.|\.min\.(css|js|ts)$",
}
#: What a refresh looks at, over paths in any case.
REFRESH = {
    "documentation": r"(?i)(^|/)(docs?|documentation)(/|$)|\.(md|mdx|html?|rst|adoc)$",
    "openapi": r"(?i)(^|/)(openapi|swagger)([._-][^/]*)?\.(json|ya?ml)$",
    "configuration": r"(?i)(^|/)(package\.json|tsconfig[^/]*\.json|composer\.json|vite\.config\.[^/]+|next\.config\.[^/]+|playwright\.config\.[^/]+|routes?/[^/]+)$",
}
#: Names of actions that change something, by category, in order of precedence.
UNSAFE = (
    ("destructive", r"(?i)\b(delete|destroy|erase|remove|terminate|cancel account|close account|close registration|refund|revoke|disable|archive)\b"),
    ("payment", r"(?i)\b(pay|payment|purchase|buy|place order|complete order|card|billing)\b"),
    ("account_privilege", r"(?i)\b(admin|administrator|permission|privilege|change role|promote|demote|grant)\b"),
    ("external_message", r"(?i)\b(send|email|message|notify|publish|broadcast|invite|post|comment|reply)\b"),
    ("unknown_submission", r"(?i)\b(save|create|update|submit|confirm|approve|reserve|register|upload|add)\b"),
)
#: Names of actions that only read.
SAFE_READ = (
    r"(?i)^(details?|preview|summary|status)$|^(view|show|inspect|preview)\b|^(expand|collapse)\b|^refresh\s+(state|status|view|page|preview)$"
    r"|^(open|dismiss|close)\s+(modal|dialog|menu|panel|popover|drawer|section|details?|preview|window)$"
    r"|^load\s+([a-z0-9_-]+\s+){0,3}(details?|summary|status|preview|page|response|state)$"
)
#: Categories that may run by default, and run again.
SAFE = ("safe_read", "safe_navigation", "safe_form_progress", "credential_entry")
#: Personal data in observed text, in order (word borders in place of look-arounds, so any engine reads them).
PERSONAL = (
    (r"(?i)(waiting for )?\b(locator|getByRole|getByLabel|getByText)\([^\r\n]*", "[INTERNAL_TARGET]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b([0-9][ -]*?){13,19}\b", "[PAYMENT_REDACTED]"),
    (r"(\B\+|\b)[0-9][0-9 ().-]{7,}[0-9]\b", "[PHONE_REDACTED]"),
)
#: Labels whose next segment is secret, and segments that are identifiers.
SENSITIVE_LABEL = r"(?i)^(?:access|activate|activation|auth|callback|code|confirm|confirmation|credential|invite|login|magic(?:[-_]?link)?|oauth|password|recover|recovery|reset|secret|session|signature|t|token|verify|verification)$"
IDENTIFIER = r"(?i)^(?:\d+|[0-9a-f]{20,}|[0-9a-f]{8}-[0-9a-f-]{27,}|[A-Za-z0-9_~.-]{32,})$"
#: Scheme, host with port, and path of an absolute address.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#@]+)([^?#]*)"
METHODS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), "/"), -1)


def language(path: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(path).endswith(end), F.lit(name)) for end, name in LANGUAGES])


def symbol_kind(name: Column, path: Column, is_class: Column, is_member: Column, is_object: Column, has_markup: Column) -> Column:
    """class, handler, component, method, service or module, function: the first that holds."""
    client = path.rlike(r"\.client\.tsx?$") | name.rlike("(Client|Api|API)$")
    return (
        F.when(is_class, "class").when(name.rlike("^(handle|on)[A-Z]"), "handler")
        .when((language(path) == "tsx") & name.rlike("^[A-Z][A-Za-z0-9]*$") & has_markup, "component")
        .when(is_member, "method").when(is_object & client, "service").when(is_object, "module").otherwise("function")
    )


def file_labels(path: Column, binary: Column) -> Column:
    """All labels of a changed file, in order."""
    low, name = F.lower(path), basename(path)
    labels = {
        "source": language(path).isNotNull(),
        "configuration": name.isin(*CONFIGURATION) | low.rlike(PATHS["configuration"]),
        "schema": low.rlike(PATHS["schema"]),
        "lockfile": name.isin(*LOCKFILES),
        "generated": low.rlike(PATHS["generated"]),
        "binary": binary,
        "unsupported": language(path).isNull(),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in labels.items()])))


def file_reasons(path: Column, binary: Column, has_patch: Column, hunks: Column, operation: Column, copied: Column) -> Column:
    """Why parts of a changed file are not mapped, in order."""
    reasons = {
        "lockfile": basename(path).isin(*LOCKFILES),
        "generated_file": F.lower(path).rlike(PATHS["generated"]),
        "binary_file": binary,
        "unsupported_language": language(path).isNull(),
        "patch_unavailable": ~has_patch,
        "no_changed_ranges": (hunks == 0) & ~binary & has_patch & (operation == "modified"),
        "copied_file": copied,
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()])))


def refresh_kinds(path: Column, labels: Column) -> Column:
    """Which parts of the knowledge a changed path concerns."""
    kinds = {
        "documentation": path.rlike(REFRESH["documentation"]),
        "openapi": path.rlike(REFRESH["openapi"]),
        "configuration": path.rlike(REFRESH["configuration"]) | F.arrays_overlap(labels, F.array(F.lit("configuration"), F.lit("schema"))),
        "typescript": language(path).isin("tsx", "typescript"),
        "php": language(path) == "php",
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))


def action_category(kind: Column, name: Column, submit: Column, external: Column, download: Column, new_tab: Column, slot: Column) -> Column:
    """The category of a browser action, by precedence."""
    name = F.trim(F.coalesce(name, F.lit("")))
    unsafe = F.coalesce(*[F.when(name.rlike(p), F.lit(c)) for c, p in UNSAFE])
    return (
        F.when(download, "download").when(new_tab, "popup").when(external, "external_navigation")
        .when(kind.isin("fill", "select"), F.when(slot.isNull(), "unknown_submission").otherwise("credential_entry"))
        .when(unsafe.isNotNull(), unsafe).when(submit, "unknown_submission").when(kind.isin("navigate", "back"), "safe_navigation")
        .when(kind == "reload", "safe_read").when(kind == "check", "safe_form_progress").when(name.rlike(SAFE_READ), "safe_read")
        .otherwise("unknown_submission")
    )


def without_secrets(c: Column, secrets: Column | None) -> Column:
    """c with each of an array of secrets replaced, the longest first; null and empty ones are none."""
    if secrets is None:
        return c
    known = F.filter(secrets, lambda s: F.coalesce(F.length(s) > 0, F.lit(False)))
    order = F.array_sort(known, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.coalesce(F.aggregate(order, c, lambda text, s: F.replace(text, s, F.lit("[REDACTED]"))), c)


def redact_observed(c: Column, limit: int = 4096, secrets: Column | None = None) -> Column:
    """Observed text without the run's own secrets (an array), other secrets and personal data, white space of any kind collapsed, cut with a mark; [EMPTY]
    if nothing is left."""
    c = tx.redact(without_secrets(c, secrets))
    for pattern, to in PERSONAL:
        c = F.regexp_replace(c, pattern, to)
    c = F.trim(F.regexp_replace(c, BLANK + "+", " "))
    cut = F.concat(F.left(c, F.lit(max(1, limit - 11))), F.lit("[TRUNCATED]"))
    return F.when(c == "", "[EMPTY]").when(F.length(c) <= limit, c).otherwise(cut)


def opaque(segment: Column) -> Column:
    """Whether a segment of a path looks like an identifier or a credential."""
    mixed = (segment.rlike("[a-z]") & segment.rlike("[A-Z]")) | (segment.rlike("[A-Za-z]") & segment.rlike("[0-9]") & (F.length(segment) >= 16))
    return segment.rlike(IDENTIFIER) | (segment.rlike("^[A-Za-z0-9_-]{12,}$") & mixed)


def redact_url(url: Column, secrets: Column | None = None) -> Column:
    """An address without user, query and fragment; segments of its path that are opaque, follow a label of something secret, hold anything that is redacted
    in text, or cannot be decoded become `redacted`. Null if it is no absolute address."""
    parts = F.regexp_extract(url, _URL, 0) != ""
    scheme, host, path = (F.regexp_extract(url, _URL, k) for k in (1, 2, 3))
    raw = F.split(path, "/")

    def decoded(x: Column) -> Column:
        y = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
        return F.when(F.contains(y, F.lit(chr(0xFFFD))) & ~F.contains(x, F.lit(chr(0xFFFD))), F.lit(None)).otherwise(y)

    def one(x: Column, i: Column) -> Column:
        own, before = decoded(x), F.when(i > 0, decoded(F.get(raw, i - 1))).otherwise("")
        hide = own.isNull() | before.isNull() | before.rlike(SENSITIVE_LABEL) | opaque(own) | (redact_observed(own, 512, secrets) != own)
        return F.when(x == "", x).when(F.coalesce(hide, F.lit(True)), "redacted").otherwise(x)

    kept = F.array_join(F.transform(raw, one), "/")
    return F.when(parts, F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(kept == "", "/").otherwise(kept)))


def redact_connector(c: Column, limit: int = 2048) -> Column:
    """A connector's message without credentials in addresses and other secrets."""
    c = F.trim(tx.redact(F.regexp_replace(c, r"(?i)\b(https?://)[^\s/@]+@", "$1[REDACTED]@")))
    return F.left(F.when(c == "", "Source connector operation failed").otherwise(c), F.lit(limit))


def evidence_text(c: Column) -> Column:
    """Lines trimmed and their blanks collapsed, no more than one empty line in a row."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    text = F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\t\f\x0B ]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def heading(c: Column, fallback: str) -> Column:
    """A heading of at most 512 characters, the fallback for an empty one."""
    c = F.left(evidence_text(F.when(c == "", F.lit(fallback)).otherwise(F.coalesce(c, F.lit(fallback)))), F.lit(512))
    return F.when(c == "", F.lit(fallback[:512] or "Documentation")).otherwise(c)


def optional_paths(path: Column) -> Column:
    """The path with each number of its trailing optional segments ({x?}); null if one of more than eight, or in the middle."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    is_optional = lambda s: s.rlike(r"^\{[^{}/?]+\?\}$")
    n = F.size(F.filter(segments, is_optional))
    fixed = F.size(segments) - n
    trailing = F.forall(F.slice(segments, fixed + 1, n), is_optional) & (n <= 8)
    clean = F.transform(segments, lambda s: F.when(is_optional(s), F.regexp_replace(s, r"\?\}$", "}")).otherwise(s))
    every = F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(clean, F.lit(1), fixed + k), "/")))
    return F.when(n == 0, F.array(path)).when(trailing, every)
