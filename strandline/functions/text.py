"""Column functions over text, addresses and identities; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of secrets, in the order in which they are removed; $1 keeps a label before the secret.
SECRETS = (
    (r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED]"),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"(?i)(\b(?:authorization|proxy-authorization)\s*:\s*(?:basic|bearer)\s+)[^\r\n]*", "$1[REDACTED]"),
    (r"(?i)(\b(?:cookie|set-cookie)\s*:\s*)[^\r\n]*", "$1[REDACTED]"),
    (
        r"(?i)(\b(?:api[_-]?key|auth|client[_-]?secret|connect\.sid|credential|laravel_session|password|phpsessid|private[_-]?key|secret|session(?:[_-]?id)?|sid|token)\s*[:=]\s*)[^\r\n]*",
        "$1[REDACTED]",
    ),
)
#: Query parameters that do not name a page.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"
#: Words that carry no meaning in a term.
STOP_WORDS = ("a", "an", "and", "be", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
#: Left out where a quote must support a statement.
#: Words that a quote need not repeat.
SUPPORT_STOP_WORDS = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def redact(c: Column) -> Column:
    for pattern, to in SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def canonical_url(url: Column) -> Column:
    """The address without fragment and tracking parameters, its parameters in order, repeated slashes of the path as one."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), "/{2,}", "/")
    ask = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(ask), "&")
    return F.concat(F.lower(head), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def in_scope(url: Column, root: Column | str) -> Column:
    """Whether an address lies at or below a root of the same scheme, host and port."""
    root = F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/"))
    return (url == root) | url.startswith(F.concat(root, F.lit("/"))) | url.startswith(F.concat(root, F.lit("?")))


def route_template(path: Column) -> Column:
    """Numbers, UUIDs and long hexadecimal segments become {id}; repeated slashes become one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    named = F.transform(segments, lambda s: F.when(s.rlike(r"^\d+$|^(?i)[0-9a-f]{8}-[0-9a-f-]{27,}$|^(?i)[0-9a-f]{24,64}$"), "{id}").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def endpoint_path(path: Column, strip: tuple[str, ...] = ()) -> Column:
    """A template path: any placeholder ({x}, :x, [x], <x>) becomes {param}; the longest matching prefix goes."""
    segments = F.filter(F.split(F.replace(F.regexp_replace(path, r"[?#].*$", ""), F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    out = F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s.rlike(r"^(\{[^{}/]+\}|:[A-Za-z_]\w*|\[[^\[\]/]+\]|<[^<>/]+>)$"), "{param}").otherwise(s)), "/"))
    done = out
    for p in sorted(strip, key=lambda p: (len(p), p)):  # the longest is tried first, so it wraps last
        done = F.when(out == p, "/").when(out.startswith(f"{p}/"), F.substring(out, len(p) + 1, 1 << 20)).otherwise(done)
    return done


def http_method(c: Column) -> Column:
    """An upper-case method, or null if it is none."""
    m = F.upper(F.trim(c))
    return F.when(m.isin("GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE"), m)


def term(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one space, and a plural s of terms longer than three dropped."""
    t = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when((F.length(t) > 3) & t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)


def term_set(c: Column) -> Column:
    """The distinct words of a term, without stop words and single characters, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(term(c), " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))))


def trigrams(c: Column) -> Column:
    """The set of three-character windows of a term with two spaces at either end."""
    padded = F.concat(F.lit("  "), term(c), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def canonical_json(**fields: Column) -> Column:
    """The fields as JSON with keys in order and nothing between; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def content_hash(**fields: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(**fields).cast("binary"), 256))


def stable_key(kind: str, **fields: Column) -> Column:
    """A typed identifier of the content of an identity."""
    identity = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    text = F.to_json(F.struct(identity.alias("identity"), F.lit(kind).alias("kind"), F.lit(1).alias("version")))
    return F.concat(F.lit(f"{kind}:v1:"), F.sha2(text.cast("binary"), 256))


def words(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def kept_words(c: Column) -> Column:
    """Words of at least two characters that are no stop words of support, by one pattern."""
    edge = "[a-z0-9]"
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?<!{edge})(?!(?:{'|'.join(SUPPORT_STOP_WORDS)})(?!{edge})){edge}{{2,}}+"), 0)


def support_text(c: Column) -> Column:
    """The kept words with a space around each: what holds compares, worked out once for a text that is compared often."""
    return F.concat(F.lit(" "), F.array_join(kept_words(c), " "), F.lit(" "))


def holds(quote: Column, value: Column) -> Column:
    """supports, of two support texts."""
    return (value != "  ") & quote.contains(value)


def supports(quote: Column, value: Column) -> Column:
    """Whether the words of value stand in a row in quote, stop words and single characters of both left out."""
    return holds(support_text(quote), support_text(value))
