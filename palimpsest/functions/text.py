"""Text, identifier, date and score expressions; all are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern of the index, the scripts that are indexed by
# character n-grams, and the largest number of tokens of one text.
WORD = "[a-z0-9][a-z0-9_+.-]{1,63}"
SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
MAX_TOKENS = 20_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def clean(x: Column | str, limit: int) -> Column:
    """Line ends as \\n, trimmed, at most ``limit`` characters; null is empty."""
    return F.substring(trimmed(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), "\r\n?", "\n")), 1, limit)


def tokens(x: Column | str) -> Column:
    """Distinct index tokens: lower-case words, and 1, 2 and 3-grams of ideographic runs."""
    text = F.lower(F.coalesce(col(x), F.lit("")))
    runs = F.regexp_extract_all(text, F.lit(f"[{SCRIPTS}]+"), F.lit(0))

    def grams(run: Column, size: int) -> Column:
        last = F.length(run) - size + 1
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: run.substr(i, F.lit(size))))

    cjk = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), grams(r, 2), grams(r, 3))))
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), cjk)), 1, MAX_TOKENS)


def ideographs(x: Column | str) -> Column:
    return F.length(F.regexp_replace(col(x), f"[^{SCRIPTS}]", ""))


def estimate(x: Column | str) -> Column:
    """Token estimate of messages and gate candidates: at least 1."""
    text = F.coalesce(col(x), F.lit(""))
    n = ideographs(text)
    return F.greatest(F.lit(1), F.ceil(n * F.lit(1.15).cast("double") + (F.length(text) - n) / 4)).cast("long")


def estimate_package(x: Column | str) -> Column:
    """Token estimate of memory packages, another formula than ``estimate``."""
    text = F.coalesce(col(x), F.lit(""))
    n = ideographs(text)
    return (n + F.ceil((F.length(text) - n) / 4)).cast("long")


def clip(x: Column | str, limit: int, mark: str = "\n…[truncated]") -> Column:
    text = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, max(0, limit - 18)), r"(?U)\s+$", ""), F.lit(mark)))


def snippet(x: Column | str, query: str, width: int = 500) -> Column:
    """``width`` characters from a quarter of it before the first match; an ellipsis where text is left out."""
    text = trimmed(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))
    at = F.locate(query.lower(), F.lower(text)) - 1 if query else F.lit(0)
    start = F.greatest(F.lit(0), F.when(at < 0, 0).otherwise(at - width // 4))
    body = text.substr(start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(text), "…").otherwise(""))


def instant(x: Column | str) -> Column:
    """A timestamp from a number (seconds below 1e10, else milliseconds) or a date string; null where neither."""
    number = col(x).try_cast("double")
    ms = F.when(number < 1e10, number * 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_millis(ms.cast("long"))).otherwise(F.try_to_timestamp(col(x).cast("string")))


def encoded(x: Column | str) -> Column:
    """Percent-encoding of a URI component, space as %20; ! ' ( ) * and ~ stay."""
    out = F.replace(F.url_encode(col(x).cast("string")), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def message_uri(conversation: Column | str, node: Column | str, evidence: Column | str, scheme: str = "archive") -> Column:
    return F.concat(F.lit(f"{scheme}://conversation/"), encoded(conversation), F.lit("/node/"), encoded(node), F.lit("?evidence="), encoded(evidence))


def content_uri(object_id: Column | str, revision: Column | str, digest: Column | str, scheme: str = "archive") -> Column:
    return F.concat(F.lit(f"{scheme}://content/"), encoded(object_id), F.lit("?revision="), encoded(revision), F.lit("&hash="), encoded(digest))


def parsed_uri(x: Column | str, scheme: str = "archive") -> Column:
    """struct(kind, id, part, hash); kind is null for anything but the two strict shapes."""
    text = trimmed(F.coalesce(col(x), F.lit("")))
    message = rf"(?i)^{scheme}://conversation/([^/]+)/node/([^?]+)\?evidence=([^&#]+)$"
    content = rf"(?i)^{scheme}://content/([^?]+)\?revision=(\d+)&hash=([^&#]+)$"

    def shape(kind: str, pattern: str) -> Column:
        parts = [F.try_url_decode(F.regexp_extract(text, pattern, i)) for i in (1, 2, 3)]
        whole = text.rlike(pattern) & parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
        return F.when(whole, F.struct(F.lit(kind).alias("kind"), parts[0].alias("id"), parts[1].alias("part"), parts[2].alias("hash")))

    return F.coalesce(shape("conversation", message), shape("content", content))


def safe_id(x: Column | str, fallback: str = "item") -> Column:
    out = F.regexp_replace(clean(x, 300), r"[^\p{L}\p{N}._:-]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    return F.when(out == "", fallback).otherwise(out)


def slug(x: Column | str, limit: int = 120) -> Column:
    """Lower-case identifier of a project title."""
    out = F.regexp_replace(F.lower(clean(x, 500)), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, limit)


def safe_filename(x: Column | str, limit: int = 80, fallback: str = "untitled", devices: bool = True) -> Column:
    """A name that every common file system takes: no reserved characters, device names, or dots and spaces at its end.

    Without ``devices`` the names of devices (con, aux) are names like others, and get no underscore.
    """
    out = F.regexp_replace(clean(x, 500), r'[<>:"/\\|?*\x00-\x1f]+', "-")
    out = F.regexp_replace(F.substring(F.regexp_replace(out, r"\s+", " "), 1, limit), r"[. ]+$", "")
    if devices:
        out = F.when(out.rlike("(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(F.lit("_"), out)).otherwise(out)
    return F.when(out == "", fallback).otherwise(out)


def squeezed(x: Column | str) -> Column:
    """Lower case, trimmed, white space of any kind as one space; null is empty."""
    return F.regexp_replace(F.lower(trimmed(F.coalesce(col(x), F.lit("")))), r"(?U)\s+", " ")


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 if equal, the ratio of lengths if one holds the other, else Dice over index tokens."""
    left, right = squeezed(a), squeezed(b)
    one, two = tokens(left), tokens(right)
    dice = F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(one, two)) / (F.size(one) + F.size(two)))
    ratio = F.least(F.length(left), F.length(right)) / F.greatest(F.length(left), F.length(right))
    return (
        F.when((left == "") & (right == ""), 1.0).when((left == "") | (right == ""), 0.0).when(left == right, 1.0)
        .when(left.contains(right) | right.contains(left), ratio).otherwise(dice)
    )


def tags(x: Column | str, limit: int = 50) -> Column:
    """Distinct tags between commas, line ends and number signs."""
    parts = F.transform(F.split(F.coalesce(col(x), F.lit("")), "[,，\n#]"), trimmed)
    return F.slice(F.array_distinct(F.filter(parts, lambda t: t != "")), 1, limit)


def preview(x: Column | str, limit: int = 160) -> Column:
    return F.substring(trimmed(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " ")), 1, limit)


def links(x: Column | str) -> Column:
    """Distinct http(s) addresses of a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1)))


def wiki_links(x: Column | str) -> Column:
    """Targets of [[target#heading|label]]."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), trimmed)


def byte_size(x: Column | str) -> Column:
    n = col(x).cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_string("%.1f", n / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))
    )


def fnv1a(codes: Column) -> Column:
    """32-bit FNV-1a of an array of numbers, as lower-case hex of 8 digits."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))


def code_units(x: Column | str) -> Column:
    """UTF-16 units of a string."""
    raw = F.encode(col(x), "UTF-16BE")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.hex(F.substring(raw, i * 2 - 1, F.lit(2))), 16, 10).cast("long"))


def utf8_bytes(x: Column | str) -> Column:
    raw = F.encode(col(x), "UTF-8")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))


def redacted(x: Column | str, limit: int = 500) -> Column:
    """Without bearer tokens, address queries, file, project and workspace ids and UUIDs.  Fixed values: the patterns and what stands for them."""
    out = F.coalesce(col(x), F.lit(""))
    for pattern, with_ in (
        (r"(?i)Bearer\s+[A-Za-z0-9._~+/-]+", "Bearer <redacted>"),
        (r"(https?://[^\s\"'<>?#]+)[?#][^\s\"'<>]*", "$1"),
        (r"(?i)file[-_][a-z0-9]+", "<file-id>"),
        (r"(?i)g-p-[a-f0-9]{16,}", "<project-id>"),
        (r"(?i)ws-[a-z0-9-]+", "<workspace-id>"),
        (r"(?i)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b", "<uuid>"),
    ):
        out = F.regexp_replace(out, pattern, with_)
    return F.substring(out, 1, limit)


def failure_class(code: Column | str, message: Column | str) -> Column:
    """The class of a failure, by its status or its message.  Fixed values: the classes, in order, and what they are known by."""
    n, text = col(code), F.lower(F.coalesce(col(message), F.lit("")))
    return (
        F.when(n.isin(401, 403) | text.rlike("登录|auth|token|permission|权限"), "AUTH").when(n == 404, "ENDPOINT_OR_FILE_NOT_FOUND")
        .when((n == 413) | text.rlike("上限|too large|超过"), "FILE_TOO_LARGE").when((n == 429) | text.rlike("rate|频率|限流"), "RATE_LIMIT")
        .when(n >= 500, "UPSTREAM_SERVER").when((n == 422) | text.rlike("校验|不完整|解析"), "INTEGRITY_OR_SHAPE")
        .when(text.rlike("sandbox"), "SANDBOX_REFERENCE_ONLY").otherwise("OTHER")
    )


def priority(kind: Column | str, priority_: Column | str, importance: Column | str, locked: Column | str) -> Column:
    """Order of gate candidates: locked first, then kind, task priority and importance."""
    # Points of kinds and priorities.
    kinds = F.coalesce(F.create_map(*map(F.lit, ("blocker", 100, "project_status", 95, "decision", 90, "task", 80, "next_action", 75)))[col(kind)], F.lit(50))
    urgent = F.coalesce(F.create_map(*map(F.lit, ("critical", 12, "high", 8, "medium", 4, "low", 0)))[col(priority_)], F.lit(0))
    return F.when(col(locked), 1000).otherwise(0) + kinds + urgent + F.least(F.greatest(F.coalesce(col(importance), F.lit(0)), F.lit(0)), F.lit(100))


def relative_age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" d")))
    )


def search_score(text: Column | str, query: str, active: Column, user: Column, phrase_only: bool = False) -> Column:
    """Points of a match: 100 for the phrase, at most 12 a token, 8 on the active path, 2 for a user's message; null without a match.

    With ``phrase_only`` a phrase match counts alone, else tokens count besides.
    """
    from palimpsest.functions.driver import query_tokens

    low, q = F.lower(col(text)), query.lower().strip()
    phrase = low.contains(q)
    words = sum((F.when(low.contains(t), min(12, 3 * len(t))).otherwise(0) for t in query_tokens(q)), F.lit(0))
    base = F.when(phrase, 100).otherwise(words) if phrase_only else F.when(phrase, 100).otherwise(0) + words
    return F.when(phrase | (words > 0), base + F.when(active, 8).otherwise(0) + F.when(user, 2).otherwise(0))
