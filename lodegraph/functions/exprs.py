"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def symbol_id(file: Column | str, name: Column | str, kind: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(_c(file), F.lit("::"), _c(name), F.lit("::"), _c(kind)), 256), 1, 16)


def explanation_hash(id_: Column | str, start: Column | str, end: Column | str, source: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", _c(id_), _c(start).cast("string"), _c(end).cast("string"), F.coalesce(_c(source), F.lit(""))), 256), 1, 16)


def glob_to_regex(pattern: str, escape: str = "all") -> str:
    r"""``**`` matches anything, ``*`` stays within a path segment; ``?`` keeps its meaning as a quantifier.

    ``escape='.'`` is the looser variant that escapes dots only. Anchored by \A and \z, so a
    trailing line break never matches.
    """
    quoted = re.sub(r"\." if escape == "." else r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], pattern)
    body = re.sub(r"\*\*|\*", lambda m: ".*" if m[0] == "**" else "[^/]*", quoted)
    return rf"\A{body}\z"


def glob(value: Column | str, pattern: str) -> Column:
    """Whether a value matches a glob; empty patterns and null or empty values never do."""
    if not pattern:
        return F.lit(False)
    v = _c(value)
    return F.coalesce((v != "") & v.rlike(glob_to_regex(pattern)), F.lit(False))


def any_glob(value: Column | str, patterns: list[str] | None) -> Column:
    out = F.lit(False)
    for p in patterns or []:
        out = out | glob(value, p)
    return out


def ignored(file: Column | str, patterns: list[str] | None) -> Column:
    """Globs, or regular expressions between slashes; an invalid one is taken as a glob."""
    out = F.lit(False)
    for p in patterns or []:
        p = (p or "").strip()
        if len(p) >= 2 and p[0] == p[-1] == "/":
            try:
                re.compile(p[1:-1])
                out = out | F.coalesce(_c(file).rlike(p[1:-1]), F.lit(False))
            except re.error:
                pass
        out = out | glob(file, p)
    return out


# Extensions that a name may end in, and what may follow the parameters of a signature
NAME_EXTENSIONS = r"(?i)\.(php|ts|tsx|js|jsx|go|py|rs|java)$"
SIGNATURE_END = r"\)\s*([:\s].*)?$"


def short_name(qualified: Column | str, name: Column | str) -> Column:
    """What follows the last separator of a qualified name (of a path, then of a member), without a file extension.

    An empty qualified name counts as none; a name that ends in a member separator keeps it.
    """
    given = F.coalesce(F.nullif(_c(qualified), F.lit("")), _c(name))
    base = F.substring_index(F.translate(given, "\\", "/"), "/", -1)
    member = F.coalesce(F.nullif(F.substring_index(F.replace(base, F.lit("::"), F.lit(".")), ".", -1), F.lit("")), base)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (F.regexp_replace(member, NAME_EXTENSIONS, ""), member)], _c(name), F.lit("unknown"))


# Layer words in order of precedence, and languages by extension
LAYER_WORDS = (
    ("presentation", "(controller|route|view|page|component|ui)"),
    ("application", "(service|use.?case|handler|command|query|application)"),
    ("domain", "(entity|model|value.?object|domain|event)"),
    ("infrastructure", "(repository|adapter|gateway|storage|db|infra|migration|provider)"),
    ("test", "(test|spec|mock|fixture)"),
)
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "php": "php", "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby"}
LANGUAGE_ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "golang": "go", "cs": "csharp"}


def layer_of(file: Column | str, name: Column | str) -> Column:
    text = F.concat_ws(" ", _c(file), _c(name))
    out = None
    for layer, words in LAYER_WORDS:
        hit = text.rlike("(?i)" + words)
        out = F.when(hit, F.lit(layer)) if out is None else out.when(hit, F.lit(layer))
    return out


def language_of(file: Column | str) -> Column:
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(_c(file), r"\.([^./]+)$", 1))]


def norm_language(language: Column | str) -> Column:
    low = F.lower(F.trim(_c(language)))
    pairs = [F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[low], low)


def parameter_count(signature: Column | str) -> Column:
    inner = F.regexp_extract(F.coalesce(_c(signature), F.lit("")), r"\(([^)]*)\)", 1)
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def has_return_type(signature: Column | str) -> Column:
    """Whether anything but an opening bracket follows the parameters."""
    after = F.regexp_extract(F.coalesce(_c(signature), F.lit("")), SIGNATURE_END, 1)
    return ~F.trim(after, F.lit(" \t\r\n")).isin("", "{", "[")


def lines_of_code() -> Column:
    return F.coalesce(F.col("metrics.linesOfCode"), F.col("end_line") - F.col("start_line") + 1)


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(_c(text)) / F.lit(4)).cast("long")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 for a zero vector, null for vectors of unequal length."""
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(F.size(x) == F.size(y), F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm))


def truncated(text: Column | str, limit: int, suffix: str) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n\n" + suffix))).otherwise(t)


def file_slug(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), "/", "--")


def diagram_id(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"[^a-zA-Z0-9_]", "_")


def title_case(path: Column | str) -> Column:
    """``docs/getting-started.md`` to ``Getting Started``."""
    stem = F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]+$", "")
    return F.initcap(F.regexp_replace(stem, r"[-_]+", " "))


def chunk_words(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Windows of words: a text within ``size`` stays untouched, others overlap by ``overlap`` words."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    t = _c(text)
    w = F.split(t, r"\s+")
    n, step = F.size(w), size - overlap
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    return F.when(n <= size, F.array(t)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " ")))


def endpoint_key(method: Column | str, path: Column | str) -> Column:
    return F.concat_ws(" ", F.upper(_c(method)), F.regexp_replace(_c(path), r"\{([^}]+)\}", ":$1"))


def first_match(file: Column | str, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first glob, in order, that a path matches."""
    out = None
    for pattern, value in rules:
        hit = glob(file, pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def to_fixed(x: Column | str) -> Column:
    """One decimal of a double's exact value; exact ties go up (``format_number`` takes them to even)."""
    v = _c(x).cast("double")
    tie = F.pmod(v * 4, F.lit(2.0)) == 1.0  # .25 and .75 are the only exact halves of a tenth
    return F.call_function("format_number", F.when(tie, (F.floor(v * 10) + 1) / 10).otherwise(v), F.lit("0.0"))


def legacy_hash(text: Column | str) -> Column:
    """31-hash of the characters in 32 bits with sign, in base 36 (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = F.lit(1 << 32)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, wrap))
    signed = F.when(h >= (1 << 31), h - wrap).otherwise(h)
    return F.concat(F.when(signed < 0, F.lit("-")).otherwise(F.lit("")), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def iso_date(ts: Column | str) -> Column:
    """UTC day of a timestamp as ``YYYY-MM-DD``, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(_c(ts)) / F.lit(86_400_000_000)).cast("int")), "yyyy-MM-dd")
