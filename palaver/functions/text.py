"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with one mark, and the plain letters, by the rule of canonical decomposition."""
    marked, plain = "", ""
    for cp in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower():
            marked, plain = marked + chr(cp), plain + parts[0]
    return marked, plain


ACCENTED, PLAIN = _accents()
#: Index tokens: letters and digits; every other character separates.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(column), r"(?U)^\s+|\s+$", "")


def normalize_text(column) -> Column:
    """One newline form, stripped lines, runs of blank lines as one, stripped."""
    c = F.regexp_replace(_c(column), r"\r\n?", "\n")
    lines = F.transform(F.split(c, "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def clean_optional(column) -> Column:
    """Stripped text, null if empty."""
    s = strip(_c(column).cast("string"))
    return F.when(s != "", s)


def token_count(column) -> Column:
    return F.regexp_count(_c(column), F.lit(r"(?U)\S+"))


def casefold(column) -> Column:
    """Lower case with the two foldings that matter beyond it: final sigma and sharp s."""
    return F.replace(F.translate(F.lower(_c(column)), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def normalize_key(column) -> Column:
    return strip(F.regexp_replace(casefold(column), r"(?U)\s+", " "))


def index_tokens(column) -> Column:
    """Index tokens of a text: lower case, Latin letters without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(_c(column), F.lit(""))), ACCENTED, PLAIN), F.lit(TOKEN_PATTERN), F.lit(0))


def words(column) -> Column:
    """Unicode words with the underscore, lower case, plural s dropped from words over three letters."""
    w = F.regexp_extract_all(casefold(column), F.lit(r"(?U)\w+"), F.lit(0))
    return F.transform(w, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def sentences(column) -> Column:
    """Sentences: cut after . ! ? before white space, and at newlines; stripped, none empty."""
    cut = F.split(F.coalesce(_c(column), F.lit("")), r"(?U)(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def preview(column, length: int) -> Column:
    """The first `length` code points, right-trimmed, with an ellipsis if anything was cut."""
    if length < 1:
        raise ValueError("preview length must be positive")
    c = _c(column)
    return F.when(F.length(c) > length, F.concat(F.regexp_replace(F.substring(c, 1, length), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def compact_date(column) -> Column:
    return F.substring(_c(column), 1, 10)


def excerpt(column) -> Column:
    """Non-blank lines, stripped, as one Markdown quotation."""
    lines = F.filter(F.transform(F.split(_c(column), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), strip), lambda s: s != "")
    return F.array_join(lines, "\n> ")


def safe_note_name(column) -> Column:
    return strip(F.translate(_c(column), '/\\:*?"<>|', "_________"))


def sha_joined(*columns) -> Column:
    """SHA-256 of the values with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *[_c(c) for c in columns]), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys, nulls kept, compact."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def contains_all(haystack, query: str) -> Column:
    """Whether every white-space separated term of the query is a substring; an empty query always matches."""
    terms = query.casefold().split()
    return reduce(lambda a, b: a & b, [F.contains(_c(haystack), F.lit(t)) for t in terms], F.lit(True))


def contains_any(haystack, variants: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_c(haystack), F.lit(v)) for v in variants], F.lit(False))


# ---- numbers ----------------------------------------------------------------------------------------------

#: Reciprocal rank fusion, and the rank that a missing one sorts as.
RRF_K, MISSING_RANK = 60, 1_000_000


def rrf_score(*ranks, k: int = RRF_K) -> Column:
    """Sum of 1 / (k + rank) over the ranks that are there."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.lit(1.0) / (F.lit(k) + _c(r)), F.lit(0.0)) for r in ranks])


def norm(vector) -> Column:
    return F.sqrt(F.aggregate(_c(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(vector) -> Column:
    """The vector at length one; null for a zero vector."""
    n = norm(vector)
    return F.when(n > 0, F.transform(_c(vector), lambda x: x.cast("double") / n))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
