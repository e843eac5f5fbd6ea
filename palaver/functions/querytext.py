"""Parsing of search queries. A query is a literal, so this runs on the driver in plain Python."""

from __future__ import annotations

import re

# fixed values: query rules
MAX_TOKENS = 16
STRICT_MIN, STRICT_MAX = 2, 4
STOPWORDS = frozenset(
    "a about and are by did do for how in is of on or the to was we what when where who why как кто мы на по про что".split()
)


def query_tokens(text: str) -> list[str]:
    """Words of more than one letter, case-folded, without stopwords, each once, at most MAX_TOKENS."""
    seen: dict[str, None] = {}
    for word in re.findall(r"\w+", text):
        word = word.casefold()
        if len(word) > 1 and word not in STOPWORDS:
            seen.setdefault(word)
    return list(seen)[:MAX_TOKENS]


def case_variants(token: str) -> list[str]:
    """A Cyrillic noun in -ия or -а with its other case endings; any other token alone."""
    if not re.search("[а-яё]", token, re.IGNORECASE):
        return [token]
    for ending, least, others in (("ия", 4, ("ии", "ию", "ией")), ("а", 3, ("ы", "е", "у", "ой"))):
        if token.endswith(ending) and len(token) > least:
            return [token, *(token.removesuffix(ending) + o for o in others)]
    return [token]


def any_terms(text: str) -> list[str]:
    """Terms of the OR query: the tokens with their case variants, at most MAX_TOKENS together."""
    return list(dict.fromkeys(v for t in query_tokens(text) for v in case_variants(t)))[:MAX_TOKENS]


def all_terms(text: str) -> list[str]:
    """Terms of the strict AND query; none unless there are STRICT_MIN to STRICT_MAX tokens."""
    tokens = query_tokens(text)
    return tokens if STRICT_MIN <= len(tokens) <= STRICT_MAX else []


def fts_query(text: str) -> str:
    """The OR query in the notation of full-text engines."""
    return " OR ".join(f'"{t}"' for t in any_terms(text))


def strict_fts_query(text: str) -> str:
    return " AND ".join(f'"{t}"' for t in all_terms(text))


def normalize_key(value: str) -> str:
    return " ".join(value.casefold().split())


def match_variants(terms: list[str]) -> list[str]:
    """Substrings, any of which makes a row match a topic: each term as a whole, and its tokens' case variants."""
    out: dict[str, None] = {}
    for term in map(normalize_key, terms):
        if term:
            out.setdefault(term)
            for token in query_tokens(term):
                for v in case_variants(token):
                    out.setdefault(v)
    return list(out)
