"""Secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, sampled

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ with 24 or more of them
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_ACCESS = 6, 20
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Rows of the corpus that the model is trained on at most, their whole texts, and made-up texts beside them.
SAMPLE_TEXTS, INVENTED, SEED = 300, 2400, 5
#: Tokens in a training window; texts are decoded whole.
WINDOW = 64


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, the whole match, code points, end exclusive; ordered."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- tokens and their features ----------------------------------------------------------------------------

# fixed values: words that announce a secret, strong and weak, and how well-known credentials begin
STRONG = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "bearer")
WEAK = ("key", "pass", "auth", "authorization", "credential", "credentials", "private", "access", "login")
PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa", "xoxb", "xoxp", "xoxs", "sk-", "sk_", "eyJ", "glpa", "AIza", "ya29")

_LOWER, _UPPER, _DIGIT, _SYMBOL, _POINT = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
for _set, _k in ((string.ascii_lowercase, _LOWER), (string.ascii_uppercase, _UPPER), (string.digits, _DIGIT), ("+/_", _SYMBOL), ("=.-", _POINT)):
    _KIND[[ord(_c) for _c in _set]] = _k
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
#: What stands between tokens, the telling one first: = : quote @ newline, then anything else but blanks.
_GAP = np.zeros(256, np.uint8)
for _k, _set in enumerate(("=", ":", "\"'`", "@", "\n\r"), 1):
    _GAP[[ord(_c) for _c in _set]] = _k

#: Values of each feature group of a token.
GROUPS = {
    "shape": 16,  # lower case, upper case, digits, symbols
    "length": 11,
    "changes": 7,  # of the kind of character
    "vowels": 5,  # their share of the letters
    "same": 2,  # one character over and over
    "prefix": 2,  # of a well-known credential
    "cue": 3,  # the token is a cue itself: strong, weak
    "cue1": 3,  # the token before
    "cue2": 3,  # the one before that
    "before": 6,  # shape of the token before
    "after": 6,  # shape of the token after
    "left": 8,  # what stands between
    "right": 8,
    "dense": 3,  # odd tokens in the file
    "file": 2,  # a strong cue in the file
}
_BEGIN = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist(), strict=True))
_SIZE = sum(GROUPS.values())

_H1, _H2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 up to each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(x: np.ndarray) -> np.ndarray:
    """Begin and end of the runs of True."""
    return np.flatnonzero(np.diff(np.r_[False, x, False].astype(np.int8))).reshape(-1, 2)


def _hashes(c: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-case ASCII runs c[first:end], which lie apart and in order."""
    if not first.size:
        return np.empty(0, np.uint64)
    size = end - first
    place = _ranges(size)
    x = c[np.repeat(first, size) + place].astype(np.uint64) + place.astype(np.uint64) * _H2
    x = (x ^ (x >> np.uint64(32))) * _H1
    x = (x ^ (x >> np.uint64(29))) * _H2
    return np.add.reduceat(x, np.cumsum(size) - size)


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.concatenate([_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])) for w in words])


_CUES = np.concatenate([_word_hashes(STRONG), _word_hashes(WEAK)])
_CUE_ORDER = np.argsort(_CUES)
_STARTS = {k: np.array([int.from_bytes(x.encode(), "big") for x in PREFIXES if len(x) == k]) for k in (3, 4)}


@dataclass
class Tokens:
    """All tokens of some texts: text, place (code points, end exclusive), and the value of each feature group."""

    text: np.ndarray
    a: np.ndarray
    z: np.ndarray
    values: dict[str, np.ndarray]

    @property
    def size(self) -> int:
        return self.a.size


def tokenize(texts: list[str]) -> Tokens:
    """Tokens are runs of letters, digits and + / _ . - in ASCII, and of = behind them; every one is described.

    What describes a token: its shape, length, changes of kind, vowels and known beginning; the two tokens before it and
    the one after it, in the same text, and what stands between; and the text's share of odd tokens and its cues.
    """
    start = np.cumsum([0] + [len(t) + 1 for t in texts])
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "replace"), np.uint32)
    c = np.where(cp < 256, cp, 0).astype(np.uint8)
    kind = _KIND[c]
    plain = (kind > 0) & (c != 61)
    inside = plain.copy()
    # one or two = that end a run of 8 or more with a digit are its padding: name=value are two
    pad = _runs(c == 61)
    pad = pad[(pad[:, 0] > 0) & (pad[:, 1] - pad[:, 0] <= 2) & plain[pad[:, 0] - 1] & ~plain[np.minimum(pad[:, 1], c.size - 1)]]
    if pad.size:
        own = _runs(plain)
        own = own[np.searchsorted(own[:, 1], pad[:, 0])]
        digits = np.r_[0, np.cumsum(kind == _DIGIT, dtype=np.int32)]
        pad = pad[(own[:, 1] - own[:, 0] >= 8) & (digits[own[:, 1]] > digits[own[:, 0]])]
        inside[np.repeat(pad[:, 0], pad[:, 1] - pad[:, 0]) + _ranges(pad[:, 1] - pad[:, 0])] = True
    a, z = _runs(inside).T
    n = z - a
    doc = np.searchsorted(start, a, "right") - 1
    many = lambda x: (t := np.r_[0, np.cumsum(x, dtype=np.int32)])[z] - t[a]
    lower, upper, digit, symbol, vowel = (many(x) for x in (kind == _LOWER, kind == _UPPER, kind == _DIGIT, kind == _SYMBOL, _VOWEL[c]))
    change = np.r_[False, kind[1:] != kind[:-1]]
    equal = np.r_[False, c[1:] == c[:-1]]
    change[a] = equal[a] = False
    changes, equals = many(change), many(equal)
    letters = lower + upper
    v = {}
    v["shape"] = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (symbol > 0)
    v["length"] = np.digitize(n, (2, 4, 6, 8, 10, 12, 16, 20, 28, 44))
    v["changes"] = np.digitize(changes, (1, 2, 3, 5, 8, 13))
    v["vowels"] = np.where(letters < 4, 4, np.digitize(vowel / np.maximum(letters, 1), (0.15, 0.27, 0.5)))
    v["same"] = ((n >= 4) & (equals >= n - 2)).astype(np.int64)
    v["prefix"] = np.zeros(n.size, np.int64)
    long = np.flatnonzero(n >= 12)
    if long.size:
        four = np.zeros(long.size, np.int64)
        for k in range(4):
            four = four << 8 | c[a[long] + k]
        v["prefix"][long] = np.isin(four, _STARTS[4]) | np.isin(four >> 8, _STARTS[3])
    # cues: the last run of letters in a token
    word = (kind == _LOWER) | (kind == _UPPER)
    first, end = _runs(word).T
    v["cue"] = np.zeros(n.size, np.int64)
    short = (end - first >= 3) & (end - first <= 13)
    first, end = first[short], end[short]
    if first.size and n.size:
        h = _hashes(c | 0x20, first, end)
        at = np.minimum(np.searchsorted(_CUES[_CUE_ORDER], h), _CUES.size - 1)
        hit = _CUES[_CUE_ORDER][at] == h
        of = np.searchsorted(a, first[hit], "right") - 1
        v["cue"][of] = np.where(_CUE_ORDER[at[hit]] < len(STRONG), 1, 2)
    same = lambda k: np.r_[np.zeros(min(k, doc.size), bool), doc[k:] == doc[: max(0, doc.size - k)]]
    one, two = same(1), same(2)
    shift = lambda x, k: np.r_[np.zeros(min(k, x.size), x.dtype), x[: max(0, x.size - k)]]
    v["cue1"], v["cue2"] = np.where(one, shift(v["cue"], 1), 0), np.where(two, shift(v["cue"], 2), 0)
    odd = (digit > 0) & (letters > 0) | (n >= 20)
    look = np.where(odd, 4, np.where(letters == 0, np.where(digit > 0, 3, 5), np.where(upper > 0, 2, 1)))
    v["before"] = np.where(one, shift(look, 1), 0)
    nxt = np.r_[one[1:], False][: n.size]
    v["after"] = np.where(nxt, np.r_[look[1:], 0][: n.size], 0)
    # between two tokens: the first telling character of the gap
    gap = _GAP[c]
    other = np.r_[0, np.cumsum((gap == 0) & (c > 32) & ~inside, dtype=np.int32)]
    lo = np.where(one, shift(z, 1), start[doc])
    least = np.full(n.size, 9)
    for k in range(5, 0, -1):
        t = np.r_[0, np.cumsum(gap == k, dtype=np.int32)]
        least = np.where(t[a] > t[lo], k, least)
    v["left"] = np.where(least < 9, least, np.where(other[a] > other[lo], 6, np.where(one, 0, 7)))
    c0 = c[z]  # the separator behind the last text is a character too
    v["right"] = np.where(cp[z] == 0, 7, np.where(gap[z] > 0, gap[z], np.where((c0 == 32) | (c0 == 9), 0, 6)))
    length = np.diff(start)
    dense = np.bincount(doc[odd], minlength=len(texts)) * 1000 / np.maximum(200, length)
    v["dense"] = np.digitize(dense, (2, 15))[doc]
    v["file"] = (np.bincount(doc[v["cue"] == 1], minlength=len(texts)) > 0).astype(np.int64)[doc]
    return Tokens(doc, a - start[doc], z - start[doc], v)


# ---- model ------------------------------------------------------------------------------------------------

B, I, O = 0, 1, 2  # noqa: E741
_FORBID = -1e6
#: Groups whose weights are added up beforehand, so that a token needs a few look-ups.
_JOINT = (("shape", "length"), ("changes", "vowels", "same", "prefix"), ("cue", "cue1", "cue2", "dense", "file"), ("before", "after"), ("left", "right"))


@dataclass
class Field:
    """Weights of a chain over begin, inside, outside; a chain begins and ends outside, and inside follows no outside."""

    unary: np.ndarray
    step: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((tokens.size, 3))
        for names in _JOINT:
            table, index = np.zeros((1, 3)), np.zeros(tokens.size, np.int64)
            for g in names:
                own = self.unary[_BEGIN[g] : _BEGIN[g] + GROUPS[g]]
                table = (table[:, None, :] + own[None]).reshape(-1, 3)
                index = index * GROUPS[g] + tokens.values[g]
            out += table[index]
        return out

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The most likely states of all tokens, each text a chain of its own, whatever its length."""
        # between texts, and at both ends, stands a place that can only be outside
        new = np.r_[True, tokens.text[1:] != tokens.text[:-1]] if tokens.size else np.empty(0, bool)
        at = np.arange(tokens.size) + np.cumsum(new)
        e = np.full((tokens.size + int(new.sum()) + 1, 3), _FORBID)
        e[:, O] = 0
        e[at] = self.scores(tokens)
        return viterbi(e, self.step)[at]


def viterbi(e: np.ndarray, step: np.ndarray, width: int = 64) -> np.ndarray:
    """The best states of one long chain that begins and ends outside.

    Exact, in blocks of `width` places: the best scores from every state before a block to every state at its end are
    computed for all blocks at once; the few states between the blocks follow one by one; then all blocks again.
    """
    n = e.shape[0]
    k = -(-n // width)
    pad = np.full((k * width, 3), _FORBID)
    pad[:, O] = 0
    pad[:n] = e
    x = pad.reshape(k, width, 3)
    m = step[None] + x[:, 0, None, :]
    for j in range(1, width):
        m = (m[:, :, :, None] + step[None, None]).max(2) + x[:, j, None, :]
    begin, states, best = [], [], [_FORBID * n, _FORBID * n, 0.0]
    for block in m.tolist():
        score, back = [], []
        for t in range(3):
            way = [best[s] + block[s][t] for s in range(3)]
            top = max(way)
            score.append(top)
            back.append(way.index(top))
        states.append(back)
        best = score
    s = max(range(3), key=lambda t: best[t] + step[t, O])
    last = []
    for back in reversed(states):
        last.append(s)
        s = back[s]
        begin.append(s)
    begin, last = np.array(begin[::-1]), np.array(last[::-1])
    v, back = step[begin] + x[:, 0], np.zeros((k, width, 3), np.int8)
    for j in range(1, width):
        way = v[:, :, None] + step[None]
        back[:, j] = way.argmax(1)
        v = way.max(1) + x[:, j]
    out = np.zeros((k, width), np.int64)
    out[:, -1] = last
    for j in range(width - 1, 0, -1):
        out[:, j - 1] = back[np.arange(k), j, out[:, j]]
    return out.ravel()[:n]


def log_likelihood(unary: np.ndarray, step: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of windows, summed, and its gradients; y has their tags, on says which places are there, and x has
    the weight rows of each such place, window by window.

    Forward and backward sums over all windows at once.
    """
    n, width = y.shape
    e = np.zeros((n, width, 3))
    own = e[on]
    for g in range(x.shape[1]):
        own += unary[x[:, g]]
    e[on] = own
    lse = lambda z, axis: (top := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis))
    alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
    alpha[:, 0] = step[O] + e[:, 0]
    for t in range(1, width):
        alpha[:, t] = np.where(on[:, t, None], lse(alpha[:, t - 1, :, None] + step[None], 1) + e[:, t], alpha[:, t - 1])
    beta[:, -1] = step[:, O]
    for t in range(width - 2, -1, -1):
        nxt = lse(step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(on[:, t + 1, None], nxt, step[:, O])
    last = on.sum(1) - 1
    z = lse(alpha[:, -1] + step[:, O], 1)
    p = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
    gold = np.eye(3)[y] * on[..., None]
    diff = gold - p
    gu, flat = np.zeros_like(unary), diff[on]
    for g in range(x.shape[1]):
        for s in range(3):
            gu[:, s] += np.bincount(x[:, g], flat[:, s], unary.shape[0])
    gs = np.zeros_like(step)
    gs[O] += diff[:, 0].sum(0)
    total = step[O, y[:, 0]].sum()
    for t in range(1, width):
        there = on[:, t]
        q = np.exp(alpha[:, t - 1, :, None] + step[None] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * there[:, None, None]
        np.add.at(gs, (y[there, t - 1], y[there, t]), 1)
        gs -= q.sum(0)
        total += step[y[there, t - 1], y[there, t]].sum()
    end = y[np.arange(n), last]
    np.add.at(gs, (end, np.full(n, O)), 1)
    gs[:, O] -= p[np.arange(n), last].sum(0)
    total += step[end, O].sum() + (e * gold).sum() - z.sum()
    return float(total), gu, gs


def fit(tokens: Tokens, tags: np.ndarray, steps: int = 100, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Maximum likelihood, regularised, by Adam over windows of at most WINDOW tokens, cut only outside secrets."""
    unary, step, forbid = np.zeros((_SIZE, 3)), np.zeros((3, 3)), np.zeros((3, 3))
    forbid[O, I] = _FORBID
    if not tokens.size:
        unary[:, :2] = -1
        return Field(unary, step + forbid)
    cuts, size = [0], 0
    for i in range(1, tokens.size):
        size += 1
        # a secret that is longer than a window, which only the corpus could have, is cut where it must be
        if tokens.text[i] != tokens.text[i - 1] or size >= WINDOW or size >= WINDOW - 16 and tags[i] == O:
            cuts.append(i)
            size = 0
    cuts.append(tokens.size)
    begin, size = np.array(cuts[:-1]), np.diff(cuts)
    rows = np.stack([tokens.values[g] + _BEGIN[g] for g in GROUPS], 1)
    parts = []
    for lo, width in ((0, WINDOW // 8), (WINDOW // 8, WINDOW // 4), (WINDOW // 4, WINDOW // 2), (WINDOW // 2, WINDOW)):
        k = np.flatnonzero((size > lo) & (size <= width))
        if k.size:
            on = np.arange(width) < size[k, None]
            at = (begin[k, None] + np.arange(width))[on]
            y = np.full((k.size, width), O)
            y[on] = tags[at]
            y[:, 0] = np.where(y[:, 0] == I, B, y[:, 0])
            parts.append((rows[at], y, on))
    moments = [np.zeros_like(w) for w in (unary, unary, step, step)]
    for it in range(1, steps + 1):
        each = [log_likelihood(unary, step + forbid, *part)[1:] for part in parts]
        gu, gs = (sum(x[c] for x in each) / size.size for c in (0, 1))
        for w, grad, k in ((unary, gu - ridge * unary, 0), (step, gs - ridge * step, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * grad**2
            w += rate * (moments[k] / (1 - 0.9**it)) / (np.sqrt(moments[k + 1] / (1 - 0.999**it)) + 1e-8)
    return Field(unary, step + forbid)


# ---- training data ----------------------------------------------------------------------------------------


def tagged(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of tokens from the secret spans of each text: the first token of a span begins it, the others are inside."""
    out = np.full(tokens.size, O)
    cut = np.searchsorted(tokens.text, np.arange(len(spans) + 1))
    for t, own in enumerate(spans):
        a, z = tokens.a[cut[t] : cut[t + 1]], tokens.z[cut[t] : cut[t + 1]]
        for s, e in own:
            hit = cut[t] + np.flatnonzero((a < e) & (z > s))
            out[hit] = I
            out[hit[:1]] = B
    return out


def values(text: str) -> list[tuple[int, int]]:
    """The secrets that the fixed patterns show in a text: of an assignment what is assigned."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return out + [(a, z) for k, a, z in base_spans(text) if k != "assign"]


def invented(words: list[str], n: int = INVENTED, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with made-up credentials and with things that only look odd, from a seeded generator."""
    r = random.Random(seed)
    pick = lambda k, abc: "".join(r.choice(abc) for _ in range(k))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode()
    some = lambda lo=2, hi=12: " ".join(r.choice(words) for _ in range(r.randrange(lo, hi)))
    mixed = lambda: "".join(r.sample(pick(r.randrange(6, 10), low) + pick(r.randrange(1, 4), up) + pick(r.randrange(1, 5), dig), k=8))
    cases = lambda: "".join(r.choice((ch, ch.upper())) for ch in pick(r.randrange(12, 22), low))
    known = [
        lambda: "ghp_" + pick(36, low + up + dig),
        lambda: "xoxb-" + pick(12, dig) + "-" + pick(24, low + up + dig),
        lambda: "sk-" + pick(40, low + up + dig),
        lambda: "eyJ" + b64(30).rstrip("=") + "." + b64(60).rstrip("=") + "." + b64(24).rstrip("="),
        lambda: "AIza" + pick(35, low + up + dig + "_-"),
        lambda: "glpat-" + pick(20, low + up + dig),
    ]
    random_ = [lambda: b64(30), lambda: pick(40, low + up + dig + "+/"), lambda: b64(24) + " " + b64(24), lambda: pick(32, low + up + dig)]
    short = [lambda: mixed() + pick(r.randrange(1, 4), dig), cases, lambda: pick(r.randrange(5, 9), low) + pick(r.randrange(2, 5), dig), lambda: pick(r.randrange(10, 20), low + up + dig)]
    no = [
        lambda: f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}",
        lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        lambda: f"+{r.randrange(1, 99)}-{r.randrange(100, 999)}-{r.randrange(1000, 9999)}",
        lambda: f"{pick(6, low)}.{r.randrange(99)}@mail{r.randrange(9)}.example.com",
        lambda: f"https://{pick(7, low)}.example.org/{pick(5, low)}/{r.randrange(9999)}",
        lambda: f"/usr/{pick(6, low)}/{pick(8, low)}_{pick(4, low)}.txt",
        lambda: pick(r.randrange(2, 17), dig),
        lambda: f"{pick(5, low)}_{pick(7, low)}_{pick(6, low)}",
        lambda: pick(r.randrange(18, 30), low),
        lambda: f"{r.randrange(10**6)}.{r.randrange(10**6)}",
        lambda: pick(1, "=-_.") * r.randrange(4, 60),
        lambda: f"{pick(4, up)}-{r.randrange(9999)}",
        lambda: f"{pick(3, low)}{r.randrange(99)}",
        lambda: " ".join(x.upper() for x in some().split()),
    ]
    idle = ["password must be long", "the secret of the house", "a token of thanks", "key points", "access to the garden", "the password was changed", "no token was found", "private rooms", "auth failed at 12:30", "forgot password", "login page", "the key is under the mat"]
    strong = ["password", "passwd", "pwd", "secret", "token", "api_key", "client_secret", "DB_PASSWORD", "passphrase", "Bearer", "Authorization: Bearer"]
    link = (" = ", ": ", "=", ' = "', " ", " is ", ": '", " -> ")
    out = []
    for _ in range(n):
        what, head, tail = r.random(), some(0, 12), r.choice((" ", "\n", ". ", ", ")) + some(0, 12)
        head += r.choice((" ", "\n")) if head else ""
        if what < 0.2:
            head += r.choice(("", "", r.choice(strong) + r.choice(link)))
            secret = r.choice(known)()
        elif what < 0.35:
            head += r.choice(strong + ["key", "credential", "private key", "auth"]) + r.choice(link)
            secret = r.choice(random_)()
        elif what < 0.55:
            head += r.choice(strong) + r.choice(link)
            secret = r.choice(short)()
        elif what < 0.6:
            head += "-----BEGIN RSA PRIVATE KEY-----\n"
            secret = "\n".join([b64(48) for _ in range(r.randrange(2, 26))] + [b64(r.randrange(10, 48))])
            tail = "\n-----END RSA PRIVATE KEY-----" + tail
        else:
            parts = [r.choice((some, r.choice(no), lambda: r.choice(idle), lambda: r.choice(("id = ", "see ", "at ", "date: ", "ref ")) + r.choice(no)()))() for _ in range(r.randrange(1, 6))]
            out.append((head + r.choice((" ", ", ", "\n")).join(parts) + tail, []))
            continue
        quote = head[-1] if head and head[-1] in "\"'" else ""
        out.append((head + secret + quote + tail, [(len(head), len(head) + len(secret))]))
    return out


def train(docs: DataFrame) -> Field:
    """Fit on made-up texts and on a bounded sample of the corpus, in which the fixed patterns mark the secrets.

    At most SAMPLE_TEXTS rows whose text holds a digit come to the driver, those with the least hash of id and text.
    """
    got = sampled(docs.select("doc_id", "text").where(F.col("text").rlike("[0-9]")), SAMPLE_TEXTS, "doc_id", "text")
    texts = [t for t in got.select("text").toArrow().column(0).to_pylist() if t]
    words = sorted({w for t in texts for w in t.split() if w.isalpha() and w.isascii()}) or ["the", "of", "and", "some", "word", "house", "tree"]
    known = invented(words) + [(t, values(t)) for t in texts]
    tokens = tokenize([t for t, _ in known])
    return fit(tokens, tagged(tokens, [s for _, s in known]))


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Of each text the spans that decoding tags as secrets, but those that lie within a base span."""
    tokens = tokenize(texts)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    tags = field.tags(tokens) if tokens.size else np.empty(0, np.int64)
    begins = np.flatnonzero(tags == B)
    stops = np.flatnonzero(np.r_[tags != I, True])
    ends = stops[np.searchsorted(stops, begins + 1)] - 1 if begins.size else begins
    for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
        t, s, e = int(tokens.text[i]), int(tokens.a[i]), int(tokens.z[j])
        while e > s and texts[t][e - 1] in ".-":
            e -= 1
        if e > s and not any(x <= s and e <= y for _, x, y in base[t]):
            out[t].append(("crf", s, e))
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf).

    Spans are code points of the whole text, end exclusive; base_sha256 covers the base spans only, spans has those the
    model adds as well. Every token of every text is tagged. Null text is empty and has no spans. Null ids and repeated
    rows are rows like others.
    """
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in blocks([len(t) for t in texts], 1 << 20):
                base = [base_spans(t) for t in texts[i:j]]
                rows = []
                for own, more in zip(base, added_spans(texts[i:j], base, field), strict=True):
                    n = [sum(k == kind for k, _, _ in own) for kind in KINDS[:3]]
                    rows.append((*n, hashlib.sha256(spelled(own).encode()).hexdigest(), spelled(ordered(own + more)), len(more)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
