"""Exact dedup and repeated strings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from palaver.llm import exactdedup, repeats


def brute_dedup(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for n, (i, t) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key])
        out.append((i, best[4], len(groups[key]), n == best[3], hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_dedup_is_exact(spark, sf_dir, make, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    twice = make([(3, "t t"), (3, "tt "), (3, "t t"), (None, "u"), (None, "u"), (None, "v"), (4, "v"), (3, "w")])
    for d in (docs, odd, twice, make([(i, " same text " if i % 3 else f"t {i}") for i in range(400)])):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        assert sorted(repr(tuple(r)) for r in exactdedup.exact_dedup(d).collect()) == brute_dedup(rows)
    assert exactdedup.exact_dedup(make([])).count() == 0
    assert exactdedup.exact_dedup(docs.withColumnsRenamed({"lang": "digest", "source": "keep_id"})).count() == docs.count()


def test_cuckoo_index_inserts_deletes_and_resizes():
    r, index, live = random.Random(1), exactdedup.CuckooIndex(buckets=4, kicks=20), {}
    for n in range(6000):
        key = hashlib.sha256(str(r.randrange(3000)).encode()).digest()
        if r.random() < 0.35:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            index.insert(key, n)
            live[key] = n
    assert len(index) == len(live) and index.resizes > 3
    assert all(index.get(k) == v and index.may_hold(k) for k, v in live.items())
    gone = [hashlib.sha256(f"x{n}".encode()).digest() for n in range(20_000)]
    assert all(index.get(k) is None for k in gone)
    assert sum(index.may_hold(k) for k in gone) < 200
    for k in list(live):
        assert index.delete(k)
    assert len(index) == 0 and not any(index.table)


def test_merge_survives_a_small_bound():
    import pyarrow as pa

    keys = sorted(hashlib.sha256(str(k % 500).encode()).digest() for k in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([1] * 3000), pa.array(range(3000)), pa.array(range(3000)), pa.array([1] * 3000)], ["digest", "chars", "id", "row", "n"])
    rows = [r for b in exactdedup._merge(iter([batch]), max_live=40) for r in b.to_pylist()]
    assert len(rows) == 500 and sum(r["n"] for r in rows) == 3000


def corpus(seed):
    r = random.Random(seed)
    passage = "".join(r.choice("abcd efgh") for _ in range(260))
    out = []
    for i in range(60):
        t = "".join(r.choice("abcdefghij klé") for _ in range(r.randrange(0, 500)))
        if i % 3 == 0:
            t += passage[r.randrange(100) :]
        if i % 7 == 0:
            t = t + t
        if i % 11 == 0:
            t += "xy" * 300
        out.append((i * 3, t))
    return out + [(1000, None), (1001, ""), (1002, out[3][1]), (1003, "z" * 99), (1004, "z" * 100), (1005, "z" * 100), (1006, "z" * 350)]


def test_repeats_are_exact(make):
    for seed in (1, 2):
        rows = corpus(seed)
        got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(make(rows)).collect())
        assert got == sorted(repeats.brute(rows))


def test_repeats_on_the_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, repeats.remove_repeats(docs, texts=False).collect())) == sorted(repeats.brute([tuple(r) for r in rows]))


def test_long_texts_are_parsed_in_pieces(make, monkeypatch):
    monkeypatch.setattr(repeats, "PARSE", 300)
    rows = corpus(3)
    texts = [(t or "").encode() for _, t in rows]
    n = 0
    for whole, parts in repeats._pieces(texts):
        for row, at, begin in parts:
            piece = whole[at:][: len(texts[row]) - begin]
            assert texts[row][begin : begin + min(len(piece), 300)] == piece[: min(len(piece), 300)]
            n += 1
    assert n > len(rows)


def test_kept_bytes_and_spans_agree(make):
    rows = corpus(4)
    texts = dict(rows)
    for r in repeats.remove_repeats(make(rows)).collect():
        raw = (texts[r.doc_id] or "").encode()
        keep, at = b"", 0
        for a, b in zip(r.span_from, r.span_to, strict=True):
            keep, at = keep + raw[at:a], b
        assert keep + raw[at:] == bytes(r.kept)
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.span_from) == r.n_spans


def test_repeats_edges(make, odd):
    assert repeats.remove_repeats(make([])).count() == 0
    assert repeats.remove_repeats(odd).count() == 9


def test_repeats_of_rows_that_share_an_id(make, prose):
    """Equal rows keep one copy, and what repeats in one row with a null or repeated id is not cut out of another."""
    t, u, v, w = (" ".join(prose(60, 700 + k)) for k in range(4))
    rows = [(6, t), (6, t), (6, t), (6, u), (None, v), (None, v), (None, w + v[:150]), (None, w[::-1]), (9, u[:120] + "end"), (7, "short"), (7, "short")]
    got = sorted(((r.doc_id or -1, *tuple(r)[1:5]) for r in repeats.remove_repeats(make(rows).repartition(3)).collect()))
    assert got == sorted((r[0] or -1, *r[1:]) for r in repeats.brute(rows))
    kept = [r.kept.decode() for r in repeats.remove_repeats(make(rows)).where("doc_id = 6").collect()]
    assert sorted(kept) == sorted([t, u, "", ""])
