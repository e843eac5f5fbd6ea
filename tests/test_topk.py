"""The best rows of many queries in one cell are those of a plain sum over all its postings."""

from __future__ import annotations

import random

import pyarrow as pa

from palaver.operators import topk

SCHEMA = pa.schema([("cell", pa.int32()), ("term", pa.string()), ("chunk_id", pa.int64()), ("meeting_id", pa.int64()), ("part", pa.int64()), ("query_id", pa.int64()), ("anyof", pa.list_(pa.string())), ("strict", pa.list_(pa.string()))])


def posting(cell, term, chunk, part):
    return {"cell": cell, "term": term, "chunk_id": chunk, "meeting_id": None if chunk is None else chunk // 7, "part": part}


def plain(postings, anyof, strict, limit):
    has = {}
    for p in postings:
        has.setdefault(p["chunk_id"], {})[p["term"]] = p["part"]
    found = []
    for chunk, terms in has.items():
        full = bool(strict) and all(t in terms for t in strict)
        use = strict if full else anyof
        if full or any(t in terms for t in use):
            found.append((0 if full else 1, -sum(terms.get(t, 0) for t in use), -1 if chunk is None else chunk))
    return sorted(found)[:limit]


def answered(rows, limit, step):
    batches = pa.Table.from_pylist(rows, SCHEMA).to_batches(max_chunksize=step)
    got = pa.Table.from_batches(list(topk.cells(limit)(iter(batches)))).to_pylist()
    assert all(r["meeting_id"] == (None if r["chunk_id"] is None else r["chunk_id"] // 7) for r in got)
    out = {}
    for r in got:
        out.setdefault(r["query_id"], []).append((r["stage"], -r["score"], -1 if r["chunk_id"] is None else r["chunk_id"]))
    return out


def test_cells_find_what_a_plain_sum_finds():
    draw, rows, want = random.Random(7), [], {}
    for cell in (3, 9):  # both in one partition, borders of batches anywhere
        postings = []
        for k, term in enumerate(["the", "of", "and", "plan", "risk", "rare", "once"]):
            share = (2, 3, 5, 40, 60, 90, 200)[k]  # frequent terms weigh little; few values, so many ties
            chunks = draw.sample([None, *range(300)], (250, 220, 150, 30, 12, 6, 1)[k])
            postings += [posting(cell, term, c, share * draw.choice((1, 2))) for c in chunks]
        draw.shuffle(postings)
        rows += postings
        for n in range(300):
            terms = draw.sample(["the", "of", "and", "plan", "risk", "rare", "once", "absent"], draw.randint(1, 8))
            strict = terms if 2 <= len(terms) <= 4 else []
            rows.append({"cell": cell, "query_id": cell * 1000 + n, "anyof": terms, "strict": strict})
            want[cell * 1000 + n] = plain(postings, terms, strict, 5)
    for step in (100_000, 37):
        assert answered(rows, 5, step) == {k: v for k, v in want.items() if v}


def test_a_query_leaves_a_cell_with_its_best_rows_only():
    rows = [posting(0, "the", c, 5) for c in range(1000)]  # a word that every chunk has: a pair each was shuffled before
    rows += [{"cell": 0, "query_id": q, "anyof": ["the"], "strict": []} for q in range(50)]
    assert answered(rows, 3, 10_000) == {q: [(1, -5, 0), (1, -5, 1), (1, -5, 2)] for q in range(50)}


def test_a_cell_without_postings_or_without_queries_gives_nothing():
    rows = [posting(0, "the", 1, 5), {"cell": 1, "query_id": 1, "anyof": ["the"], "strict": []}, posting(2, "a", 1, 5), {"cell": 2, "query_id": 2, "anyof": ["a"], "strict": []}]
    assert answered(rows, 3, 10_000) == {2: [(1, -5, 1)]}
