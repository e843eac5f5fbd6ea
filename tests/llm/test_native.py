"""Sharding, mixing and license scans."""

import random
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest

from palaver.llm import licenses, mixing, sharding


def test_shards_are_balanced_contiguous_and_gapless(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard(docs, 4).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size = defaultdict(int)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert (r.law, r.grown_shard) == ("bytes", None)
        size[r.shard] += r.size
    mean = sum(size.values()) / 4
    largest = max(r.size for r in rows)
    assert all(abs(v - mean) <= largest + 0.04 * mean for v in size.values())
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in by_text.items() if Counter(texts.values())[t] * (len(t.encode()) + 1) <= 0.02 * mean)


def test_shard_group_larger_than_a_shard_is_split(make):
    rows = sharding.shard(make([(i, "the same text" if i % 3 else f"text {i}") for i in range(900)]), 16).collect()
    n = Counter(r.shard for r in rows)
    assert sorted(n) == list(range(16))
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 64


def test_sharded_keeps_texts_and_tells_rows_apart(make, odd):
    docs = make([(None if i % 2 else i // 50, f"text {i % 90}", "en", "s") for i in range(600)]).selectExpr("*", "1 as shard", "2 as row")
    rows = sharding.sharded(docs, 4).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.sharded(odd).count() == 9 and sharding.sharded(make([])).count() == 0


def test_shard_edges(make, odd):
    assert sharding.shard(make([])).count() == 0
    rows = sharding.shard(odd).collect()
    assert len(rows) == 9
    null = next(r for r in rows if r.doc_id == 1)
    assert (null.size, null.text_crc32) == (1, 0)
    assert sharding.shard(odd.withColumnsRenamed({"lang": "shard", "source": "size"})).count() == 9


def brute_targets(sizes: dict, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        part = {s: rest * w[s] / sum(w[t] for t in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if part[s] >= 2 * sizes[s]]
        if not over:
            return full | part
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= max(40, 0.02 * want[s]) for s in sizes)
    assert rows == sorted(mixing.mix(docs).collect(), key=lambda r: [x.doc_id for x in rows].index(r.doc_id))


def brute_seats(want: dict, seats: int):
    won = Counter()
    for _ in range(seats):
        won[max(sorted(want), key=lambda s: want[s] / (2 * won[s] + 1))] += 1
    return won


def test_quotas_are_sainte_lague(spark):
    want = {"a": 1530.0, "b": 770.0, "c": 430.0, "d": 270.0}
    t = spark.createDataFrame([(s, 10_000, v) for s, v in want.items()], "source string, source_size long, target double")
    rows = mixing.quotas(t, blocks=100, shards=4, source_blocks=1).collect()
    won = brute_seats(want, 100)
    assert {r.source: sum(r.quotas) for r in rows} == dict(won)
    for shard in range(4):
        upto = brute_seats(want, 25 * (shard + 1))
        assert {r.source: sum(r.quotas[: shard + 1]) for r in rows} == {s: upto[s] for s in want}


def test_small_sources_beside_a_huge_one_meet_their_targets(make):
    rows = [(i, "word " * 4000, "en", "a") for i in range(60)] + [(1000 + i, "two words", "en", f"s{i:03}") for i in range(120)]
    got = mixing.mix(make(rows)).collect()
    source, taken, want = {i: x[3] for i, *_, in [(r[0],) for r in rows] for x in [next(y for y in rows if y[0] == i)]}, Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        want[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= max(1, 0.02 * t) for s, t in want.items())


def test_mix_of_rows_that_share_an_id_or_have_none(make, prose):
    rows = [(None if i % 3 else i // 30, " ".join(prose(5 + i % 11, i % 40)), "en", f"s{i % 3}" if i % 7 else None) for i in range(400)]
    docs, pick = make(rows), lambda d: sorted((r.doc_id or -1, r.size, r.target, r.taken) for r in mixing.mix(d, blocks=50).collect())
    once = pick(docs.repartition(3))
    assert once == pick(docs.repartition(7)) == pick(docs.coalesce(1)) and len(once) == 400
    out = mixing.apply_mix(docs, blocks=50).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r[3] for r in once)
    clash = docs.withColumnsRenamed({"lang": "size", "n_chars": "key"}).selectExpr("*", "1 row", "2 start", "3 part")
    assert mixing.apply_mix(clash).columns == clash.columns


def test_mix_edges(make, odd):
    assert mixing.mix(make([])).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(r.taken <= 2 * r.size for r in rows)
    skew = make([(i, "one two three four", "en", "big" if i % 3 else "small") for i in range(300)])
    assert mixing.mix(skew).count() == 300
    out = mixing.apply_mix(skew).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.mix(skew).collect())
    assert out[0].asDict().keys() == skew.first().asDict().keys()


def brute_score(line: str):
    """Best template by cosine, in plain Python."""
    rows, rare = licenses.weights()
    idf, vectors = {t: i for _, _, t, _, i in rows}, defaultdict(dict)
    for name, k, term, w, _ in rows:
        vectors[name, k][term] = w
    import math

    c = Counter(licenses._words(line))
    v = {t: (1 + math.log(n)) * idf.get(t, rare) for t, n in c.items()}
    size = math.sqrt(sum(x * x for x in v.values())) or 1
    return max(((round(sum(v.get(t, 0) * w for t, w in u.items()) / size, 9), name) for (name, _), u in vectors.items()), key=lambda x: (x[0], [-ord(ch) for ch in x[1]]))


def wrapped(text, mark, width=72):
    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def test_wrapped_headers_and_whole_license_files(spark):
    """Notices wrapped in comments, and licence texts as a whole, are found at any place of a text."""
    code = "\ndef f(x):\n    return x + 1\n" * 30
    heads = {"MPL-2.0": licenses._MPL, "Apache-2.0": licenses._APACHE, "GPL-2.0": licenses.TEMPLATES["GPL-2.0"][3], "GPL-3.0": licenses.TEMPLATES["GPL-3.0"][3], "AGPL-3.0": licenses.TEMPLATES["AGPL-3.0"][3], "LGPL-3.0": licenses.TEMPLATES["LGPL-3.0"][3]}
    whole = {"MIT": licenses._MIT, "ISC": licenses._ISC, "BSL-1.0": licenses._BSL, "Zlib": licenses._ZLIB, "BSD-2-Clause": licenses.TEMPLATES["BSD-2-Clause"][-1], "BSD-3-Clause": licenses.TEMPLATES["BSD-3-Clause"][-1]}
    rows, want = [], {}
    for mark in ("# ", "// ", " * ", "; ", ""):
        for name, text in heads.items():
            want[len(rows)] = name
            rows.append((len(rows), f"/h/{len(rows)}.src", wrapped(text, mark) + code))
    for name, text in whole.items():
        want[len(rows)] = name
        rows.append((len(rows), f"/w/{name}/LICENSE", f"Copyright (c) 2020 Jane Roe\n\n{wrapped(text, '')}"))
        rows.append((len(rows), f"/w/{name}/deep/er/x.py", code))
        want[len(rows) - 1] = name
    got = {r.id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {i: x[0] for i, x in got.items()} == want
    assert all(got[i][1] == "inherited" for i, p, _ in rows if "deep" in p)


def test_leading_terms_and_bounds_lose_nothing(spark, prose):
    """`notices` against every part of every text by plain Python, texts made of template words and others."""
    r = random.Random(3)
    vocabulary = sorted({t for _, _, t, _, _ in licenses.weights()[0]}) + prose(60, 4)
    templates = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 30))) for _ in range(60)]
    for _ in range(120):
        w = licenses._words(r.choice(templates))
        texts.append(" ".join(x for x in w if r.random() < 0.8) + " " + " ".join(prose(r.randrange(0, len(w)), r.randrange(99))))
    files = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {x.row: (x.license, x.score) for x in licenses.notices(files).collect()}
    for k, t in enumerate(texts):
        score, name = brute_score(t)
        assert (got[k] == (name, pytest.approx(score))) if score >= licenses.MIN_COSINE else k not in got


def test_rows_that_share_an_id_are_files_of_their_own(spark):
    rows = [(None, "/a/x", "Released under the MIT License."), (None, "/a/x", "nothing here"), (5, "/b/y", "plain"), (5, "/b/y", "Licensed under CC BY 4.0.")]
    got = sorted((r.path, r.own_license or "") for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect())
    assert got == [("/a/x", ""), ("/a/x", "MIT"), ("/b/y", ""), ("/b/y", "CC-BY-4.0")]


def test_license_notices(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "We bought a licence plate for the car in town today, and it was red.", "All rights reserved.", "Licensed under the Apache License, Version 2.0. More text follows it"]
    files = spark.createDataFrame([(i, f"/r/{i}.txt", f"Some words.\n{t}\n" + "more words " * 30) for i, t in enumerate(lines)], "id long, path string, text string")
    got = {r.id: (r.own_license, r.score) for r in licenses.scan(files).collect()}
    assert got[0][0] == "MIT" and got[1][0] == "CC-BY-NC-4.0" and got[2][0] == "CC-BY-4.0" and got[3][0] is None and got[4][0] == "Proprietary" and got[5][0] == "Apache-2.0"
    for i in (0, 1, 2, 4):
        score, name = brute_score(lines[i])
        assert got[i] == (name, pytest.approx(score))


def test_license_inheritance_takes_the_nearest_directory(spark):
    body = "def f(x):\n    return x\n" * 20
    rows = [
        (1, "/a/LICENSE", "Released under the MIT License."),
        (2, "/a/x.py", body),
        (3, "/a/b/y.py", body),
        (4, "/a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (5, "/a/b/c/d/z.py", body),
        (6, "/q/w.py", body),
        (7, "/a/b/own.py", body + "This work is licensed under the GNU General Public License, version 3.\n" + body),
        (8, None, body),
        (9, "/a/b/n.py", None),
        (None, "/a/k.py", body),
    ]
    got = {r.path: (r.license, r.origin, r.license_dir) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got["/a/x.py"] == ("MIT", "inherited", "/a") and got["/a/b/y.py"] == ("MIT", "inherited", "/a")
    assert got["/a/b/c/d/z.py"] == ("Apache-2.0", "inherited", "/a/b/c")
    assert got["/q/w.py"] == (None, "none", None) and got["/a/b/own.py"][:2] == ("GPL-3.0", "own")
    assert got[None] == (None, "none", None) and got["/a/b/n.py"][0] == "MIT" and got["/a/k.py"][0] == "MIT"


def test_license_edges(make, odd):
    assert licenses.scan_documents(make([])).count() == 0
    assert licenses.scan_documents(odd).count() == 9
