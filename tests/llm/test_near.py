"""Near-duplicates, decontamination and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from palaver.llm import common, decontamination, mixing, neardup, toxicity


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similar(a, b):
    """Alignment of the words; what the words alone rule out is not aligned."""
    most = sum((Counter(a) & Counter(b)).values()) if a and b and 0.8 * len(a) <= len(b) <= len(a) / 0.8 else 0
    if not most or most / (len(a) + len(b) - most) < 0.8:
        return False
    n = len(a) if a == b else lcs(a, b)
    return n / (len(a) + len(b) - n) >= 0.8


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {i: words(t) for i, t in rows}
    for i, ti in rows:
        for j, tj in rows:
            if i < j and root(i) != root(j) and (similar(s[i], s[j]) if s[i] and s[j] else not s[i] and not s[j] and (ti or "") == (tj or "")):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def edited(w, n, r):
    w = list(w)
    for _ in range(n):
        k = r.randrange(len(w))
        w[k] = "".join(r.choice("abcdefgh") for _ in range(5))
    return w


def family(prose):
    r, rows, i = random.Random(3), [], 0
    passage = prose(40, 999)
    for f in range(12):
        base = prose(r.randrange(30, 160), f)
        if f % 3 == 0:
            base = base + passage
        for k in range(6):
            rows.append((i * 7, " ".join(edited(base, k, r)) + ("." if k % 2 else "")))
            i += 1
    chain = prose(200, 77)
    for _ in range(8):
        rows.append((i * 7, " ".join(chain)))
        i += 1
        chain = edited(chain, 3, r)
    return rows + [(9001, None), (9002, ""), (9003, "one two"), (9004, "One, two!"), (9005, "***"), (9006, "***"), (9007, "one two three")]


def test_near_classes_match_brute_force(make, prose):
    rows = family(prose)
    got = neardup.near_classes(make(rows)).collect()
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    n = Counter(want.values())
    assert all(r.class_size == n[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    kept = {r.doc_id for r in neardup.keep_one(make(rows)).collect()}
    assert kept == set(want.values())


def test_large_family_below_its_leads_is_linked_whole(make, prose):
    """Every two texts that share a sketch are linked or aligned, although the least of their bucket links neither."""
    r, base = random.Random(8), prose(60, 31)
    rows = [(i, " ".join(edited(base, 4, r))) for i in range(200)]
    w = {i: neardup.word_hashes(t) for i, t in rows}
    share = defaultdict(list)
    for i, _ in rows:
        for k in set(neardup.keys(w[i]).tolist()):
            share[k].append(i)
    tried = {(a, b) for ids in share.values() if len(ids) <= neardup.SMALL for a in ids for b in ids if a < b}
    root = list(range(200))
    for a, b in sorted(tried):
        if root[a] != root[b] and neardup.aligned(w[a], w[b]):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
    got = {x.doc_id: x.class_id for x in neardup.near_classes(make(rows)).collect()}
    # what the small groups alone link is in one class
    assert all(got[a] == got[root[a]] for a in root) and len(set(root)) < 200


@pytest.mark.parametrize("small, leads", [(2, 2), (8, 64)])
def test_large_groups_keep_every_link(make, prose, monkeypatch, small, leads):
    """Unlike texts that share a passage, and among them pairs of high shingle similarity: none of these is lost."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "LEADS", leads)
    r, passage, rows = random.Random(4), prose(90, 5), []
    for k in range(60):
        own = prose(25 + k % 7, 4000 + k)
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + edited(own, 1, r)))]
    got = {x.doc_id: x.class_id for x in neardup.near_classes(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_recall_by_share_of_edits(make, prose):
    """Near copies of 1, 3 and 5 % edited words are found; texts with a third of theirs replaced are not."""
    for share, least, most in ((0.01, 1.0, 1.0), (0.03, 0.99, 1.0), (0.05, 0.99, 1.0), (0.33, 0.0, 0.0)):
        r, rows = random.Random(6), []
        for k in range(100):
            base = prose(r.randrange(100, 400), 7000 + k)
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(base, int(len(base) * share), r)))]
        got = {x.doc_id: x.class_id for x in neardup.near_classes(make(rows)).collect()}
        assert least <= sum(got[2 * k + 1] == 2 * k for k in range(100)) / 100 <= most


def test_rows_that_share_an_id_or_have_none(make, prose):
    """Each row is a row of its own: nothing is merged or lost because of its id, and of equal rows one stays."""
    t, a, b, c = (" ".join(prose(40, 60 + k)) for k in range(4))
    rows = [(3, t), (5, a), (5, t), (None, b), (None, c), (9, b), (4, "same"), (4, "same"), (4, "same!"), (None, None), (None, "")]
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.class_size, r.kept) for r in neardup.near_classes(make(rows).repartition(3)).collect()))
    assert got == sorted([(3, 3, 2, True), (5, 5, 1, True), (5, 3, 2, False), (-1, -1, 2, True), (-1, -1, 1, True), (9, -1, 2, False), (4, 4, 3, True), (4, 4, 3, False), (4, 4, 3, False), (-1, -1, 2, True), (-1, -1, 2, False)])
    kept = neardup.keep_one(make(rows).repartition(3)).collect()
    assert Counter((r.text or "").rstrip("!") for r in kept) == Counter([t, a, b, c, "same", ""])
    clash = make(rows).withColumnsRenamed({"lang": "kept", "source": "row"}).selectExpr("*", "1 id", "2 raw", "3 same")
    assert neardup.keep_one(clash).columns == clash.columns and neardup.keep_one(clash).count() == 6


def test_letters_beyond_the_basic_plane_are_told_apart(make):
    one, two = ("".join(chr(c + 41 * k) for k in range(30)) for c in (0x20000, 0x21000))
    got = {r.doc_id: r.class_id for r in neardup.near_classes(make([(1, one), (2, two), (3, one + "!")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_alignment_matches_dynamic_programming():
    r = random.Random(5)
    for _ in range(300):
        a = [r.randrange(12) for _ in range(r.randrange(1, 40))]
        b = list(a)
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(b) + 1)
            if r.random() < 0.5 and b:
                del b[min(k, len(b) - 1)]
            else:
                b.insert(k, r.randrange(12))
        if b:
            assert neardup.aligned(np.array(a, np.uint32), np.array(b, np.uint32)) == similar(a, b)


def test_sketches_keep_text_order_and_agree_with_similarity(prose):
    w = prose(300, 1)
    one = neardup.sketches(neardup.shingles(neardup.word_hashes(" ".join(w))))
    near = neardup.sketches(neardup.shingles(neardup.word_hashes(" ".join(edited(w, 3, random.Random(1))))))
    turned = neardup.sketches(neardup.shingles(neardup.word_hashes(" ".join(w[150:] + w[:150]))))
    assert (one == near).sum() > 12
    # the same words in another order have nearly the same set of shingles, but not their order
    assert (one == turned).sum() < (one == near).sum()


def test_near_edges(make, odd):
    assert neardup.near_classes(make([])).count() == 0
    rows = neardup.near_classes(odd).collect()
    assert len(rows) == 9
    assert {r.class_id for r in rows if r.doc_id in (6, 7, 8)} == {6}
    same = neardup.near_classes(make([(i, "the very same text in every row of it") for i in range(500)])).collect()
    assert {(r.class_id, r.class_size) for r in same} == {(0, 500)}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[node] == min(seen)


def brute_distance(q, t):
    """Least edit distance between q and a substring of t."""
    row = list(range(len(q) + 1))
    best = row[-1]
    for ch in t:
        diag, row[0] = row[0], 0
        for i, x in enumerate(q, 1):
            diag, row[i] = row[i], min(diag + (x != ch), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def plain(text):
    return " ".join(words(text))


def test_contaminated_matches_brute_force(spark, make, prose):
    r = random.Random(9)
    items = [(k, " ".join(prose(r.randrange(4, 40), 500 + k)).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "Ka mo!"), (53, "!!")]
    docs = [(i, " ".join(prose(r.randrange(20, 120), 900 + i))) for i in range(25)]
    for k, t in items[:12]:
        body = list(t)
        for _ in range(r.randrange(0, len(t) // 7)):
            body[r.randrange(len(body))] = r.choice("abcxyz")
        docs.append((100 + k, "Before this, " + "".join(body).upper() + " and after"))
    docs += [(300, None), (301, ""), (302, "x " * 3000 + items[3][1] + " y" * 3000), (303, "oh ka mo then")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        for k, q in items:
            p = plain(q)
            if p and len(p) >= 8 and brute_distance(p, plain(t)) <= decontamination.budget(len(p)) or p and len(p) < 8 and f" {p} " in f" {plain(t)} ":
                want.add((i, k))
    got = decontamination.contaminated(make(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and (302, 3) in want and (303, 52) in want
    texts, q = dict(docs), dict(items)
    for x in got:
        assert brute_distance(plain(q[x.item_id]), plain(texts[x.doc_id])) == x.distance if x.item_len >= 8 else x.distance == 0
        assert brute_distance(plain(q[x.item_id]), plain(texts[x.doc_id][x.begin : x.finish])) <= decontamination.budget(x.item_len)


def test_myers_matches_dynamic_programming():
    r = random.Random(4)
    for _ in range(300):
        q, t = ([r.randrange(97, 101) for _ in range(r.randrange(1, n))] for n in (90, 140))
        d, end = decontamination.myers(np.array(q), np.array(t), 200)
        want = brute_distance(q, t)
        assert min(d, len(q)) == want
        if want < len(q):
            assert brute_distance(q, t[:end]) == want


def test_decontamination_edges(spark, make, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(make([]), none).count() == 0
    assert decontamination.contaminated(odd, none).count() == 0
    some = spark.createDataFrame([(1, "word word word word"), (None, "nothing like it at all here")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(odd, some).collect()} == {5}


def test_many_items_take_several_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    items = [(k, f"item number {k} with words alpha{k} beta{k} gamma{k}") for k in range(7)]
    docs = make([(k, f"before {t} after") for k, t in items])
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).where("distance = 0").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(7)]


def test_pipeline_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    left = {i: t for i, t in text.items() if i not in toxic}
    classes = brute_classes(sorted(left.items()))
    left = {i: t for i, t in left.items() if classes[i] == i}
    bench = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(q[:60] in plain(t) for _, q in bench)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert {r.doc_id for r in rows} <= set(left)
    kept = docs.where(docs.doc_id.isin(list(left)))
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(kept).collect() if r.taken}
    assert Counter(r.doc_id for r in rows) == {i: -(-t // s) for i, (t, s) in taken.items()}
    full = [r for r in rows if r.text_crc32 == zlib.crc32(text[r.doc_id].encode())]
    assert len(full) >= len(rows) - 20
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows))) and len(size) == 16


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_totals_reach_every_row_of_large_and_small_keys(spark):
    rows = spark.createDataFrame([(k if i % 2 else 0, i) for i in range(4000) for k in [i % 1500]], "k long, i long")
    totals = rows.groupBy("k").count()
    got = common.join_totals(rows, totals, "k", "count").collect()
    want = Counter(r.k for r in rows.collect())
    assert len(got) == 4000 and all(r["count"] == want[r.k] for r in got)
    assert common.join_totals(rows.limit(0), totals.limit(0), "k", "count").count() == 0


def test_samples_are_bounded_and_stable(spark):
    df = spark.range(20_000).selectExpr("id as doc_id")
    a = [r.doc_id for r in common.sampled(df, 50, "doc_id").collect()]
    assert len(a) == 50 and sorted(a) == sorted(r.doc_id for r in common.sampled(df.repartition(7), 50, "doc_id").collect())
    assert common.sampled(df.limit(0), 50, "doc_id").count() == 0 and common.sampled(df.limit(30), 50, "doc_id").count() == 30


def test_even_keys_deal_one_bucket_a_partition(spark):
    keys = common.even_keys(spark, 13)
    dealt = spark.createDataFrame([(k,) for k in keys], "k int").repartition(13, "k").selectExpr("k", "spark_partition_id() p").collect()
    assert sorted(r.p for r in dealt) == list(range(13)) and {r.k: r.p for r in dealt} == {k: p for p, k in enumerate(keys)}


def test_entries_of_shared_keys_are_those_that_two_documents_have(spark):
    r = random.Random(4)
    keys = {i: [r.randrange(40) if r.random() < 0.5 else 1_000 + 40 * i + k for k in range(6)] + [7] for i in range(60)}
    rows = [(i, 100 + i, np.array(k, np.uint64).tobytes()) for i, k in keys.items()]
    got = neardup.shared(spark.createDataFrame(rows, "id long, n long, keys binary").repartition(3)).collect()
    owners = {}
    for i, k in keys.items():
        for x in k:
            owners.setdefault(x, set()).add(i)
    assert sorted((x.key, x.id, x.n) for x in got) == sorted((k, i, 100 + i) for k, own in owners.items() if len(own) > 1 for i in own)


def test_large_groups_are_whole_where_the_finer_sketches_find_nothing(spark, prose, monkeypatch):
    """The finer sketches only save work: without any link from them no pair of a large group is lost."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "LEADS", 16)

    def no_two_alike(batches):
        for b in batches:
            own = [int(i).to_bytes(8, "little", signed=True) for i in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(own, pa.binary())], ["id", "n", "keys"])

    monkeypatch.setattr(neardup, "_fine_task", no_two_alike)
    r, passage, rows = random.Random(4), prose(90, 5), []
    for k in range(30):
        own = prose(25 + k % 7, 4000 + k)
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + edited(own, 1, r)))]
    words = {k: neardup.word_hashes(t) for k, t in rows}
    # all have the one sketch, so they meet in one group only
    held = spark.createDataFrame([(k, bytearray(zstandard.compress(w.tobytes())), bytearray(8), 115) for k, w in words.items()], "id long, words binary, sketch binary, n long")
    state = neardup._Links(held, neardup.SIMILARITY)
    neardup.closed(held, state)
    root = {x.node: x.root for x in state.label.collect()} if state.label is not None else {}
    assert {k: root.get(k, k) for k in words} == brute_classes(rows)


def test_large_groups_of_finer_sketches_are_compared_whole(spark, prose, monkeypatch):
    """A pair that only a finer sketch brings together is compared in a large group as it is in a small one."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "LEADS", 16)
    monkeypatch.setattr(neardup, "PIECE", 7)

    def all_alike(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array([bytes(8)] * b.num_rows, pa.binary())], ["id", "n", "keys"])

    monkeypatch.setattr(neardup, "_fine_task", all_alike)
    r, passage, rows = random.Random(4), prose(90, 5), []
    for k in range(20):
        own = prose(25 + k % 7, 4000 + k)
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + edited(own, 1, r)))]
    words = {k: neardup.word_hashes(t) for k, t in rows}
    # texts and their near copies lie in different groups of the coarse sketch
    held = spark.createDataFrame([(k, bytearray(zstandard.compress(w.tobytes())), bytearray([k % 2] * 8), 115) for k, w in words.items()], "id long, words binary, sketch binary, n long")
    state = neardup._Links(held, neardup.SIMILARITY)
    neardup.closed(held, state)
    root = {x.node: x.root for x in state.label.collect()} if state.label is not None else {}
    assert {k: root.get(k, k) for k in words} == brute_classes(rows)


def test_members_of_groups_stay_packed_where_they_are_joined(spark, prose, monkeypatch):
    """What is joined by key is a row a piece of a group: the rows do not grow with documents times keys."""
    rows = [(i, 100, np.arange(40, dtype=np.uint64).tobytes()) for i in range(50)]
    pieces = neardup.groups(spark.createDataFrame(rows, "id long, n long, keys binary").repartition(3))
    assert pieces.count() == 40 and neardup.members(pieces).count() == 2000
    monkeypatch.setattr(neardup, "PIECE", 4)
    pieces = neardup.groups(spark.createDataFrame(rows, "id long, n long, keys binary").repartition(3))
    assert {(r.members, r.docs) for r in pieces.select("members", "docs").collect()} == {(50, 1)} and neardup.members(pieces).count() == 2000
