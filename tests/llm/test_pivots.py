"""Embedding near-duplicates: against brute force over all pairs, and recall at the threshold."""

import numpy as np
import pytest

from palaver.llm import pivots as pv

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.95):
    """{position: (n_links, component_id, kept)} by all cosines."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sizes = [len(rows[k][1]) for k in good]
    if sizes:
        d = max(sorted(set(sizes)), key=sizes.count)
        good = [k for k in good if len(rows[k][1]) == d]
    out = {k: (0, i, True) for k, (i, _) in enumerate(rows)}
    if not good:
        return out
    u = pv.unit(np.array([rows[k][1] for k in good], float))
    link = u @ u.T >= least
    label = np.arange(len(good))
    while True:
        new = np.array([label[row].min() for row in link])
        if (new == label).all():
            break
        label = new
    for x, k in enumerate(good):
        ids = [rows[good[y]][0] for y in np.flatnonzero(label == label[x]) if rows[good[y]][0] is not None]
        c = min(ids) if ids else None
        out[k] = (int(link[x].sum()) - 1, c, rows[k][0] == c)
    return out


def clusters(seed, sizes, d=64, spread=0.09, singles=60):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=d) for _ in range(singles)]
    for n in sizes:
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        out += [(c + spread * rng.normal(size=d) / np.sqrt(d) * rng.uniform(0.5, 3)) * rng.uniform(0.5, 2) for _ in range(n)]
    out += [out[k] for k in range(0, len(out), 17)]  # equal ones
    ids = rng.permutation(len(out))
    return [(int(i), v.tolist()) for i, v in zip(ids, out, strict=True)]


def compare(spark, rows, kind="double"):
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = pv.vector_links(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA.replace("double", kind)).repartition(3)).collect()
    want = brute(rows)
    assert sorted(map(repr, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in got))) == sorted(map(repr, ((i, *want[k]) for k, (i, _) in enumerate(rows))))
    return got


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"LOW": 5}), (3, {"LIST": 16}), (4, {"LIST": 16, "LOW": 5})])
def test_clusters_equal_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(pv, name, value)
    got = compare(spark, clusters(seed, [120, 40, 7, 2, 2]), "float" if limits else "double")
    assert max(r.n_links for r in got) > 50 and sum(r.kept for r in got) < len(got)


def test_loose_groups_need_every_look(spark, monkeypatch):
    monkeypatch.setattr(pv, "LIST", 16)
    monkeypatch.setattr(pv, "LOW", 5)
    compare(spark, clusters(9, [90, 60], spread=0.2))


def test_given_table_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(spark, [(r.vec_id, [float(x) for x in r.embedding]) for r in table])


@pytest.mark.parametrize("d", [1, 2, 3])
def test_few_dimensions(spark, d):
    rng = np.random.default_rng(d)
    compare(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(70, d)))])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (11, [-1.0, 0.0]), (2, [2.0, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [1e300, 1e300]), (15, [1e-300, 1e-300]), (None, [-1.0, 5.0]), (None, None)]
    compare(spark, rows)
    compare(spark, [])
    compare(spark, [(3, [1.0, 2.0])])
    compare(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0])])
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    clash = table.selectExpr("*", "1 as vector", "2 as node", "3 as copies", "4 as least", "5 as ball", "6 as near")
    assert sorted(map(repr, map(tuple, pv.vector_links(clash).collect()))) == sorted(map(repr, map(tuple, pv.vector_links(table).collect())))


def test_recall_at_the_threshold_is_over_nine_in_ten():
    """Pairs at each cosine, among as many pivots as there are in production."""
    rng = np.random.default_rng(3)
    assert len(pv.chosen(pv.unit(rng.normal(size=(90, 2))), 1024)) <= 10
    p, x = pv.chosen(pv.unit(rng.normal(size=(pv.SAMPLE, 64))), pv.PIVOTS), pv.unit(rng.normal(size=(2_000, 64)))
    off = rng.normal(size=x.shape)
    off = pv.unit(off - (off * x).sum(1, keepdims=True) * x)
    for cos, share in ((0.9501, 0.99), (0.97, 0.995), (0.99, 0.999)):
        a, b = (pv.described(u, p, pv.NEAREST) for u in (x, cos * x + np.sqrt(1 - cos**2) * off))
        assert ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= 2).mean() >= share
