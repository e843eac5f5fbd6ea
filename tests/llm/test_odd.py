"""Every operator on rows that share an id or have none, equal rows, and extra columns with the names it uses itself."""

from collections import Counter

import pytest

import corpus_pipeline
from palaver.llm import decontamination, exactdedup, langid, licenses, mixing, neardup, repeats, secretscan, sharding, toxicity

CLASH = ("row", "node", "digest", "keep_id", "kept", "copies", "size", "start", "part", "quota", "license", "path", "license_dir", "class_id", "raw", "same", "words", "n", "y", "bucket", "shard", "slot", "gram", "spans")


@pytest.fixture(scope="module")
def rows(prose):
    t = [" ".join(prose(60, 40 + k)) for k in range(4)]
    secret, notice, item = t[0] + "\npassword = hunter2hunter2 " + t[1], t[2] + "\nReleased under the MIT License.\n" + t[3], "the benchmark item that nobody should train on at all"
    out = [(None, t[0]), (None, t[1]), (None, t[0]), (7, secret), (7, notice), (7, notice), (8, None), (8, ""), (None, None), (9, f"{t[3]} {item} {t[2]}"), (9, t[2]), (3, " \n"), (4, "tie"), (5, "tie")]
    return [(i, x, "en" if n % 2 else None, f"s{n % 3}" if n % 4 else None) for n, (i, x) in enumerate(out)]


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0), (9, 0, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "The benchmark item that nobody should train on at all."), (None, "x"), (1, None), (1, "The benchmark item that nobody should train on at all.")], "item_id long, text string")
    return labels, bench


def operators(spark, tables):
    labels, bench = tables
    field = secretscan.fit(secretscan.tokenize([]), secretscan.tagged(secretscan.tokenize([]), []))
    return {
        "license": licenses.scan_documents,
        "secrets": lambda d: secretscan.scan(d, field),
        "mixing": mixing.mix,
        "language": langid.identify,
        "sharding": sharding.shard,
        "exact": exactdedup.exact_dedup,
        "toxicity": lambda d: toxicity.classify(d, labels),
        "repeats": lambda d: repeats.remove_repeats(d, texts=False),
        "near": neardup.near_classes,
    }


def test_a_row_in_is_a_row_out_whatever_the_other_columns_are_called(spark, make, rows, tables):
    docs = make(rows).repartition(3)
    clash = docs
    for k, name in enumerate(CLASH):
        clash = clash.selectExpr("*", f"{k} as `{name}`")
    want_ids = Counter(r[0] for r in rows)
    for name, f in operators(spark, tables).items():
        out = f(docs).collect()
        assert Counter(r.doc_id for r in out) == want_ids, name
        assert sorted(map(repr, (tuple(r) for r in f(clash).collect()))) == sorted(map(repr, map(tuple, out))), name
        assert f(make([])).count() == 0, name


def test_what_the_rows_that_share_an_id_come_to(spark, make, rows, tables):
    docs = make(rows).repartition(3)
    _, bench = tables
    assert sorted((r.doc_id, r.own_license) for r in licenses.scan_documents(docs).where("doc_id = 7").collect() if r.own_license) == [(7, "MIT"), (7, "MIT")]
    secrets = operators(spark, tables)["secrets"](docs).where("doc_id = 7").collect()
    assert sorted(r.n_assign for r in secrets) == [0, 0, 1]
    found = decontamination.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == {(9, 1): 2}  # the item is there twice
    left = decontamination.keep_clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 1 and left.where("doc_id = 9").count() == 1
    exact = exactdedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in exact) == len({(r[1] or "").replace(" ", "").replace("\n", "") for r in rows})


def test_stages_keep_extra_columns_and_rows_without_ids(spark, sf_dir, make, rows):
    docs = make(rows).selectExpr("*", "1 as row", "2 as kept", "3 as size", "4 as part")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n <= len(rows) * (2 if name == "mixing" else 1), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
