"""Fill-in-middle: against regular expressions, and exact round trips."""

import re
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import fim

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s:.)"}
TEXT = st.text(st.sampled_from("ab \n\t<PSM>é😀\r\x1f"), max_size=40)


@given(TEXT, st.sampled_from(sorted(PATTERNS)))
@settings(max_examples=400, deadline=None)
def test_units_and_offsets_are_those_of_the_pattern(text, unit):
    found = fim.Scanner(fim.Rules(unit=unit)).scan(text)
    want = re.findall(PATTERNS[unit], text)
    assert found.units == len(want)
    for k in range(len(want) + 1):
        assert found.offset(k) == len("".join(want[:k]))
        assert found.rank(found.offset(k)) == k
    assert [(i, k) for i, k in found.marks] == sorted((m.start(), k) for k, s in enumerate(("<P>", "<S>", "<M>")) for m in re.finditer(s, text))


@given(TEXT, st.integers(0, 60), st.sampled_from(sorted(PATTERNS)), st.sampled_from([0, 50, 100]))
@settings(max_examples=400, deadline=None)
def test_every_text_comes_back(text, doc_id, unit, spm):
    rules = fim.Rules(unit=unit, spm_rate=spm)
    scanner = fim.Scanner(rules)
    n, form, a, b, out = fim.arranged(text, doc_id, rules, scanner)
    assert fim.rebuilt(out, form, rules, scanner) == text
    h = sha256(f"7:{doc_id}".encode()).hexdigest()
    if text and not any(s in text for s in rules.sentinels):
        units = re.findall(PATTERNS[unit], text)
        i, j = sorted((int(h[:8], 16) % (n + 1), int(h[8:16], 16) % (n + 1)))
        head, mid, tail = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        assert (form, a, b) == ("spm" if int(h[24:32], 16) % 100 < spm else "psm", len(head), len(mid))
        assert out == (f"<S>{tail}<P>{head}<M>{mid}" if form == "spm" else f"<P>{head}<S>{tail}<M>{mid}")
    else:
        assert (form, a, b, out) == ("plain", None, None, text)


def test_rules_and_outputs_that_make_no_sense():
    for bad in ({"unit": "page"}, {"suffix": "<P>"}, {"middle": ""}):
        with pytest.raises(ValueError):
            fim.Rules(**bad)
    rules = fim.Rules()
    for out, form in (("<P>a<M>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.rebuilt(out, form, rules, fim.Scanner(rules))


def test_odd_rows_equal_the_sql_and_come_back(spark, odd, make, tmp_path):
    more = make([(i, x) for i, x in enumerate(["<P>", "a<S>b", "one\ntwo\nthree", "\n\n\n", "no newline", "é\n😀" * 900, "<\nP>\n" * 50, "a\r\nb\r\n"] * 4, 20)])
    docs = odd.unionByName(more)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    out = fim.restore(fim.transform(docs)).collect()
    assert len(out) == docs.count() and {(r.doc_id, r.restored) for r in out} == {(i, t or "") for i, t in texts}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(fim.ORACLE)
    got = fim.digests(docs)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
    clash = docs.selectExpr("*", "1 as output", "2 as form", "3 as n", "4 as restored")
    assert sorted(map(repr, map(tuple, fim.digests(clash).collect()))) == sorted(map(repr, map(tuple, got.collect())))
    assert fim.digests(make([])).count() == 0


def test_rates_and_forms(spark, make):
    docs = make([(i, "x\n" * 8) for i in range(400)])
    forms = fim.transform(docs, fim.Rules(rate=50)).groupBy("form").count().collect()
    n = {r["form"]: r["count"] for r in forms}
    assert 150 < n["plain"] < 250 and 60 < n["psm"] < 140 and 60 < n["spm"] < 140
