"""Fill-in-middle transformation: an Aho-Corasick scan for the few characters that end units, then moves of whole spans."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import blocks

#: ASCII characters at which the class of a text changes, by unit; a gap between two of them counts by arithmetic.
BREAKS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Code points that are treated at once.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Rules:
    """unit: line (up to and with its newline), word (with the white space behind it) or char. The rates are per cent:
    of the texts that are transformed, and of those that put the suffix first."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in BREAKS:
            raise ValueError(f"unknown unit: {self.unit}")
        if len({self.prefix, self.suffix, self.middle}) < 3 or not all((self.prefix, self.suffix, self.middle)):
            raise ValueError("three different sentinels are needed")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Scan:
    """What one pass over a text leaves: its length, where units end (sparse), and its sentinels as (start, which)."""

    size: int
    dense: bool
    ends: list[int]
    marks: list[tuple[int, int]]

    @property
    def units(self) -> int:
        if self.dense:
            return self.size
        return len(self.ends) + (self.size > (self.ends[-1] if self.ends else 0))

    def offset(self, rank: int) -> int:
        """Where the first `rank` units end, in code points."""
        if self.dense:
            return rank
        return 0 if rank == 0 else self.ends[rank - 1] if rank <= len(self.ends) else self.size

    def rank(self, offset: int) -> int:
        """How many units end at or before a code point."""
        return offset if self.dense else bisect_left(self.ends, offset + 1) + (offset >= self.size > (self.ends[-1] if self.ends else 0))


class Scanner:
    """One automaton for the breaks of a unit and for the sentinels."""

    def __init__(self, rules: Rules):
        self.dense, self.runs = not BREAKS[rules.unit], rules.unit == "word"
        self.lengths = [len(s) for s in rules.sentinels]
        self.automaton = ahocorasick.Automaton()
        values: dict[str, list[int]] = {c: [-1] for c in BREAKS[rules.unit]}
        for k, s in enumerate(rules.sentinels):
            values.setdefault(s, []).append(k)
        for word, what in values.items():  # a sentinel can be a break at once
            self.automaton.add_word(word, tuple(what))
        self.automaton.make_automaton()

    def scan(self, text: str) -> Scan:
        ends, marks = [], []
        for last, what in self.automaton.iter(text):
            for k in what:
                if k < 0:
                    ends.append(last + 1)
                else:
                    marks.append((last + 1 - self.lengths[k], k))
        if self.runs:  # a run of breaks ends one unit, where the run ends
            ends = [e for e, following in zip(ends, [*ends[1:], 0], strict=False) if following != e + 1]
        return Scan(len(text), self.dense, ends, marks)


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers that the seed and the id fix: 32 bits each of a SHA-256; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arranged(text: str, doc_id: int | None, rules: Rules, scanner: Scanner) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, length of the prefix, length of the middle, output)."""
    found = scanner.scan(text)
    a, b, c, d = drawn(rules.seed, doc_id)
    n = found.units
    if not text or found.marks or c % 100 >= rules.rate:
        return n, PLAIN, None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    i, j = found.offset(i), found.offset(j)
    head, mid, tail = text[:i], text[i:j], text[j:]
    if d % 100 < rules.spm_rate:
        return n, SPM, i, j - i, "".join((rules.suffix, tail, rules.prefix, head, rules.middle, mid))
    return n, PSM, i, j - i, "".join((rules.prefix, head, rules.suffix, tail, rules.middle, mid))


def rebuilt(output: str, form: str, rules: Rules, scanner: Scanner) -> str:
    """The text that became `output`."""
    if form == PLAIN:
        return output
    marks = scanner.scan(output).marks
    if [k for _, k in marks] != ([0, 1, 2] if form == PSM else [1, 0, 2]) or marks[0][0]:
        raise ValueError(f"not an output of the form {form}")
    starts = [m[0] for m in marks]
    parts = {k: output[at + len(rules.sentinels[k]) : end] for (at, k), end in zip(marks, [*starts[1:], len(output)], strict=True)}
    return parts[0] + parts[2] + parts[1]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about BLOCK bytes, so what a task holds does not follow from the number of rows in a batch."""
    for b in batches:
        for i, j in blocks([x or 0 for x in pc.binary_length(b.column(column)).to_pylist()], BLOCK):
            yield b.slice(i, j - i)


def transform(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of `docs`: (doc_id, n, form, prefix_chars, middle_chars, output).

    The text is cut into n units; prefix and middle end after numbers of units that seed and id fix. `form` is psm
    (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: the text itself, if it is empty, holds a sentinel
    or is not drawn; then there are no lengths. Null text is empty; a null id draws as an empty one, equal ids draw
    alike; rows are never merged, other columns do not matter, and an empty table gives an empty table. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in _slices(batches, 1):
            rows = [arranged(t or "", i, rules, scanner) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(out: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`out` with `restored`: the exact texts, from output and form alone."""
    at, form, names = out.columns.index("output"), out.columns.index("form"), [*out.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in _slices(batches, at):
            texts = [rebuilt(o, f, rules, scanner) for o, f in zip(b.column(at).to_pylist(), b.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return out.mapInArrow(run, StructType([*out.schema.fields, StructField("restored", StringType())]))


def digests(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`transform`, with SHA-256 of the outputs and of the texts restored from them in place of the texts."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return restore(transform(docs, rules), rules).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(F.col("restored")).alias("restored_sha256"))


#: The same in SQL, with the default rules.
ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    r AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 AS d FROM d),
    p AS (SELECT *, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS is_plain, array_to_string(u[1:least(a, b)], '') AS head,
                 array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS tail FROM r)
    SELECT doc_id, n, CASE WHEN is_plain THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form,
           CASE WHEN NOT is_plain THEN length(head) END AS prefix_chars, CASE WHEN NOT is_plain THEN length(mid) END AS middle_chars,
           sha256(CASE WHEN is_plain THEN t WHEN d < 50 THEN '<S>' || tail || '<P>' || head || '<M>' || mid ELSE '<P>' || head || '<S>' || tail || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p"""
