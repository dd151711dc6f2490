from __future__ import annotations

import pytest
from compare import connect, difference
from texts import RUN, SF, given, no_docs, odd_docs, odd_texts

from eventloom.llm.catalog import llm_oracle, llm_queries
from eventloom.llm.lines import MAX_LINES, MIN_CHARS, dedup_lines


def windows(lines):
    out = set()
    for step in (1, -1):
        for i in range(len(lines)):
            at, chars, n = i, 0, 0
            while 0 <= at < len(lines) and chars < MIN_CHARS and n < MAX_LINES:
                chars, n, at = chars + len(lines[at].strip(" ")), n + 1, at + step
            if chars >= MIN_CHARS or n == MAX_LINES:
                out.add((min(i, at - step), n))
    return out


def brute_force(rows):
    """Texts without later repeated runs, for rows in order."""
    seen, out = set(), []
    for text in rows:
        lines = text.split("\n")
        gone = set()
        for s, n in sorted(windows(lines)):
            run = tuple(x.strip(" ") for x in lines[s : s + n])
            if run in seen:
                gone.update(range(s, s + n))
            seen.add(run)
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_sql(spark, name):
    got = llm_queries()[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(llm_oracle()[name]).df()) is None


def test_brute_force(spark):
    docs = [(i, t) for i, t, _ in given()]
    passage = "\n".join(t.split("\n")[0] for _, t in docs[:6])
    docs += [(900 + k, f"start {k}\n{passage}\nend {k}") for k in range(5)]
    docs += [(950, "\n".join(["same line again and again " * 3] * 12)), (951, "ab\n" * 40)]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_force([t for _, t in sorted(docs)])
    assert [got[i] for i, _ in sorted(docs)] == want
    assert sum(n for _, n in want) > 20


def test_odd(spark):
    docs = odd_docs(spark)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    rows = out.collect()
    assert len(rows) == len(odd_texts())
    assert [r.text for r in rows if r.doc_id == 7] == [RUN, RUN]  # one document twice
    assert [r.text for r in rows if r.doc_id == 8 and r.n_removed] == ["before\nafter"]
    assert sorted((r.text is None, r.text or "") for r in rows if r.doc_id is None) == [(False, ""), (True, "")]
    assert next(r.text for r in rows if r.doc_id == 1) is None
    assert dedup_lines(no_docs(spark)).count() == 0


def test_common_line_inside_a_run(spark):
    """A line that is common elsewhere first does not hide the run around it, nor go itself."""
    before, common, after = "a run of words before " * 4, "common", "a run of words after it " * 5
    docs = [(k, f"other words {k} {'x' * 90}\n{common}\nyet others {k} {'y' * 90}") for k in range(20)]
    docs += [(30 + k, f"own {k}\n{before}\n{common}\n{after}\nend {k}") for k in range(3)]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in docs], brute_force([t for _, t in docs]), strict=True))
    assert [n for i, (_, n) in sorted(got.items()) if i > 30] == [3, 3] and got[31][0] == "own 1\nend 1"
    assert not any(n for i, (_, n) in got.items() if i <= 30)
