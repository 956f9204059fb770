import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from martloom.llm import line_dedup, queries
from martloom.llm.common import texts
from tests.llm.conftest import HARD_TEXTS
from tests.oracle import compare, connect

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def expected(rows, min_docs, min_chars=1):
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    counts = Counter(k for _, lines in docs for k in {key_of(x) for x in lines})
    gone = {k for k, n in counts.items() if n >= min_docs and len(k) >= min_chars}
    return Counter((i, "\n".join(x for x in lines if key_of(x) not in gone), len(lines), sum(key_of(x) in gone for x in lines)) for i, lines in docs)


def result(df, **options):
    return Counter(tuple(r) for r in line_dedup.drop_frequent_lines(df, **options).select("doc_id", "text", "n_lines", "n_dropped").collect())


@pytest.mark.parametrize("min_docs, batches", [(1, 1), (2, 4), (3, 3)])
def test_against_brute_force(docs_of, min_docs, batches):
    lines = ["a", " A\t", "b", "", "  ", "C\x0b", "ünï", "Ünï", "x" * 50000, "tail  ", "tail"]
    rows = [(i, "\n".join(lines[(i * k) % len(lines)] for k in range(i % 7))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(HARD_TEXTS)] + [(7, "again\na"), (7, "again\na"), (None, "a\nq"), (None, None), (None, "a\nq")]
    assert result(docs_of(rows), min_docs=min_docs, batches=batches) == expected(rows, min_docs)


def test_short_keys_stay(docs_of):
    rows = [(i, f"ab\nabc\n{i}") for i in range(12)]
    assert result(docs_of(rows), min_docs=10, min_chars=3) == expected(rows, 10, 3)


def test_empty_table(docs_of):
    assert not result(docs_of([("", "")][:0]))


def test_runs_are_levelled_and_drop_known_lines(spark, docs_of):
    runs = line_dedup.LineRuns(spark, min_docs=3)
    try:
        sizes = []
        for number in range(5):
            runs.add(docs_of([(number * 10 + i, f"common\nonly {number} {i}") for i in range(4)]))
            sizes.append([run and spark.table(run).count() for run in runs.levels])
        assert sizes == [[5], [None, 9], [4, 9], [None, None, 17], [4, None, 17]]
        plan = runs.spark.table(runs.levels[0]).select("h1", "h2").join(
            runs.spark.table(runs.levels[2]).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert runs.frequent().count() == 1
        names = list(runs._tables)
    finally:
        runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_no_python_and_no_broadcast_of_texts(docs_of):
    plan = line_dedup.drop_frequent_lines(docs_of(["a\nb"] * 3), min_docs=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_registered_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), "op11_lines", queries.op11_lines, queries.ORACLE["op11_lines"], sf_dir) == ""
    rows = queries.op11_lines(spark, sf_dir)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    docs = [(r["doc_id"], r["text"]) for r in texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()]
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, t, n, d), m in expected(docs, 10).items() for _ in range(m))
    assert Counter(tuple(r) for r in rows.collect()) == want
    assert rows.agg(F.sum("n_dropped")).first()[0] > 0
