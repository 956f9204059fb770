import random

import numpy as np

from martloom.llm import toxicity
from tests.llm import brute
from tests.llm.conftest import HARD_TEXTS


def make(rnd, n):
    plain = ["".join(rnd.choice("abcdeilmnorst") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randint(20, 80))]
        toxic = int(rnd.random() < 0.25)
        for _ in range(4 * toxic):
            w.insert(rnd.randrange(len(w)), "zyqu" + rnd.choice(plain))
        texts.append(" ".join(w))
        labels.append((i, toxic))
    return texts, labels


def test_held_out_documents_with_rare_expressions(spark, docs_of):
    texts, labels = make(random.Random(1), 600)
    frame = spark.createDataFrame([*labels, (None, 1), (2, None), (10**9, 1)], "doc_id bigint, toxic int")
    rows = toxicity.score_documents(docs_of([*texts, *HARD_TEXTS]), frame).collect()
    assert len(rows) == 600 + len(HARD_TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (brute.crc_fold(r["doc_id"]) == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    right = sum(r["predicted"] == labels[r["doc_id"]][1] for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
    assert not any(r["predicted"] for r in rows if r["doc_id"] in (600, 601, 602))
    clean = toxicity.keep_clean(docs_of([*texts, *HARD_TEXTS]), frame)
    assert clean.columns == docs_of([]).columns and clean.count() == sum(1 - r["predicted"] for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark, docs_of):
    texts, labels = make(random.Random(2), 200)
    turned = [(i, 1 - t if brute.crc_fold(i) == 2 else t) for i, t in labels]
    scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score_documents(
        docs_of(texts), spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_without_both_classes(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.score_documents(docs_of(["a b", None]), none).collect()} == {(0.0, 0)}
    all_toxic = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs_of(["a b"] * 40), all_toxic).collect()} == {1.0}
    assert toxicity.score_documents(docs_of([]), none).count() == 0


def test_letters_of_other_scripts_end_no_words():
    """Words of a batch have the evidence they have alone, and only white space is white space."""
    rnd = np.random.default_rng(5)
    model = toxicity._blank()
    for table in (model.counts, model.totals, model.kinds):
        for order in table:
            table[order] = rnd.integers(1, 9, (2, toxicity.CELLS)).astype(np.float32)
    model.shared = np.full(1 << toxicity.BITS * toxicity.SHARED, 1 / 64)
    words = ["first", "\uc785\ub2c8\ub2e4", "plain", "\u8c05\u96a0", "\u0e20\u0e32", "words", "\U0001f600x", "i\u0307", "last"]
    together = model.word_evidence(words)
    assert len(together) == len(words)
    assert np.allclose(together, [model.word_evidence([w])[0] for w in words])
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lowered = [c for c in points if len(c.lower()) == 1]
    assert [c for c, x in zip(lowered, toxicity._symbols("".join(lowered))) if x == 0] == [c for c in lowered if c.isspace()]


def test_collected_counts_leave_no_memory_behind(spark):
    """What the driver held for columns of counts goes back to the system with them."""
    held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) / 1024
    frame = spark.range(4_000_000, numPartitions=8).selectExpr("CAST(id AS INT) AS cell", "CAST(id AS FLOAT) AS a", "CAST(id % 7 AS FLOAT) AS b")
    toxicity._columns(frame.limit(10))
    before = held()
    columns = toxicity._columns(frame)
    assert len(columns) == 3 and len(columns[0]) == 4_000_000 and sum(map(np.ndarray.nbytes.__get__, columns)) == 48_000_000
    assert held() - before < 48 + 16
