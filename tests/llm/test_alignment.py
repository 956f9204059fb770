import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from martloom.llm import alignment, queries
from martloom.llm.bpe import byte_letters
from tests.llm.conftest import HARD_TEXTS


def brute(rows):
    """Rows of the contract's columns by plain loops over the libraries' own ids."""
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = byte_letters()
    label_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, second.id_to_piece(i)) for i in range(second.get_piece_size()))]
    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            bytes_a, bytes_b = [bytes(letters[c] for c in first.id_to_token(i)) for i in a], [label_b[i] for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = at = bt = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if at <= bt and i < len(a):
                        group[0].append(a[i])
                        at += len(bytes_a[i])
                        i += 1
                    else:
                        group[1].append(b[j])
                        bt += len(bytes_b[j])
                        j += 1
                    if at == bt and group[1]:
                        groups.append(group)
                        group = ([], [])
        docs.append((doc_id, groups))
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), text))
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in alignment.align_documents(df, queries.BYTE_BPE, queries.PIECES).collect())


def test_hard_texts(docs_of):
    odd = ["a▁b", "<|endoftext|> x", "<0x41> <unk></s>", "\x00 q", "  two   runs  ", "ﬁn 　 ideo", "x" * 3000, "日本語のテキスト" * 50, "emoji 👩‍👩‍👧 end",
           "same text here", "\t\ttabs\n\nlines\r\n", "ab" * 700 + " " * 70 + "-" * 500, "été กำ " * 9]
    rows = [(i, t) for i, t in enumerate(HARD_TEXTS + odd)] + [(3, "repeated id"), (3, "repeated id"), (None, "no id"), (None, None)]
    assert result(docs_of(rows)) == brute(rows)


def test_small_packets_and_large_groups(docs_of, monkeypatch):
    monkeypatch.setattr(alignment, "PACKET_CHARS", 40)
    monkeypatch.setattr(alignment, "SMALL_GROUP", 1)
    found = alignment.Aligner(open(queries.BYTE_BPE, encoding="utf-8").read(), open(queries.PIECES, "rb").read())
    some = ["zzzzzzzzzzzzzzzz yyyyyyyy zzzz", "one two", "qqqqqqqqqqqqq qqqq"]
    small = found.align(some)[0].links()
    monkeypatch.setattr(alignment, "SMALL_GROUP", 10**6)
    assert all(np.array_equal(x, y) for x, y in zip(small, found.align(some)[0].links()))
    rows = [(i, t) for i, t in enumerate(some * 5)]
    assert result(docs_of(rows)) == brute(rows)


def test_empty_table(docs_of):
    assert not result(docs_of([("", "")][:0]))


def test_pointer_jumping_against_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        cuts = [np.append(np.flatnonzero(rng.random(n - 1) < share) + 1, n) for share in rng.random(2)]
        starts = [np.concatenate([[0], c[:-1]]) for c in cuts]
        last = alignment.terminals(*cuts, *starts)
        common = np.intersect1d(*cuts)
        ends = cuts[1][last]
        assert np.array_equal(ends, common[np.searchsorted(common, np.concatenate(cuts))])


@pytest.mark.parametrize("name", ["op13_alignment"])
def test_registered_query(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    assert dict(rows.dtypes) == dict.fromkeys(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], "bigint") | {"groups_sha256": "string"}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = Counter({(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else ""): n for r, n in brute(docs).items()})
    assert Counter(tuple(r) for r in rows.collect()) == want
