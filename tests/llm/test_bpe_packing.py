import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from martloom.llm import bpe, packing
from tests.llm.conftest import HARD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codecs():
    text = open(PATH, encoding="utf-8").read()
    return bpe.Codec(text), bpe.LibraryCodec(text)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_automaton_equals_library_on_random_text(library, codecs):
    rnd = random.Random(5)
    letters = "abthein  \n\t'séç日.,!01<|endoftext|>\x1c  😀²Ⅷ"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        if rnd.random() < 0.2:
            text = text[:7] + "<|endoftext|>" + text[7:]
        for codec in codecs:
            ids = codec.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)
            assert codec.decode(ids) == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_automaton_by_gadgets_on_tiny_merges():
    """Repeated letters, overlapping merges and unreachable tokens, against merging pair by pair."""
    rnd = random.Random(2)
    for _ in range(60):
        tokens = {0: b"a", 1: b"b"}
        merges = []
        while len(tokens) < 10:
            u, v = rnd.choice(list(tokens)), rnd.choice(list(tokens))
            if tokens[u] + tokens[v] not in tokens.values():
                tokens[len(tokens)] = tokens[u] + tokens[v]
                merges.append((u, v, len(tokens) - 1))
        automaton = bpe.MergeAutomaton(tokens, merges)
        for _ in range(40):
            word = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 14)))
            seq = [0 if c == 97 else 1 for c in word]
            for u, v, w in merges:
                out, i = [], 0
                while i < len(seq):
                    if seq[i:i + 2] == [u, v]:
                        out.append(w)
                        i += 2
                    else:
                        out.append(seq[i])
                        i += 1
                seq = out
            assert automaton.encode(word) == seq


def test_round_trip_of_hard_texts(spark, docs_of, library):
    df = docs_of(HARD_TEXTS)
    for r in bpe.round_trip(df, PATH).collect():
        assert r["decoded"] == (HARD_TEXTS[r["doc_id"]] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids_of(library, HARD_TEXTS[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"]) // 4
    encoded = bpe.encode_texts(df, PATH)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(HARD_TEXTS)}
    assert bpe.round_trip(docs_of([]), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 681, 682, 683, 1023, 1500, 2047, 2048, 2049, 10000])
def test_cut_lengths(n):
    pieces = packing.cut_lengths(n, 2048)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)
    for p in pieces:
        slot = 2048 // (2048 // p)
        assert (slot - p) * 32 <= slot


def test_packing_keeps_every_id_once(spark, docs_of, library):
    texts = [*HARD_TEXTS, *("the quick brown fox " * n for n in range(1, 120)), (3, "an id that comes again with more words")]
    df = docs_of([(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]).repartition(5)
    got = packing.pack_documents(df, PATH).toPandas()
    want = sorted(np.array(ids_of(library, t if not isinstance(t, tuple) else t[1]) + [1], "<u4").tobytes() for t in texts)
    by_doc = {}
    for (doc, n), g in got.groupby(["doc_id", "doc_tokens"]):
        if doc != 3:
            g = g.sort_values("start")
            assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        by_doc[doc, n] = b"".join(g["ids"])
    assert sorted(by_doc.values()) == want
    fill = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert g["length"].sum() <= 2048
        fill += g["length"].sum()
    assert got["sequence_id"].nunique() <= 2 + 1.05 * fill / 2048
    assert all(zlib.crc32(i) >= 0 and len(i) == 4 * n for i, n in zip(got["ids"], got["length"]))
    assert packing.pack_documents(docs_of([]), PATH).count() == 0
