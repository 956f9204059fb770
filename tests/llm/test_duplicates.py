import random

import numpy as np

from martloom.llm import simhash, substring_dedup
from martloom.llm.components import components
from tests.llm import brute
from tests.llm.conftest import HARD_TEXTS


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_fingerprints_and_groups_equal_brute_force(docs_of):
    rnd = random.Random(1)
    texts = [*HARD_TEXTS, *(prose(rnd, rnd.randint(1, 60)) for _ in range(60))]
    for base in texts[-5:]:
        for _ in range(12):
            w = base.split()
            w[rnd.randrange(len(w))] = "changed"
            texts += [" ".join(w), base.upper()]
    rows = simhash.near_duplicates(docs_of(texts)).collect()
    assert len(rows) == len(texts)
    prints = [(i, brute.fingerprint(t)) for i, t in enumerate(texts)]
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in rows} == dict(prints)
    want = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_links_of_planted_and_crowded_fingerprints(spark, monkeypatch):
    rnd = random.Random(7)
    values = {rnd.getrandbits(64) for _ in range(300)}
    for center in list(values)[:4]:
        values |= {center ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60)}
    values |= {v ^ (1 << rnd.randrange(64)) for v in list(values)[:50]}
    want = brute.groups([(v, v) for v in sorted(values)], lambda a, b: (a ^ b).bit_count() <= 2)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    for crowd in (1000, 3):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        roots = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
        sets, expected = {}, {}
        for v in values:
            sets.setdefault(roots.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(7, 7), (5000, 5001), (5001, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)} | {5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_compact_windows_cover_each_long_passage():
    """Every passage of the width has exactly one window of a function that holds it and its smallest place."""
    rnd = np.random.default_rng(3)
    documents = [rnd.integers(0, 2**63, n).astype(np.uint64) for n in (5, 30, 12, 64)]
    width = 12
    for _, owner, key, left, place, right in substring_dedup.compact_windows(documents, width):
        for d, document in enumerate(documents):
            mine = np.flatnonzero(owner == d)
            for start in range(0, len(document) - width + 1):
                for end in (start + width - 1, len(document) - 1):
                    holding = [w for w in mine if left[w] <= start <= place[w] <= end <= right[w]]
                    assert len(holding) == 1
            assert all(right[w] - left[w] + 1 >= width for w in mine)


def test_passages_are_found_and_cut(docs_of):
    rnd = random.Random(11)
    shared, near = prose(rnd, 60), prose(rnd, 120).split()
    changed = list(near)
    changed[40] = "other"
    whole = prose(rnd, 80)
    texts = [
        f"{prose(rnd, 70)} {shared} {prose(rnd, 40)}", f"{prose(rnd, 10)} {shared.upper()} {prose(rnd, 90)}", shared,
        f"{prose(rnd, 30)} {' '.join(near)}", f"{' '.join(changed)} {prose(rnd, 30)}", whole, whole, whole, prose(rnd, 300),
        " ".join(shared.split()[:40]) + " " + prose(rnd, 60), *HARD_TEXTS,
    ]
    rows = substring_dedup.repeated_passages(docs_of(texts)).collect()
    found = {(r["doc_id"], r["other_id"]): r for r in rows}
    assert {d for d, _ in found} == {1, 2, 4, 6, 7}
    assert (found[1, 0]["start_word"], found[1, 0]["end_word"]) == (10, 70) and found[1, 0]["similarity"] == 1
    assert (found[2, 0]["other_start"], found[2, 0]["other_end"]) == (70, 130)
    assert (found[4, 3]["start_word"], found[4, 3]["end_word"]) == (0, 120) and found[4, 3]["similarity"] >= 0.8
    assert found[6, 5]["end_word"] == found[7, 5]["end_word"] == 80
    df = docs_of(texts)
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df, substring_dedup.repeated_passages(df)).collect()}
    assert set(range(len(texts))) - set(kept) == {2, 6, 7}
    assert kept[0] == texts[0] and kept[8] == texts[8] and kept[10] is None
    assert shared.upper() not in kept[1] and kept[1].split() == texts[1].split()[:10] + texts[1].split()[70:]
    assert substring_dedup.repeated_passages(docs_of([])).count() == 0


def test_every_planted_passage_is_reported(docs_of):
    """A passage in many documents, one long document of many passages, and near copies of one document."""
    rnd = random.Random(13)
    common = prose(rnd, 55)
    parts = [prose(rnd, 52) for _ in range(30)]
    base = prose(rnd, 200).split()
    texts = [f"{prose(rnd, 20 + i)} {common} {prose(rnd, 15)}" for i in range(60)]
    texts += [" ".join(parts)] + [f"{prose(rnd, 25)} {p}" for p in parts]
    for i in range(40):
        w = list(base)
        w[5 * i % 200] = f"edit{i}"
        texts.append(" ".join(w))
    rows = substring_dedup.repeated_passages(docs_of(texts)).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 60)) | set(range(61, 91)) | set(range(92, 131))
    for r in rows:
        assert r["other_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8


def test_a_phrase_of_the_passage_just_before_it_hides_nothing():
    """One phrase of the passage also stands some shingles before the passage, or two passages that touch here are apart there."""
    rnd = np.random.default_rng(17)
    some = lambda n: rnd.integers(0, 2**32, n).astype("<u4")
    for before in range(12, 24):
        passage = some(46)
        b = np.concatenate([some(60), passage[20:21], some(before - 1), passage, some(40)])
        found = substring_dedup.matching_segments(passage, b, 46)
        assert found == [(0, 46, 60 + before, 106 + before, 1.0)]
    one, two = some(60), some(70)
    apart = np.concatenate([some(9), two, some(200), one, some(30)])
    assert substring_dedup.matching_segments(np.concatenate([one, two]), apart, 46) == [(0, 60, 279, 339, 1.0), (60, 130, 9, 79, 1.0)]
    same = np.zeros(3000, "<u4")
    assert [x[:2] for x in substring_dedup.matching_segments(same, same, 46)] == [(0, 3000)]


def test_variants_of_a_passage_that_share_a_long_part(docs_of):
    """Of passages that share their first 30 words, later copies of each variant are found, whatever documents lie between."""
    rnd = random.Random(19)
    texts, want = [], {}
    for _ in range(30):
        start = prose(rnd, 30)
        ends = [prose(rnd, 20) for _ in range(3)]
        kinds = [0, 1, 2, *[0] * 9, 1, 0, 2]
        for i, kind in enumerate(kinds):
            if i > 2:
                want[len(texts)] = {len(texts) - i + j for j in range(i) if kinds[j] == kind}
            texts.append(f"{prose(rnd, rnd.randint(5, 30))} {start} {ends[kind]} {prose(rnd, rnd.randint(5, 30))}")
    found = {}
    for r in substring_dedup.repeated_passages(docs_of(texts)).collect():
        found.setdefault(r["doc_id"], set()).add(r["other_id"])
    assert set(found) == set(want)
    assert all(found[d] <= want[d] for d in want)


def test_a_shared_heading_makes_no_pairs_of_documents(docs_of, monkeypatch):
    """Texts that share 30 words and nothing else: rows grow with the documents, and nothing is reported."""
    rnd = random.Random(23)
    heading, sizes, stored = prose(rnd, 30), [], substring_dedup.stored

    def counted(df, label):
        out = stored(df, label)
        sizes[-1] += out.count()
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    for n in (60, 180):
        sizes.append(0)
        texts = [f"{prose(rnd, 5)} {heading} {prose(rnd, 60)}" for _ in range(n)]
        assert substring_dedup.repeated_passages(docs_of(texts)).count() == 0
    assert sizes[1] < 3.6 * sizes[0]


def test_passage_hashes_know_equal_passages():
    rnd = np.random.default_rng(29)
    one = rnd.integers(0, 2**63, 300).astype(np.uint64)
    two = np.concatenate([rnd.integers(0, 2**63, 17).astype(np.uint64), one[40:140], rnd.integers(0, 2**63, 5).astype(np.uint64)])
    a, b = substring_dedup.passage_hashes(one, 46), substring_dedup.passage_hashes(two, 46)
    assert len(a) == 255 and np.array_equal(a[40:95], b[17:72]) and len(np.intersect1d(a, b)) == 55
    assert len(substring_dedup.passage_hashes(one[:45], 46)) == 0


def test_changed_passages_in_crowded_keys_are_found(docs_of):
    """The 44 words that all texts begin with crowd the keys; of the passages after them, later copies with a changed word are found."""
    rnd = random.Random(37)
    heading = prose(rnd, 44)
    one = [f"{heading} {prose(rnd, 24)}" for _ in range(60)]
    two = []
    for text in one:
        w = text.split()
        w[47] = "changed"
        two.append(" ".join(w))
    texts = [f"{t} {prose(rnd, 6)}" for t in one] + [f"{t} {prose(rnd, 6)}" for t in two]
    least = [[[int(substring_dedup._mix(substring_dedup.shingles(substring_dedup.words_of(t)) ^ seed).min()) for seed in substring_dedup._SEEDS]
              for t in side] for side in (one, two)]
    want = {(60 + i, i) for i in range(60) if sum(a == b for a, b in zip(least[0][i], least[1][i])) >= substring_dedup.AGREE}
    found = substring_dedup.repeated_passages(docs_of(texts)).collect()
    assert len(want) > 40
    assert want <= {(r["doc_id"], r["other_id"]) for r in found}
    assert all(r["doc_id"] == 60 + r["other_id"] and r["similarity"] >= 0.8 for r in found)


def test_rarest_places_meet_every_similar_passage():
    """Of any passage, more than a fifth of what isn't repeated is marked, and unlike ends of common words are enough."""
    rnd = np.random.default_rng(41)
    for repeats in (0, 8):
        values = rnd.integers(0, 2**63, 150).astype(np.uint64)
        values[100:100 + repeats] = values[:repeats]
        marks = substring_dedup.rarest_places(values, rnd.integers(1, 50, 150), 46)
        for start in range(105):
            for end in range(start + 46, 151):
                mine = values[start:end]
                assert len(np.unique(mine[marks[start:end]])) > 0.2 * len(mine) * (1 - repeats / 46)
    counts = np.repeat([9000, 1], [34, 16])
    assert not substring_dedup.rarest_places(np.arange(50).astype(np.uint64), counts, 46)[:34].any()
    assert substring_dedup.rarest_places(np.zeros(60, np.uint64), np.ones(60, int), 46).all()


def test_repeated_words_make_few_windows():
    """Of a shingle that a text repeats, few places have a window, and every wide passage is still held by one of its least shingle."""
    rnd = np.random.default_rng(43)
    run = np.full(1000, 7, np.uint64)
    mixed = np.concatenate([run[:90], rnd.integers(0, 2**63, 60).astype(np.uint64), np.tile(np.arange(3), 40).astype(np.uint64), run[:70]])
    for number, owner, key, left, place, right in substring_dedup.compact_windows([run, mixed], 46):
        assert (owner == 0).sum() < 1000 / substring_dedup.STEP * 2
        hashes = substring_dedup._mix(mixed ^ substring_dedup._SEEDS[number])
        assert np.array_equal(key[owner == 1].view(np.uint64), hashes[place[owner == 1]])
        for start in range(len(mixed) - 45):
            for end in range(start + 45, len(mixed), 7):
                held = (owner == 1) & (left <= start) & (start <= place) & (place <= end) & (end <= right)
                assert set(key[held].view(np.uint64)) == {hashes[start:end + 1].min()}


def test_places_without_a_similar_passage_are_known():
    """Compared with all passages: none that few enough shingles of the text alone fill is left out, and a shared heading is not enough."""
    rnd = np.random.default_rng(47)
    for _ in range(20):
        values = rnd.integers(0, 30, 70).astype(np.uint64)
        counts = rnd.integers(1, 3, 30)[values.astype(int)] if rnd.random() < 0.5 else np.where(values < 26, 2, 1)
        spans = np.array([(l, l + 50, l + c, l + c + 4) for l in range(0, 20, 3) for c in (0, 20, 46)])
        may = substring_dedup.can_be_similar(values, counts, spans, 46)
        for (l, r, low, high), known in zip(spans.tolist(), may):
            for a in range(l, low + 1):
                for b in range(max(high, a + 45), r + 1):
                    alone = len(np.unique(values[a:b + 1][counts[a:b + 1] == 1]))
                    assert known or alone > 0.2 * len(np.unique(values[a:b + 1]))
    heading = np.repeat([50, 1], [34, 40])
    assert not substring_dedup.can_be_similar(np.arange(74).astype(np.uint64), heading, np.array([(0, 73, 3, 20)]), 46).any()


def test_windows_meet_within_their_document_only():
    """Pairs of windows of several documents at once are those of each document alone."""
    rnd = np.random.default_rng(53)
    documents = [rnd.integers(0, most, n).astype(np.uint64) for most, n in ((2**62, 300), (30, 200), (2**62, 46), (90, 500))]
    every = [np.concatenate(x) for x in zip(*((o, k, np.full(len(k), f), l, c, r) for f, o, k, l, c, r in substring_dedup.compact_windows(documents, 46)))]
    order = np.argsort(every[0], kind="stable")
    owner, *rows = (x[order] for x in every)
    together = set(zip(*(x.tolist() for x in substring_dedup.meeting_pairs(*rows, 46, owner))))
    alone = set()
    for d in range(len(documents)):
        one = substring_dedup.meeting_pairs(*(x[owner == d] for x in rows), 46, np.zeros((owner == d).sum(), int))
        alone |= {(d, *x) for x in zip(*(y.tolist() for y in one[1:]))}
    assert together == alone and len(alone) > 100


def test_places_of_overlapping_stretches_are_marked_together():
    """Every place that a stretch alone needs is among those of all, and stretches that lie apart have nothing in common."""
    rnd = np.random.default_rng(59)
    values, counts = rnd.integers(0, 2**63, 400).astype(np.uint64), rnd.integers(1, 9, 400)
    stretches = np.array([(0, 80), (10, 60), (40, 130), (300, 399), (300, 360)])
    marks = substring_dedup._marked(values, counts, stretches, 46)
    for a, b in stretches.tolist():
        assert marks[a:b + 1][substring_dedup.rarest_places(values[a:b + 1], counts[a:b + 1], 46)].all()
    assert not marks[131:300].any() and not substring_dedup._marked(values, counts, np.zeros((0, 2), int), 46).any()


def _similar_passages(values, l, r, low, high, width):
    """The different shingles of each passage of the width inside l to r that holds low to high."""
    return [set(values[a:b + 1].tolist()) for a in range(l, low + 1) for b in range(max(high, a + width - 1), r + 1)]


def test_repeated_shingles_are_marked_by_their_core():
    """Of every passage of a span over repeated shingles more are marked than it could lack; a common line beside them isn't."""
    rnd = np.random.default_rng(61)
    for _ in range(30):
        values = rnd.integers(0, int(rnd.choice([12, 40, 400])), 110).astype(np.uint64)
        counts = rnd.integers(1, 9, 400)[values.astype(int)]
        spans = np.array([(l, r, c, c + n) for l, r in ((0, 109), (7, 60)) for c in (10, 30, 50) for n in (0, 9, 50) if c + n <= r])
        for span in spans.tolist():
            marks, enough = substring_dedup.core_places(values, counts, np.array([span]), 46)
            marked = set(values[marks].tolist())
            assert not enough.any() or all(len(p & marked) > 0.2 * len(p) for p in _similar_passages(values, *span, 46))
    line, phrase = np.arange(9), np.arange(100, 131)
    values = np.concatenate([line, np.tile(phrase, 12)]).astype(np.uint64)
    spans = np.array([(0, len(values) - 1, 0, 7), (0, len(values) - 1, 40, 42), (0, len(values) - 1, 200, 201)])
    marks = substring_dedup._marked_spans(values, np.where(values < 9, 9000, 2), spans, 46)
    assert marks.any() and not marks[:9].any()


def test_spans_that_may_meet_another_text():
    """No passage that is similar enough is left out; texts that share a line beside repeated phrases or a word of many don't meet."""
    rnd = np.random.default_rng(67)
    for _ in range(30):
        values = rnd.integers(0, int(rnd.choice([12, 60, 4000])), 100).astype(np.uint64)
        known = rnd.random((4, 4000)) < np.array([[1], [0.9], [0.8], [0.5]])
        shared = known[:, values.astype(int)]
        spans = np.array([(l, r, c, c + n) for l, r in ((0, 99), (7, 60)) for c in (10, 30, 50) for n in (0, 9, 49) if c + n <= r])
        may = substring_dedup.may_meet(values, shared, spans, 46)
        for row, has in zip(may, known):
            for m, span in zip(row, spans.tolist()):
                assert m or all(sum(has[x] for x in p) < 0.8 * len(p) for p in _similar_passages(values, *span, 46))
    assert substring_dedup.may_meet(values, np.ones((1, 100), bool), spans, 46).all()
    phrases = np.concatenate([np.arange(9), np.tile(np.arange(100, 131), 12)]).astype(np.uint64)
    shared = np.array([phrases < 9, phrases % 6 > 0])
    assert substring_dedup.may_meet(phrases, shared, np.array([(0, 380, 3, 20), (0, 380, 90, 91)]), 46).tolist() == [[False] * 2, [True] * 2]
    bits = np.unpackbits(np.frombuffer(substring_dedup._sketch(phrases), np.uint8))
    assert bits[(phrases & np.uint64(len(bits) - 1)).astype(int)].all()
