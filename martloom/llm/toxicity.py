"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, give a word's letters their probabilities after the five letters before. The counts of the three
longest orders belong to a class; all shorter contexts share the counts of both classes, so an expression that is too
rare for its class is smoothed alike in both and says little. A word's evidence is the difference of its log-likelihoods; a
document's features are the difference per letter over the whole text (length-normalised) and that of its most telling words.
A logistic curve turns the features into a score.

Counting covers every labelled training row and is exact up to the last step, where counts are folded into CELLS cells for
each order and class (a prime number, so the model that is sent to the workers has a fixed size). The curve is fitted on about
CURVE_ROWS training rows, chosen by a hash of their id, each judged by a model without its own fold.
"""

import pickle
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from martloom.llm.common import release, slices, small_batches, stored, texts

FOLDS = 4
HELD_OUT_FOLD = 2
THRESHOLD = 0.3
CURVE_ROWS = 20_000
ORDER = 6
SHARED = 3
BITS = 6
CELLS = 524_287
STRONG = 2.0
FLUSH = 1_000_000
FEATURES = ("mean", "top1", "top2", "top3", "strong", "words")
REMEMBERED_WORDS = 300_000

_POINTS = np.arange(sys.maxunicode + 1)
_SYMBOLS = 1 + np.where(_POINTS < 1024, _POINTS, 128 + _POINTS % 896) * 37 % 62
_SYMBOLS[ord("a"):ord("z") + 1] = np.arange(1, 27)
_SYMBOLS[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] = 0


def _symbols(text: str) -> np.ndarray:
    """6-bit symbols: 0 for white space and nothing else, letters a-z apart, all others folded together."""
    return _SYMBOLS[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]


def _grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last ORDER symbols as one number, all before the word's start being 0; and whether it counts.

    A place counts if it holds a letter or the space that ends a word.
    """
    padded = np.concatenate([np.zeros(ORDER - 1, np.int64), symbols])
    n = len(symbols)
    grams = symbols.copy()
    alive = np.ones(n, bool)
    for back in range(1, ORDER):
        before = padded[ORDER - 1 - back:ORDER - 1 - back + n]
        alive &= before > 0
        grams += np.where(alive, before, 0) << (BITS * back)
    return grams, (symbols > 0) | (padded[ORDER - 2:ORDER - 2 + n] > 0)


@dataclass
class Model:
    """Counts of the class-conditional orders by cell, and the shared probabilities of the short contexts."""

    counts: dict[int, np.ndarray]
    totals: dict[int, np.ndarray]
    kinds: dict[int, np.ndarray]
    discounts: dict[int, np.ndarray]
    shared: np.ndarray

    def differences(self, grams: np.ndarray) -> np.ndarray:
        """log p(toxic) - log p(ordinary) of each gram's last symbol."""
        logs = []
        base = self.shared[grams & ((1 << BITS * SHARED) - 1)]
        for c in (1, 0):
            p = base
            for order in range(SHARED + 1, ORDER + 1):
                part = grams & ((1 << BITS * order) - 1)
                cell, context = part % CELLS, (part >> BITS) % CELLS
                total = self.totals[order][c][context]
                d = self.discounts[order][c]
                kept = np.maximum(self.counts[order][c][cell] - d, 0)
                p = np.where(total > 0, (kept + d * self.kinds[order][c][context] * p) / np.maximum(total, 1), p)
            logs.append(np.log(np.maximum(p, 1e-12)))
        return logs[0] - logs[1]

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """One value for each word; the words are in lower case."""
        grams, counted = _grams(_symbols(" ".join(words) + " "))
        values = np.where(counted, self.differences(grams), 0)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return np.diff(np.concatenate([[0], np.cumsum(values)[ends]]))


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def count_grams(labelled: DataFrame) -> DataFrame:
    """(toxic, fold, gram, n) over all rows of (toxic, fold, text): exact counts of the longest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def merged(key: tuple) -> None:
            codes = np.concatenate([c for c, _ in held[key]])
            n = np.concatenate([m for _, m in held[key]])
            unique, at = np.unique(codes, return_inverse=True)
            held[key] = [(unique, np.bincount(at, weights=n).astype(np.int64))]

        def out(key: tuple) -> pa.RecordBatch:
            codes, n = held.pop(key)[0]
            size = len(codes)
            columns = [np.full(size, key[0], np.int32), np.full(size, key[1], np.int32), codes, n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["toxic", "fold", "gram", "n"])

        for part in slices(batches, 128):
            groups: dict[tuple, list] = {}
            for toxic, fold, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                groups.setdefault((toxic, fold), []).append(text)
            for key, found in groups.items():
                grams, counted = _grams(_symbols(" ".join(found) + " "))
                held.setdefault(key, []).append(np.unique(grams[counted], return_counts=True))
                if sum(len(c) for c, _ in held[key]) > FLUSH:
                    merged(key)
                    if len(held[key][0][0]) > FLUSH // 2:
                        yield out(key)
        for key in list(held):
            merged(key)
            yield out(key)

    rows = labelled.select("toxic", "fold", "text").mapInArrow(run, "toxic int, fold int, gram bigint, n bigint")
    return rows.groupBy("toxic", "fold", "gram").agg(F.sum("n").alias("n"))


def _blank() -> Model:
    zeros = lambda: {k: np.zeros((2, CELLS), np.float32) for k in range(SHARED + 1, ORDER + 1)}
    return Model(zeros(), zeros(), zeros(), {k: np.full(2, 0.5) for k in range(SHARED + 1, ORDER + 1)}, np.zeros(0))


def fit_models(grams: DataFrame, subsets: list[list[int]]) -> list[Model]:
    """One model for each list of folds, from exact counts (toxic, fold, gram, n), all in one pass over the counts.

    Shorter orders count the kinds of symbols before them (continuation counts). What the driver gets is at most
    CELLS rows for each class and kind of count, one order at a time.
    """
    models, every = [_blank() for _ in subsets], range(len(subsets))
    in_folds = [F.when(F.col("fold").isin(folds), F.col("n")) for folds in subsets]
    frame = grams.groupBy("toxic", "gram").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"n{i}") for i, x in enumerate(in_folds)])
    for order in range(ORDER, SHARED, -1):
        frame = stored(frame, f"grams-{order}")
        kinds = [F.count_if(F.col(f"n{i}") > 0) for i in every]
        sums = [F.sum(f"n{i}") for i in every]
        cells = frame.groupBy("toxic", F.pmod("gram", F.lit(CELLS)).cast("int").alias("cell")).agg(
            *[x.cast("float").alias(f"a{i}") for i, x in enumerate(sums)])
        toxic, cell, *values = _columns(cells)
        for model, a in zip(models, values):
            model.counts[order][toxic, cell] = a
        contexts = frame.groupBy("toxic", F.pmod(F.shiftright("gram", BITS), F.lit(CELLS)).cast("int").alias("cell")).agg(
            *[x.cast("float").alias(f"a{i}") for i, x in enumerate(sums)], *[x.cast("float").alias(f"b{i}") for i, x in enumerate(kinds)])
        toxic, cell, *values = _columns(contexts)
        for i, model in enumerate(models):
            model.totals[order][toxic, cell] = values[i]
            model.kinds[order][toxic, cell] = values[len(models) + i]
        for r in frame.groupBy("toxic").agg(*[F.count_if(F.col(f"n{i}") == k).alias(f"k{k}_{i}") for i in every for k in (1, 2)]).collect():
            for i, model in enumerate(models):
                once, twice = r[f"k1_{i}"], r[f"k2_{i}"]
                model.discounts[order][r["toxic"]] = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        if order > SHARED + 1:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
            frame = frame.groupBy("toxic", suffix.alias("gram")).agg(*[x.alias(f"n{i}") for i, x in enumerate(kinds)])
    pooled = frame.groupBy("gram").agg(*[F.max(f"n{i}").alias(f"n{i}") for i in every]).groupBy(
        F.col("gram").bitwiseAND(F.lit((1 << BITS * SHARED) - 1)).cast("int").alias("cell")).agg(
        *[F.count_if(F.col(f"n{i}") > 0).cast("float").alias(f"a{i}") for i in every])
    cell, *values = _columns(pooled)
    for model, a in zip(models, values):
        counts = np.zeros(1 << BITS * SHARED)
        counts[cell] = a
        model.shared = _shared_probabilities(counts)
    return models


def _columns(frame: DataFrame) -> list[np.ndarray]:
    """A frame's columns, one at a time; what Arrow held goes back to the system."""
    got, out = frame.toArrow(), []
    while got.num_columns:
        out.append(got.column(0).to_numpy())
        got = got.remove_column(0)
    del got
    release()
    return out


def _shared_probabilities(counts: np.ndarray) -> np.ndarray:
    """p(last symbol | symbols before) of every gram of the shared order, down to even chances."""
    n = 1 << BITS
    longer = counts.reshape(n, n, n)
    middle = (longer > 0).sum(0).astype(float)
    single = (middle > 0).sum(0).astype(float)
    d = 0.75
    p = (np.maximum(single - d, 0) + d * (single > 0).sum() / n) / max(single.sum(), 1) if single.sum() else np.full(n, 1 / n)
    for table, lower in ((middle, lambda q: q[None, :]), (longer, lambda q: q[None, :, :])):
        total = table.sum(-1, keepdims=True)
        kept = np.maximum(table - d, 0) + d * (table > 0).sum(-1, keepdims=True) * lower(p)
        p = np.where(total > 0, kept / np.maximum(total, 1), lower(p) * np.ones_like(table))
    return p.ravel()


def send(df: DataFrame, model: Model):
    """The model for the workers, packed: most cells hold small numbers or nothing."""
    return df.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))


def evidence(df: DataFrame, sent, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and each text's features: mean per letter, the three strongest words, strong words, all words."""
    names = [*keep, *FEATURES]
    columns = keep if text_col in keep else [*keep, text_col]
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        model = pickle.loads(zlib.decompress(sent.value))
        for part in slices(batches, 256):
            documents = [(t or "").lower().split() for t in part.column(at).to_pylist()]
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            new = list(set().union(*documents) - known.keys())
            if new:
                known.update(zip(new, model.word_evidence(new).tolist()))
            rows = np.zeros((len(documents), len(FEATURES)))
            for i, words in enumerate(documents):
                values = np.fromiter(map(known.__getitem__, words), float, len(words))
                if len(values):
                    top = sorted({w: v for w, v in zip(words, values.tolist()) if v > 0}.values(), reverse=True)[:3]
                    rows[i, 0] = values.sum() / sum(map(len, words))
                    rows[i, 1:1 + len(top)] = top
                    rows[i, 4] = (values > STRONG).sum()
                    rows[i, 5] = len(values)
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return small_batches(df).select(*columns).mapInArrow(run, kinds + "".join(f", {c} double" for c in FEATURES))


def _terms(log1p, clip, mean, top1, top2, top3, strong, words) -> list:
    """The curve's terms, the same for arrays and for columns."""
    return [10 * mean, clip(top1), clip(top2), clip(top3), log1p(strong), log1p(words), log1p(100 * strong / (words + 20))]


def _features(rows: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(rows)), *_terms(np.log1p, lambda x: np.clip(x, 0, 30), *rows.T)], 1)


def fit_curve(rows: np.ndarray, toxic: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the penalty keeps them finite when the classes part cleanly."""
    x = _features(rows)
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], penalty)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - shrink * w)
        w += np.clip(step, -5, 5)
    return w


@dataclass
class Scorer:
    """What is needed to score texts: the sent model and the curve's weights, or one share for all."""

    sent: object
    weights: np.ndarray | None
    share: float

    def scored(self, df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """The kept columns and ``score``."""
        if self.weights is None:
            return df.select(*keep, F.lit(self.share).alias("score"))
        rows = evidence(df, self.sent, keep, text_col)
        clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(30.0), c))
        terms = [F.lit(1.0), *_terms(F.log1p, clip, *map(F.col, FEATURES))]
        logit = sum((F.lit(float(w)) * t for w, t in zip(self.weights, terms)), F.lit(0.0))
        return rows.select(*keep, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))).alias("score"))


def fit_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", curve_rows: int = CURVE_ROWS) -> Scorer:
    """Models of all labelled training rows, and the curve.

    ``labels`` has (doc_id, toxic); rows of null ids or labels are not used, of several labels the largest holds. Repeated
    rows are counted each. While a fold has no training rows of a class, the scorer gives the share of toxic training labels (0
    without any).
    """
    fold = fold_of(F.col("doc_id"))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = lambda df: df.where(fold != HELD_OUT_FOLD)
    # Labels grow with the documents, so they are joined as a large table whatever their size just now.
    labelled = usable(texts(docs, id_col, text_col)).join(usable(known).hint("merge"), "doc_id").select("doc_id", "toxic", fold.cast("int").alias("fold"), "text")
    grams = stored(count_grams(labelled), "grams")
    classes = {r["toxic"]: r["n"] for r in usable(known).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = {(r["toxic"], r["fold"]) for r in grams.select("toxic", "fold").distinct().collect()}
    folds = [f for f in range(FOLDS) if f != HELD_OUT_FOLD]
    if counted != {(t, f) for t in (0, 1) for f in folds}:
        return Scorer(None, None, classes.get(1, 0) / sum(classes.values()) if classes else 0.0)
    part = min(1.0, curve_rows / sum(classes.values()))
    chosen = stored(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))), "curve-rows")
    models = fit_models(grams, [folds, *[[x for x in folds if x != f] for f in folds]])
    unseen = []
    for f in folds:
        sent = send(chosen, models.pop(1))
        unseen.append(evidence(chosen.where(F.col("fold") == f), sent, ["toxic"]).toArrow())
        sent.destroy()
    sample = pa.concat_tables(unseen)
    weights = fit_curve(np.stack([sample.column(c).to_numpy() for c in FEATURES], 1), sample.column("toxic").to_numpy().astype(float))
    sent = send(chosen, models.pop())
    del sample, unseen
    release()
    return Scorer(sent, weights, 0.0)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", curve_rows: int = CURVE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text is scored like any other, without evidence; a null id is not held out. An empty table gives no rows.
    """
    scorer = fit_scorer(docs, labels, id_col, text_col, curve_rows)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    scored = scorer.scored(texts(docs, id_col, text_col), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below THRESHOLD, with all their columns."""
    scored = fit_scorer(docs, labels, id_col, text_col).scored(docs, docs.columns, text_col)
    return scored.where(F.col("score") < THRESHOLD).select(*docs.columns)
