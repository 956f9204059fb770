"""Byte-pair encoding by a tokenization automaton.

Compilation reads the merges in order and applies one gadget for each: for a merge (u, v) -> w, wherever
an arc u is followed by an arc v, an arc w goes straight to where v led, and the target of u is replaced
by a copy that has no arc v. So each token has one target state, and that state is known by the arcs that
its copies have lost: tables of (token, lost arc, merge number), beside the two parts of each token. An arc
is looked up in those tables once and then kept as a transition (last token, next token) -> yes or no.
Of all ways to cut a word into tokens exactly one is a path of the automaton, and it is the byte-pair encoding.

Words are encoded once and remembered in a bounded table, since most words of a corpus repeat.
"""

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from martloom.llm.common import slices, texts

# The white space that the tokenizer's pattern knows, the pattern, and the byte alphabet's printable ranges.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+"
         r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+")
PRINTABLE = ((33, 126), (161, 172), (174, 255))

REMEMBERED_WORDS = 300_000
LONGEST_REMEMBERED = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    kept = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    letters = {chr(b): b for b in kept}
    others = (b for b in range(256) if b not in set(kept))
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    """Deterministic automaton over tokens, compiled from an ordered list of merges."""

    def __init__(self, token_bytes: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = max(token_bytes) + 1
        self.token_bytes = token_bytes
        self.left, self.right = [-1] * size, [-1] * size
        self.born = [0] * size
        self.reachable = [False] * size
        self.lost: list[dict[int, int] | None] = [None] * size
        made = {w for _, _, w in merges}
        for token in token_bytes:
            self.reachable[token] = token not in made
        for number, (u, v, w) in enumerate(merges, 1):
            self._add_gadget(number, u, v, w)
        self.by_bytes = {b: t for t, b in token_bytes.items()}
        self.prefixes = {b[:n]: -1 for b in token_bytes.values() for n in range(1, len(b))} | self.by_bytes
        self.length, self.shorter = [0] * size, [-1] * size
        for b, token in self.by_bytes.items():
            self.length[token] = len(b)
            self.shorter[token] = next((t for n in range(len(b) - 1, 0, -1) if (t := self.by_bytes.get(b[:n])) is not None), -1)
        self.arcs: dict[int, bool] = {}
        self.size = size

    def _add_gadget(self, number: int, u: int, v: int, w: int) -> None:
        self.left[w], self.right[w], self.born[w] = u, v, number
        self.reachable[w] = self._has_arc(u, number, v)
        if self.reachable[w]:
            lost = self.lost[u] = self.lost[u] or {}
            lost[v] = number
            if u == v:
                lost[w] = number

    def _has_arc(self, last: int, before: int, token: int) -> bool:
        """Whether the state after ``last``, as it was ``before`` that merge, has an arc ``token``."""
        while True:
            state, limit = last, before
            while True:
                lost = self.lost[state]
                if lost and lost.get(token, limit) < limit:
                    return False
                if self.right[state] < 0:
                    break
                limit = min(limit, self.born[state])
                state = self.right[state]
            if not self.reachable[token]:
                return False
            if self.left[token] < 0:
                return True
            before = min(before, self.born[token])
            token = self.left[token]

    def encode(self, word: bytes) -> list[int]:
        """The path of the automaton whose labels spell the word.

        Long arcs are tried first. A place in the word has one state only, so a place from which the
        end can't be reached is never tried again and the work stays in proportion to the word.
        """
        whole = self.by_bytes.get(word)
        if whole is not None and self._from_start(whole):
            return [whole]
        n, at, state = len(word), 0, -1
        path: list[int] = []
        dead: set[int] = set()
        shorter, length, arcs, size = self.shorter, self.length, self.arcs, self.size
        token = self._longest(word, 0)
        while True:
            while token >= 0:
                if at + length[token] not in dead:
                    key = state * size + token
                    known = arcs.get(key)
                    if known is None:
                        known = arcs[key] = self._from_start(token) if state < 0 else self._has_arc(state, size + 1, token)
                    if known:
                        break
                token = shorter[token]
            if token < 0:
                dead.add(at)
                token = path.pop()
                at -= length[token]
                state = path[-1] if path else -1
                token = shorter[token]
                continue
            path.append(token)
            at += length[token]
            if at == n:
                return path
            state = token
            token = self._longest(word, at)

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token that the word has at a place."""
        prefixes, found = self.prefixes, -1
        for end in range(at + 1, len(word) + 1):
            token = prefixes.get(word[at:end])
            if token is None:
                break
            if token >= 0:
                found = token
        return found

    def _from_start(self, token: int) -> bool:
        while self.reachable[token]:
            if self.left[token] < 0:
                return True
            token = self.left[token]
        return False


class Codec:
    """Text to ids and back for one vocabulary file of the tokenizers library (byte-level, no normalizer)."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in specials}
        token_bytes = {i: bytes(letters[c] for c in t) for t, i in plain.items()}
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self._compile(token_bytes, merges)
        self.specials = {text: np.uint32(i).tobytes() for text, i in specials.items()}
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        table = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for i, b in token_bytes.items():
            table[i] = b
        for text, i in specials.items():
            table[i] = text.encode()
        self.labels = table
        self.packed = [i.to_bytes(4, "little") for i in range(len(table))]
        self.split = regex.compile(SPLIT)
        self.irregular = re.compile(r"\s\s\s|\s\s\Z")
        self.after_space = _Words(self, " ")
        self.at_start = _Words(self, "")

    def _compile(self, token_bytes: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        self.automaton = MergeAutomaton(token_bytes, merges)

    @cached_property
    def newline(self) -> bytes:
        return self.word_ids("\n")

    def word_ids(self, text: str) -> bytes:
        """Ids of a stretch without special tokens, as little-endian unsigned 32-bit integers."""
        encode, packed = self.automaton.encode, self.packed
        return b"".join([packed[i] for w in self.split.findall(text) for i in encode(w.encode())])

    def encode(self, text: str) -> bytes:
        if self.special_pattern and any(s in text for s in self.specials):
            parts, at = [], 0
            for m in self.special_pattern.finditer(text):
                parts += [self._stretch(text[at:m.start()]), self.specials[m.group()]]
                at = m.end()
            return b"".join([*parts, self._stretch(text[at:])])
        return self._stretch(text)

    def _stretch(self, text: str) -> bytes:
        """A single space before other text always begins a word, so stretches between spaces are encoded apart.

        Longer runs of white space are cut by the pattern over the whole text.
        """
        if not text:
            return b""
        if self.irregular.search(text):
            cached = self.at_start.__getitem__
            return b"".join([cached(w) for w in self.split.findall(text)])
        first, *rest = text.split(" ")
        return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class _Words(dict):
    """Ids of words already seen; emptied when full, so memory is bounded whatever the corpus."""

    def __init__(self, codec: Codec, before: str):
        super().__init__()
        self.codec, self.before = codec, before

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            first, *lines = word.split("\n")
            if first and all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in (first, *lines)):
                start, newline = self.codec.at_start, self.codec.newline
                return self[first] + b"".join([newline + start[x] for x in lines])
        ids = self.codec.word_ids(self.before + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class LibraryCodec(Codec):
    """The same ids with new words encoded by a library, for operators that need ids but not this automaton."""

    def _compile(self, token_bytes: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        ranks = {b: i for i, b in token_bytes.items()}
        self.library = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def word_ids(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.library.encode_ordinary(text)])


_CODECS: dict[tuple, Codec] = {}


def codec_of(file_text: str, kind: type[Codec] = Codec) -> Codec:
    """One compiled codec for each vocabulary in a Python worker."""
    key = kind, hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = kind(file_text)
    return _CODECS[key]


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once on the driver and sent to the workers (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; repeated rows are encoded each; other columns are not read.
    """
    source = vocabulary(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for part in slices(batches):
            ids = [codec.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    data = texts(df, id_col, text_col)
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_ids(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the labels of the ids' arcs, joined; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    source = vocabulary(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for part in slices(batches):
            out = [codec.decode(x or b"") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    data = df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids"))
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, so ids need not leave the worker: (doc_id, n_tokens, ids, decoded)."""
    source = vocabulary(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for part in slices(batches):
            ids = [codec.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([codec.decode(x) for x in ids], pa.string()),
            ], ["doc_id", "n_tokens", "ids", "decoded"])

    data = texts(df, id_col, text_col)
    kind = data.schema["doc_id"].dataType.simpleString()
    return data.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
