"""Byte-level BPE by speculation and verification.

Words (the pre-tokenizer's pieces) are first cut greedily into the longest tokens that match. A sequence of
tokens is what BPE makes of a word exactly if each two neighbours are compatible, that is, if BPE makes the
same two tokens of their joined bytes; all neighbours of a batch are tested at once, by undoing merges along
the border and looking for an earlier merge across it. Only words with an incompatible pair are merged
exactly. Each distinct word of a task is worked on once while it stays in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, session, slices, table
from .words import WordCache

#: The pre-tokenizer's pattern (a fixed value of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the library's older Unicode tables put in other classes, or may: texts with them are cut by the library (fixed values).
OTHER_CLASSES = "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]"
#: The same pattern for Latin-1 texts, where the classes are short lists and the standard library's engine is faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_PATTERN = f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words that a worker process holds: fewer than it could, as it shares the executor's memory.
CACHED_WORDS = 150_000
#: A longer word is merged exactly with its own heap rather than kept in the cache.
LONG_WORD = 512


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars = byte_chars()
        vocab = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        raw = {t: bytes(chars[c] for c in t) for t in vocab if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.table = [b""] * size
        for t, b in raw.items():
            self.table[vocab[t]] = b
        for t, i in self.special.items():
            self.table[i] = t.encode()
        self.byte_ids = [0] * 256
        for t, b in raw.items():
            if len(b) == 1:
                self.byte_ids[b[0]] = vocab[t]
        #: rank and result of each merge; the parts of each merged token; a token's place in the order of merges
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        for r, (a, b) in enumerate(model["model"]["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((x, y), (r, z))
            if self.rank[z] < 0 and len(self.table[z]) > 1:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        self.size = size
        self._hash_pairs()
        #: tokens that BPE makes of their own bytes; others never come out of it
        own = [i for i, b in enumerate(self.table) if b and i not in set(self.special.values())]
        self.find = {self.table[i]: i for i in own if len(self.table[i]) == 1 or self.merge(self.table[i]) == [i]}
        #: by their first four bytes, the sizes of the tokens of four bytes and more, the largest first
        sizes: dict[bytes, set[int]] = {}
        for b in self.find:
            if len(b) >= 4:
                sizes.setdefault(b[:4], set()).add(len(b))
        self.sizes = {b: sorted(x, reverse=True) for b, x in sizes.items()}
        self.pattern, self.other = regex.compile(PATTERN), regex.compile(OTHER_CLASSES)
        self.latin = re.compile(LATIN_PATTERN)
        self.path, self.library = path, None
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.lengths = np.array([len(b) for b in self.table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.cache = WordCache(CACHED_WORDS)

    # exact merging

    def merge(self, word: bytes) -> list[int]:
        """BPE as defined: the earliest merge first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best = min((merges[p][0], i) if (p := (ids[i], ids[i + 1])) in merges else (1 << 60, i) for i in range(len(ids) - 1))
            if best[0] == 1 << 60:
                break
            ids[best[1] : best[1] + 2] = [merges[ids[best[1]], ids[best[1] + 1]][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long words."""
        import heapq

        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(merges[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = merges[x, y][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in merges:
                    heapq.heappush(heap, (merges[p][0], a, *p))
        return [x for x, ok in zip(ids, alive) if ok]

    # speculation

    def propose(self, word: bytes) -> list[int]:
        """The longest matching token, again and again."""
        get, sizes, out, at, n = self.find.get, self.sizes.get, [], 0, len(word)
        while at < n:
            for size in sizes(word[at : at + 4], ()):
                if (i := get(word[at : at + size])) is not None and at + size <= n:
                    break
            else:
                for size in (3, 2, 1):
                    if (i := get(word[at : at + size])) is not None and at + size <= n:
                        break
            out.append(i)
            at += size
        return out

    def _hash_pairs(self) -> None:
        """The merges' pairs in an open hash table, for whole arrays of lookups."""
        n = 1 << max(4, (4 * len(self.merges)).bit_length())
        keys, ranks, made = np.full(n, -1, np.int64), np.full(n, 1 << 60, np.int64), np.zeros(n, np.int64)
        self.mask = n - 1
        for (x, y), (r, z) in self.merges.items():
            k = x * self.size + y
            at = (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & self.mask
            while keys[at] >= 0:
                at = at + 1 & self.mask
            keys[at], ranks[at], made[at] = k, r, z
        self.pair_keys, self.pair_ranks, self.pair_made = keys, ranks, made

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each pair; 2**60 where there is none."""
        key = a * self.size + b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask
        held = self.pair_keys[at]
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] = at[on] + 1 & self.mask
            held = self.pair_keys[at[on]]
            on = on[(held != key[on]) & (held >= 0)]
        return self.pair_ranks[at], self.pair_made[at]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` for many short words at once: in each step every word makes its earliest merge."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        ids = np.full((len(words), width), -1, np.int64)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        none = 1 << 60
        rank, made = np.full((len(words), width), none, np.int64), np.zeros((len(words), width), np.int64)
        rows, cols = np.nonzero(inside[:, 1:])
        rank[rows, cols], made[rows, cols] = self.ranks_of(ids[rows, cols], ids[rows, cols + 1])
        live = np.arange(len(words))
        while len(live):
            best = rank[live].argmin(axis=1)
            go = rank[live, best] < none
            live, best = live[go], best[go]
            if not len(live):
                break
            ids[live, best] = made[live, best]
            # close the gap behind the merged pair
            after = np.arange(width)[None, :] > best[:, None]
            src = np.minimum(np.arange(width)[None, :] + after, width - 1)
            for x, blank in ((ids, -1), (rank, none), (made, 0)):
                rowed = np.take_along_axis(x[live], src, axis=1)
                rowed[:, -1] = blank
                x[live] = rowed
            for shift in (0, -1):
                c = best + shift
                ok = (c >= 0) & (c + 1 < width)
                r, c = live[ok], c[ok]
                ok = ids[r, np.minimum(c + 1, width - 1)] >= 0
                rank[r, c], made[r, c] = none, 0
                r, c = r[ok], c[ok]
                rank[r, c], made[r, c] = self.ranks_of(ids[r, c], ids[r, c + 1])
            edge = best == width - 1
            rank[live[edge], width - 1] = none
        return [x[x >= 0].tolist() for x in ids] if width > 24 else [[i for i in x if i >= 0] for x in ids.tolist()]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE leaves the border between them.

        Merges are undone from the two tokens along the border, the later first. If at some point the two
        pieces at the border have a merge of their own that comes before the merge just undone (or, at the
        same rank, stands left of it), BPE would have joined them instead.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), 1 << 60, np.int64)  # twice the rank of the merge undone last, plus 1 if it stands right of the border
        while len(at):
            bad = 2 * self.ranks_of(a, b)[0] + 1 <= limit
            ok[at[bad]] = False
            # a piece at the right comes later than an equal one at the left, so it is undone first
            ra, rb = self.rank[a], self.rank[b]
            done = bad | ((ra < 0) & (rb < 0))
            at, a, b, ra, rb = at[~done], a[~done], b[~done], ra[~done], rb[~done]
            by_a = ra > rb
            limit = np.where(by_a, 2 * ra, 2 * rb + 1)
            a, b = np.where(by_a, self.right[a], a), np.where(by_a, b, self.left[b])
        return ok

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(out)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            ok = self.compatible(pairs // self.size, pairs % self.size)[back]
            again = np.unique(of[inner[~ok]])
            size = np.fromiter((len(words[i]) for i in again.tolist()), np.int64, len(again))
            again = again[np.argsort(size, kind="stable")].tolist()
            for at in range(0, len(again), 4096):  # words of like length together
                part = again[at : at + 4096]
                short = [i for i in part if len(words[i]) <= 64]
                for i, x in zip(short, self.merge_all([words[i] for i in short]) if short else []):
                    out[i] = x
                for i in part:
                    if len(words[i]) > 64:
                        out[i] = self.merge(words[i])
        return out

    # texts

    def pieces(self, text: str) -> list[str]:
        """Special tokens stay whole, as the library takes their strings in a text; the rest by the pattern."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.cut(text)
        out = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.cut(part)
        return out

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            if not self.other.search(text):
                return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        cache = self.cache
        cache.shrink()
        split = [self.pieces(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        every = list(chain.from_iterable(split))
        used = cache.find(every)
        missing = np.flatnonzero(used < 0).tolist()
        if missing:
            new = list(dict.fromkeys([every[i] for i in missing]))
            found = self.words([w.encode() if w not in self.special else b"" for w in new])
            cache.learn(new, [[self.special[w]] if w in self.special else x for w, x in zip(new, found)])
            used[missing] = cache.find([every[i] for i in missing])
        cache.use(used)
        flat, sizes = cache.gather(used)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens in a row."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the column ``token_ids array<int>`` of the whole ``text``; null text has no ids.

    Equal to the tokenizers library's ``encode`` with ``add_special_tokens=False``. All other columns and all
    rows stay; a column named token_ids is replaced. Empty texts have no ids; an empty table stays empty.
    """
    session(docs)
    path, docs = _path(path), docs.drop("token_ids")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, found in slices(batches, "text"):
            flat, counts = c.encode([x.decode() for x in found])
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(flat, counts)], names=[*names, "token_ids"])

    return docs.mapInArrow(run, extended(docs, "token_ids array<int>"))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with the column ``decoded string`` for ``token_ids``; broken UTF-8 becomes U+FFFD, null ids the empty text."""
    session(tokens)
    path, tokens = _path(path), tokens.drop("decoded")
    names = tokens.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column("token_ids")
            out = [c.decode(np.asarray(x.values.to_numpy() if x.is_valid else [], np.int64)).decode(errors="replace") for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return tokens.mapInArrow(run, extended(tokens, "decoded string"))


_shown: list[str] = []


def _ids_digest(ids: np.ndarray) -> str:
    if len(ids) and ids.max() >= len(_shown):
        _shown.extend(str(i) for i in range(len(_shown), int(ids.max()) + 1))
    return hashlib.sha256(",".join(map(_shown.__getitem__, ids.tolist())).encode()).hexdigest()


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each whole text encoded, and its ids decoded, in one pass.

    The same as ``decode(encode(docs))`` with digests in place of ids and text; one worker process for each
    task holds the vocabulary, where the two frames after each other need two.
    """
    session(docs)
    path = _path(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, found in slices(batches, "text"):
            flat, counts = c.encode([x.decode() for x in found])
            ids = np.split(flat, np.cumsum(counts)[:-1])
            back = [hashlib.sha256(c.decode(x).decode(errors="replace").encode()).hexdigest() for x in ids]
            cols = [pa.array(counts, pa.int64()), pa.array([_ids_digest(x) for x in ids], pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``encode(docs)`` with ``round_trip boolean``: whether the ids decode to the text (null counts as empty); columns of the two names are replaced."""
    session(docs)
    path, docs = _path(path), docs.drop("token_ids", "round_trip")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, found in slices(batches, "text"):
            flat, counts = c.encode([x.decode() for x in found])
            same = [c.decode(x) == t for x, t in zip(np.split(flat, np.cumsum(counts)[:-1]), found)]
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(flat, counts), pa.array(same, pa.bool_())], names=[*names, "token_ids", "round_trip"])

    return docs.mapInArrow(run, extended(docs, "token_ids array<int>, round_trip boolean"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded."""
    return round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"))
