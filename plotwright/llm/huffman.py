"""Token ids in a binary format: canonical length-limited Huffman codes, blocks, bit-offset checkpoints.

A store is a folder of two tables. ``codebook`` has one row with the code length of each id. ``segments`` has
one binary segment a row: the ids of a run of documents in ascending doc_id order, with ``part`` (the range
of doc_ids), ``seq`` (the place in it) and the number of ids beside it, so that starts need no decoding.

Segment (little endian): magic ``PWH1``, uint32 documents, uint64 ids, uint32 ids of a block, uint32 blocks,
uint32 bytes of code; then uint32 ids of each document, and uint32 bit offset of each block (the checkpoints),
and the code, most significant bit first, followed by eight zero bytes. Blocks start wherever the one before
ends; with their checkpoints they decode independently. Code lengths are at most LIMIT bits, so one table of
2**LIMIT entries decodes any code.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import Scratch, session, slices, table
from .words import WordCache

END = 2
LIMIT = 20
BLOCK = 512
#: Ids of a segment; a longer document makes a longer segment.
SEGMENT = 1 << 20
#: Ids packed at once.
PACKED = 1 << 15
#: Words given to the library as one text.
JOINED = 200
_HEAD = struct.Struct("<4sIQIII")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by packages and merging; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights, n = counts[order].astype(np.float64), len(order)
    level, single = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([weights, packs])
        at = np.argsort(every, kind="stable")
        level = every[at]
        single.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(single):
        ones = int(flags[:take].sum())
        lengths[:ones] += 1
        take = 2 * (take - ones)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    """Encodes and decodes segments with one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.short = lengths.astype(np.uint8)
        self.codes = canonical(lengths)
        self.bits = max(1, int(self.lengths.max(initial=1)))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.bits - self.lengths[order])
        ids, sizes = np.repeat(order, spans), np.repeat(self.lengths[order], spans)
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.table[: len(ids)] = ids << 5 | sizes

    def encode(self, docs: list[np.ndarray], block: int = BLOCK) -> bytes:
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        total = int(self.short[flat].sum(dtype=np.int64))
        if total >> 32:
            raise ValueError("a segment is too long")
        out, points, at = np.zeros((total >> 5) + 4, np.uint64), [], 0
        for i in range(0, len(flat), PACKED):
            part = flat[i : i + PACKED]
            sizes = self.short[part]
            if not sizes.all():
                raise ValueError("an id has no code")
            ends = np.cumsum(sizes, dtype=np.int64) + at
            starts = ends - sizes
            # a code lies in two 32-bit words at most, and codes don't overlap: those that begin in a word are united
            value = self.codes[part] << (64 - (starts & 31) - sizes).view(np.uint64)
            word = starts >> 5
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            value, word = np.bitwise_or.reduceat(value, firsts), word[firsts]
            out[word] |= value >> np.uint64(32)
            out[word + 1] |= value & np.uint64(0xFFFFFFFF)
            points.append(starts[-i % block :: block])
            at = int(ends[-1])
        points = np.concatenate([*points, np.zeros(0, np.int64)]).astype("<u4")
        code = out.astype(">u4").tobytes()[: (total + 7) // 8 + 8]
        head = _HEAD.pack(b"PWH1", len(docs), len(flat), block, len(points), len(code))
        return b"".join([head, np.fromiter(map(len, docs), "<u4", len(docs)).tobytes(), points.tobytes(), code])

    def decode(self, segment: bytes) -> list[np.ndarray]:
        magic, n_docs, n, block, n_points, n_code = _HEAD.unpack_from(segment)
        if magic != b"PWH1":
            raise ValueError("not a segment")
        at = _HEAD.size
        sizes = np.frombuffer(segment, "<u4", n_docs, at).astype(np.int64)
        points = np.frombuffer(segment, "<u4", n_points, at + 4 * n_docs).astype(np.int64)
        code = np.frombuffer(segment, np.uint8, n_code, at + 4 * (n_docs + n_points))
        # the 32 bits from each byte on, so that a lookup is one gather
        wide = code[:-3].astype(np.uint32) << 24 | code[1:-2].astype(np.uint32) << 16 | code[2:-1].astype(np.uint32) << 8 | code[3:]
        out, table, cut = np.zeros((block, n_points), np.uint32), self.table, np.uint32(32 - self.bits)
        last = n - (n_points - 1) * block if n_points else 0
        # all blocks side by side, an id of each at a time; the last may be shorter
        pos = points.astype(np.uint32)
        for i in range(block):
            if i == last and last < block:
                pos = pos[:-1]
                if not len(pos):
                    break
            found = table[(wide[pos >> np.uint32(3)] << (pos & np.uint32(7))) >> cut]
            pos = pos + (found & np.uint32(31))
            out[i, : len(pos)] = found
        flat = (out.T.reshape(-1)[:n] >> np.uint32(5)).astype(np.uint32)
        return np.split(flat, np.cumsum(sizes)[:-1]) if n_docs else []


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids by the tokenizers library, asked once for each distinct word while it stays in a cache.

    The file's pre-tokenizer drops white space and nothing joins across it, so a text's ids are those of its
    parts between ASCII white space. ASCII upper case is lowered before, as the file's normalizer does, but for
    letters that a combining mark may follow: the normalizer composes first, and some marks compose with small
    letters only. A full stop or comma after an ASCII letter is always a piece of its own or begins one.
    """

    #: A capital before a character from U+0300 on; those below are never marks.
    marked = re.compile(rb"[A-Z](?=[\xcc-\xff])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a task already
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.letters = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
        self.chars = {b: ord(c) for c, b in byte_chars().items()}
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        special = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word)]
        self.border = special[0] if special else None
        self.lowers = self._plain()
        self.cache = WordCache()

    def _plain(self) -> bool:
        """Whether the file behaves as described; if not, texts go to the library whole."""
        vocab, mark = self.library.get_vocab(with_added_tokens=False), self.library.model.end_of_word_suffix
        if not mark or not all(chr(c) + m in vocab for c in self.chars.values() for m in ("", mark)):
            return False
        self.last = np.zeros(self.size, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        one = lambda t: self.library.encode(t, add_special_tokens=False).ids
        flat, sizes = self.plain_ids(self.spelt(pa.array(["the", "\u00fcber\u00ff"]))[1])
        return one("Ab C,\td.\n\x0b\x0c\rE'S") == one("ab") + one("c") + one(",") + one("d") + one(".") + one("e") + one("'s") and [flat[: sizes[0]].tolist(), flat[sizes[0] :].tolist()] == [one("THE"), one("\u00dcber\u00ff")]

    def spelt(self, words: pa.Array) -> tuple[pa.Array, list[str], pa.Array]:
        """Words of small Latin-1 letters (one piece each, which normalisation leaves alone), these in the model's characters, and all other words."""
        ascii_ = pc.ascii_is_alpha(words)
        latin = pc.and_(pc.invert(ascii_), pc.match_substring_regex(words, self.letters))
        plain, marked = words.filter(ascii_), words.filter(latin)
        spelt = _strings(plain) + [w.encode().decode("latin-1").translate(self.chars) for w in _strings(marked)]
        return pa.concat_arrays([plain, marked]), spelt, words.filter(pc.invert(pc.or_(ascii_, latin)))

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spelt words in a row, and how many each has: only a word's last id bears the mark of a word's end."""
        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        found = [np.array(x.ids, np.int32) for x in self.model.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([*found, np.zeros(0, np.int32)])
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def lowered(self, text: bytes) -> bytes:
        if b"<|" in text:  # special tokens are found before lowering
            return text
        out = text.lower()
        if out.isascii() or not self.marked.search(text):
            return out
        out = bytearray(out)
        for m in self.marked.finditer(text):
            out[m.start()] = text[m.start()]
        return bytes(out)

    def library_ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def other_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words in a row, and how many each has. A special token stands between words given to it as one text; it is found before anything else is done to a text."""
        if self.border is None or any("<|" in w for w in words):
            found = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes
        name, number = self.border
        joined = [name.join([*words[i : i + JOINED], ""]) for i in range(0, len(words), JOINED)]
        found = [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([*found, np.zeros(0, np.int32)])
        ends = np.flatnonzero(flat == number)
        return flat[flat != number], np.diff(ends, prepend=-1) - 1

    def ask(self, words: pa.Array) -> None:
        """Learns words from the library: spelt ones by its model alone."""
        plain, spelt, other = self.spelt(words)
        self.cache.add(_strings(plain), *self.plain_ids(spelt))
        other = _strings(other)
        self.cache.add(other, *self.other_ids(other))

    def learn(self, words: pa.Array) -> None:
        """Learns distinct unknown words; those with a full stop or comma after a letter by their two parts."""
        tail = pc.match_substring_regex(words, "[A-Za-z][.,]$")
        self.ask(words.filter(pc.invert(tail)))
        tailed = words.filter(tail)
        if len(tailed):
            heads = pc.binary_slice(tailed.view(pa.binary()), 0, -1).view(pa.string())
            new = pc.unique(pa.concat_arrays([heads, pa.array([".", ","])]))
            self.ask(new.filter(pa.array(self.cache.find(_strings(new)) < 0)))
            whole = _strings(tailed)
            parts = np.stack([self.cache.find(_strings(heads)), self.cache.find([w[-1] for w in whole])], axis=1)
            flat, sizes = self.cache.gather(parts.ravel())
            self.cache.add(whole, flat, sizes.reshape(-1, 2).sum(axis=1))

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and how many each has."""
        if not self.lowers:
            found = [np.array(x, np.int64) for x in self.library_ids(texts)]
            return np.concatenate([*found, np.zeros(0, np.int64)]), np.fromiter(map(len, found), np.int64, len(found))
        cache = self.cache
        cache.shrink()
        lowered = pa.array(list(map(self.lowered, texts)), pa.binary())
        split = pc.ascii_split_whitespace(lowered.view(pa.string()))
        ends = np.cumsum(np.diff(split.offsets.to_numpy()))
        words = split.flatten().dictionary_encode()
        every = _strings(words.dictionary)
        used = cache.find(every)
        missing = np.flatnonzero(used < 0)
        if len(missing):
            self.learn(words.dictionary.take(pa.array(missing)))
            used[missing] = cache.find([every[i] for i in missing.tolist()])
        used = used[words.indices.to_numpy()]
        cache.use(used)
        flat, sizes = cache.gather(used)
        upto = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return flat, np.diff(upto, prepend=0)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        flat, sizes = self.flat(texts)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []


_encoders: dict[str, WordEncoder] = {}


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """``(doc_id, ids binary, n long)``: the library's ids of each whole text of ``docs(doc_id, text)`` and ``end``, as little-endian uint32 or, where all ids are under 65536, uint16."""
    session(docs)
    path = _path(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        e = _encoders[path]
        kind = "<u2" if max(e.size, end + 1) <= 65536 else "<u4"
        for part, found in slices(batches, "text"):
            flat, sizes = e.flat(found)
            ends = np.cumsum(sizes + 1)
            ids, inner = np.full(int(ends[-1]), end, kind), np.ones(int(ends[-1]), bool)
            inner[ends - 1] = False
            ids[inner] = flat
            offsets = np.concatenate([[0], ends * ids.itemsize])
            column = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array(sizes + 1, pa.int64())], names=["doc_id", "ids", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, n long")


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def write(tokens: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes ``tokens(doc_id, ids, n)`` as a store at ``path``.

    Counts are taken over all ids, summed in each task before they are shuffled. Rows are dealt by ranges of
    doc_id and sorted in each range; null ids come first, and rows of one doc_id are ordered by their ids'
    bytes. An empty table makes a store without segments.
    """
    spark = session(tokens)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            values, sizes = batch.column("ids").to_pylist(), batch.column("n").to_pylist()
            kind = "<u2" if sum(map(len, values)) == 2 * sum(sizes) else "<u4"
            flat = np.frombuffer(b"".join(values), kind)
            for i in range(0, len(flat), SEGMENT):
                c = np.bincount(flat[i : i + SEGMENT], minlength=len(total))
                c[: len(total)] += total
                total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = tokens.select("ids", "n").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    counts = np.zeros(int(np.max(found.column("id").to_numpy(), initial=0)) + 1, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast(lengths)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seq, held, ids, size = Coder(sent.value), 0, [], [], 0
        part = None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([coder.encode(held)], pa.binary())], names=["part", "seq", "n", "doc_ids", "segment"])
            return out

        for batch in batches:
            for p, d, x, n in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids", "n"))):
                part = p
                if held and size + n > SEGMENT:
                    yield flush()
                    seq, held, ids, size = seq + 1, [], [], 0
                held.append(_unpack(x, n))
                ids.append(d)
                size += n
        if held:
            yield flush()

    ranged = tokens.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "ids").withColumn("part", F.spark_partition_id())
    ranged.mapInArrow(packed, "part int, seq long, n long, doc_ids array<long>, segment binary").write.option("compression", "none").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, bits)`` of each document of a store, from the decoded ids.

    ``start`` counts the ids of all documents before; ``bits`` is the code's size of the segment by document.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)
    segments = spark.read.parquet(f"{path}/segments")
    # parts are as many as the range shuffle's tasks; the sums before them fit a literal
    sums = segments.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for row in sums:
        before[row.part], total = total, total + row.n
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("part", "seq", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("offset"))
    segments = segments.join(places, ["part", "seq"]) if total else segments.withColumn("offset", F.lit(0).cast("long"))
    sent = spark.sparkContext.broadcast((lengths, before))

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value[0])
        for batch in batches:
            for part, offset, ids, segment in zip(*(batch.column(c) for c in ("part", "offset", "doc_ids", "segment"))):
                docs = coder.decode(segment.as_py())
                sizes = np.fromiter(map(len, docs), np.int64, len(docs))
                starts = sent.value[1][part.as_py()] + offset.as_py() + np.cumsum(sizes) - sizes
                crcs = [zlib.crc32(x.astype("<u4").data) for x in docs]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "offset", "doc_ids", "segment").mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to the shared folder and read back."""
    scratch = Scratch(spark)
    tokens = scratch.save(token_ids(table(spark, sf_dir, "documents").select("doc_id", "text")), "tokens")
    path = scratch.path("store")
    write(tokens, path)
    scratch.drop(tokens)
    return read(spark, path)
