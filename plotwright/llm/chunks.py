"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place is the sum of a table's values for the last bytes, each doubled once for every byte
since; its low WINDOW bits depend on the last WINDOW bytes only. A chunk ends where these bits are higher than
at the SIDE places before and not lower than at the SIDE places after. So an end depends on the bytes around it
alone, and ends shift with the text when something is inserted. In a run of a period up to SIDE no hash is
higher than all before, so a run is cut at whole periods from its smallest rotation on. Chunks are compared by 128-bit digests over all documents.
The first occurrence by (doc_id, position) stays; consecutive later chunks make a repeated passage. What a
passage shares beyond its first and last whole chunk is at most a chunk's length at each end; the words of
the whole chunks decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, extended, session, slices, table

SEED = 42
#: Bytes that a hash depends on; a power of two.
WINDOW = 16
#: A chunk ends at the highest hash of this many bytes to both sides; a chunk has about twice as many.
SIDE = 28
MOST = 256
#: Bytes from which text of a period up to SIDE is a run: a passage of over 50 words has more.
RUN = 96
#: Words of a run's chunks before one may count as repeating another of the same run.
RUN_WORDS = 51
#: Words in a passage's whole chunks from which it counts as repeated: a passage of over 50 words keeps about 30 of them.
MIN_WORDS = 20
GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
_CHUNK = 1 << 20


def _highest(h: np.ndarray, width: int) -> np.ndarray:
    """The largest of each ``width`` consecutive values."""
    by = 1
    while 2 * by <= width:
        h = np.maximum(h[:-by], h[by:])
        by *= 2
    return np.maximum(h[: len(h) - (width - by)], h[width - by :]) if width > by else h


def _blocks(raw: np.ndarray) -> dict[int, np.ndarray]:
    """By period up to SIDE, starts of aligned blocks of 32 bytes that equal those a period before. Each run of RUN bytes has one."""
    out = {}
    for p in range(1, min(SIDE, len(raw) - 1) + 1):
        same = raw[p:] == raw[:-p]
        whole = np.flatnonzero((same[: len(same) // 32 * 32].view(np.uint64) == 0x0101010101010101).reshape(-1, 4).all(axis=1))
        if len(whole):
            out[p] = whole * 32 + p
    return out


def _runs(raw: np.ndarray, blocks: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """The runs ``(start, stop, period)`` of RUN bytes or more with their least periods, in order and disjoint."""
    found: list[tuple[int, int, int]] = []
    for p, starts in sorted(blocks.items()):
        breaks = np.concatenate([[p - 1], np.flatnonzero(raw[p:] != raw[:-p]) + p, [len(raw)]])
        at = np.unique(np.searchsorted(breaks, starts))
        for a, b in zip((breaks[at - 1] + 1 - p).tolist(), breaks[at].tolist()):
            if b - a >= RUN and not any(c <= a and b <= d for c, d, _ in found):
                found.append((a, b, p))
    out, last = [], 0
    for a, b, p in sorted(found):
        if b - max(a, last) >= RUN:
            out.append((max(a, last), b, p))
            last = b
    return out


def _run_cuts(text: bytes, run: tuple[int, int, int]) -> tuple[list[int], int]:
    """Places in a run that bound its chunks, and how many chunks hold RUN_WORDS words: all chunks have the same bytes."""
    a, b, p = run
    unit, stride = text[a : a + p], p * -(-(SIDE + 1) // p)
    first = a + min(range(p), key=lambda r: unit[r:] + unit[:r])
    words = len((text[first : first + p] * 2).split()) - len(text[first : first + p].split()) if unit.strip() else 0
    each = words * (stride // p)
    return list(range(first, b + 1, stride)), -(-RUN_WORDS // each) if each else 1


def ends(text: bytes) -> np.ndarray:
    """Ends of the chunks, the text's own last. Outside of runs, chunks have over SIDE bytes, but for the last and those beside a run; none has over MOST."""
    return _cut(text, _blocks(np.frombuffer(text, np.uint8)))[0]


def _cut(text: bytes, blocks: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, int]]:
    """The ends, and the number in its run of each chunk of a run but the first, by the chunk's end."""
    natural, numbers = _natural(text), {}
    if blocks:
        for run in _runs(np.frombuffer(text, np.uint8), blocks):
            cuts, cycle = _run_cuts(text, run)
            natural = np.union1d(natural[(natural < cuts[0]) | (natural > cuts[-1])], cuts)
            # a run's chunks are alike: their numbers keep a short run from repeating itself
            numbers |= {e: k % cycle for k, e in enumerate(cuts[1:])}
    out, last = [], 0
    for e in np.append(natural, len(text)).astype(np.int64).tolist():
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return np.array(out, np.int64), numbers


def _natural(text: bytes) -> np.ndarray:
    """Places where the hash is higher than around."""
    raw, found, held = np.frombuffer(text, np.uint8), [], WINDOW - 1 + SIDE
    for at in range(0, len(raw), _CHUNK):
        start = max(0, at - held)
        h, by = GEAR[raw[start : at + _CHUNK + SIDE]], 1
        while by < WINDOW:  # sums over 1, 2, 4, ... bytes
            h[by:] = h[by:] + (h[:-by] << np.uint32(by))
            by *= 2
        h = h[WINDOW - 1 :] & np.uint32((1 << WINDOW) - 1)  # the bits that the last WINDOW bytes decide alone
        if len(h) <= 2 * SIDE:
            continue
        before, after = _highest(h, SIDE), _highest(h, SIDE)
        middle = h[SIDE : len(h) - SIDE]
        place = np.flatnonzero((middle > before[: len(middle)]) & (middle >= after[SIDE + 1 : SIDE + 1 + len(middle)])) + start + WINDOW + SIDE
        found.append(place[(place > at) & (place <= at + _CHUNK)])
    return np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """``(id, key, at, start, end, words, h1, h2)``: each chunk of the texts of ``docs(doc_id, text)``; ``key`` is the text's hash, ``words`` counts the words that end in the chunk."""
    session(docs)
    schema = "id long, key long, at int, start int, end int, words int, h1 long, h2 long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part, found in slices(batches, "text"):
            # the texts are searched for runs together, as most have none
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            runs: list[dict[int, np.ndarray]] = [{} for _ in found]
            for p, at in _blocks(np.frombuffer(b"".join(found), np.uint8)).items():
                of = np.searchsorted(bounds, at, "right") - 1
                inside = (at - p >= bounds[of]) & (at + 32 <= bounds[of + 1])
                for i in np.unique(of[inside]).tolist():
                    runs[i][p] = at[inside & (of == i)] - bounds[i]
            cut = [_cut(x, b) for x, b in zip(found, runs)]
            cuts = [c for c, _ in cut]
            counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
            ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(cuts)), counts)))
            keys = np.repeat(np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64), counts)
            begin = [np.concatenate([[0], c[:-1]]) if len(c) else c for c in cuts]
            hashes, words = [], []
            for x, a, (b, numbers) in zip(found, begin, cut):
                hashes += [digest(x[i:j], numbers.get(j, 0)) for i, j in zip(a.tolist(), b.tolist())]
                raw = np.frombuffer(x, np.uint8)
                blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
                final = ~blank & np.append(blank[1:], True) if len(raw) else blank
                if len(a):
                    words.append(np.add.reduceat(final.astype(np.int32), a))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            flat = lambda xs: np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int32)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            cols = [ids, keys, at.astype(np.int32), flat(begin), flat(cuts), flat(words), both[:, 0], both[:, 1]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["id", "key", "at", "start", "end", "words", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text_key, start, end, words, first_doc_ids)``: one row for each passage that occurs before.

    ``start`` and ``end`` are byte offsets; ``first_doc_ids`` lists the documents in which its chunks come
    first (it may hold the document itself). Equal rows (same id and text) count as one document, rows
    without id come last, null and empty texts have no passage, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(chunks(docs), "chunks")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "at")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = found.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "key", "at", "start", "end", "words", F.col("first.id").alias("first_id"))
    later = later.distinct()  # equal rows
    # consecutive numbers keep their distance from the row's number
    of = Window.partitionBy("id", "key").orderBy("at")
    runs = later.withColumn("run", F.col("at") - F.row_number().over(of))
    runs = runs.groupBy("id", "key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.array_sort(F.collect_set("first_id")).alias("first_doc_ids"))
    return runs.where(F.col("words") >= min_words).select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "start", "end", "words", "first_doc_ids")


def drop_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut from ``text``. All rows and columns stay; null text stays null."""
    names = docs.columns
    spans = repeated_passages(docs.select("doc_id", "text"), min_words)
    spans = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__pw_spans"))
    spans = spans.select(F.col("doc_id").alias("__pw_id"), F.col("text_key").alias("__pw_key"), "__pw_spans")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text"):
            keys = np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys)], names=[*names, "__pw_key"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for part, found in slices(batches, "text"):
            out = []
            for x, null, gone in zip(found, part.column("text").is_null().to_pylist(), part.column("__pw_spans").to_pylist()):
                kept, last = [], 0
                for s in gone or ():
                    kept.append(x[last : s["start"]])
                    last = s["end"]
                out.append(None if null else b"".join([*kept, x[last:]]).decode(errors="ignore"))
            cols = [part.column(c) for c in names]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.mapInArrow(hashed, extended(docs, "__pw_key long")).withColumnRenamed("__pw_key", "__pw_text")
    rows = rows.join(spans, rows.doc_id.eqNullSafe(spans["__pw_id"]) & (rows["__pw_text"] == spans["__pw_key"]), "left")
    return rows.select(*names, "__pw_spans").mapInArrow(cut, docs.schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents."""
    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "end", "words", "first_doc_ids")
