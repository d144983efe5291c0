"""SimHash near-duplicates: segment bit counts, a grid range join under Manhattan distance, an exact check.

A 64-bit fingerprint is cut into 32 segments of two bits. The segments' bit counts are kept in unary inside
one long (00, 01, 11), so the Manhattan distance of two count vectors is ``bit_count(s XOR t)``; it never
exceeds the Hamming distance. The 32 coordinates lie in five bands. A Manhattan ball of radius two leaves at
least three bands unchanged, so two fingerprints within it share a grid cell of one of the ten triples of
bands. Pairs of a cell pass the Manhattan bound and then the exact distance. A cell with more than
``CELL_PAIRS`` distinct fingerprints isn't paired: its fingerprints meet at midpoints instead. Two values
differ in two bits or fewer exactly if some value lies within one bit of both, so each fingerprint goes to
the 65 values around it and is linked to the smallest one met there; that is exact as well, and linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, session, slices, small, table
from .graph import connected_components

SEED = 42
CELL_PAIRS = 32
#: Segments in each band of the grid.
BANDS = (7, 7, 6, 6, 6)
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 16
VIEWS = 12
VIEW_SHINGLES = 3
SIMILARITY = 0.8
STAGE_WORDS = 5
#: The share of a set by which prefixes are lengthened to ask for as many more shared shingles.
MORE = 0.02
#: Counters of shingles by hash; they order shingles by rarity, and any order gives the same result.
COUNTERS = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles, in chunks. Fewer words than asked for: one shingle of all; none: nothing."""
    found = text.lower().split()
    if not found:
        return
    if len(found) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts, ends = [0, *(ends[:-1] + 1).tolist()], ends.tolist()
    digest, last = xxhash.xxh64_intdigest, len(found) - words + 1
    for at in range(0, last, CHUNK):
        to = min(at + CHUNK, last)
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + words - 1 : to + words - 1])], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash as an unsigned number: a bit is 1 if set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of each row of ``docs(doc_id, text)``."""
    session(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text"):
            fps = pa.array([_signed(fingerprint(x, words)) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), fps], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary."""
    even = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(even), 1))


def _cells(max_distance: int) -> list[int]:
    """Masks over the unary counts: all choices of the bands that stay as they are."""
    masks, at = [], 0
    for n in BANDS:
        masks.append(((1 << (2 * n)) - 1) << at)
        at += 2 * n
    return [_signed(sum(c)) for c in combinations(masks, len(BANDS) - max_distance)]


def links(fps: DataFrame, scratch: Scratch, max_distance: int = 2) -> DataFrame:
    """Links ``(a, b)`` between the distinct values of ``fps(fp)`` that suffice for their components.

    Every two fingerprints within ``max_distance`` (0 to 2) bits are joined by a path of returned links, and
    each link is within it. Cells of at most CELL_PAIRS values give all their pairs.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    if not max_distance:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    cells = fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
    each = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_cells(max_distance))])
    cells = cells.select("fp", "counts", F.inline(each))
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(cells.join(sizes, ["grid", "cell"]), "cells")
    few = shared.where(F.col("n") <= CELL_PAIRS)
    left = few.select("grid", "cell", F.col("fp").alias("a"), F.col("counts").alias("ca"))
    right = few.select("grid", "cell", F.col("fp").alias("b"), F.col("counts").alias("cb"))
    pairs = left.join(right, ["grid", "cell"]).where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= max_distance)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    )
    many = shared.where(F.col("n") > CELL_PAIRS).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    met = many.select("fp", F.explode(around).alias("middle"))
    if max_distance == 1:
        # one bit apart: one of the two is itself the value met at
        met = met.groupBy("middle").agg(F.min("fp").alias("least"), F.max(F.col("fp") == F.col("middle")).alias("own")).where("own")
        through = many.select("fp", F.explode(around).alias("middle")).join(met, "middle").select(F.col("middle").alias("a"), F.col("fp").alias("b"))
    else:
        least = met.groupBy("middle").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
        through = met.join(least, "middle").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.select("a", "b").unionByName(through.where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for each row of ``docs(doc_id, text)``.

    Documents whose SimHash over ``words``-word shingles differs in ``max_distance`` bits or fewer are linked;
    ``component_id`` is the smallest doc_id reachable. Null text and text of white space have fingerprint zero
    and are linked like others. Repeated rows stay. A null doc_id takes part, but names a component only as
    null, where no row of the component has an id. An empty table gives an empty result.
    """
    spark = session(docs)
    scratch = Scratch(spark)
    rows = scratch.save(fingerprints(docs, words), "fingerprints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(links(classes, scratch, max_distance), scratch)
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("fp", "component_id"), "named")
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sampled(h: np.ndarray, odd: np.ndarray) -> list[int]:
    """SimHashes of the VIEW_SHINGLES smallest hashes by each of the orders."""
    row, mixed = [], h ^ (h >> np.uint64(29))
    for m in odd:
        order = mixed * m
        least = h[np.argpartition(order, VIEW_SHINGLES - 1)[:VIEW_SHINGLES]] if len(h) > VIEW_SHINGLES else h
        ones = np.unpackbits(least.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        row.append(int(np.packbits(2 * ones > len(least), bitorder="little").view("<i8")[0]) if len(least) else 0)
    return row


def _distinct(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.concatenate([*shingle_hashes(text, words), np.zeros(0, np.uint64)]))


def _popularity(keyed: DataFrame, words: int) -> np.ndarray:
    """How many distinct shingles of the texts of ``keyed(key, text)`` fall on each of COUNTERS counters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, found in slices(batches, "text"):
            for x in found:
                total += np.bincount(_distinct(x, words) % np.uint64(COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    found = keyed.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefix(n: int, similarity: float) -> int:
    """How many of a set's ``n`` shingles, the first in one order of all shingles, meet those of every set similar to it."""
    return min(n, int((1 - similarity) * n + 1e-6) + 1)


def _views(keyed: DataFrame, words: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """``(key, fp, views array<long>, size, score, rare array<long>)`` of ``keyed(key, text)``.

    ``size`` counts the distinct shingles, ``score`` is their mean popularity, and ``rare`` has the prefix of
    them in the order of rarity; a text without words has a single zero there.
    """
    odd = np.random.default_rng(SEED).integers(0, 1 << 62, VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sent = keyed.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        popular = sent.value
        for part, found in slices(batches, "text"):
            fps, views, sizes, scores, rare = [], [], [], [], []
            for x in found:
                h = np.concatenate([*shingle_hashes(x, words), np.zeros(0, np.uint64)])
                ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
                fps.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]) if len(h) else 0)
                h = np.unique(h)
                views.append(_sampled(h, odd))
                often = popular[h % np.uint64(COUNTERS)]
                sizes.append(len(h))
                scores.append(float(often.mean()) if len(h) else 0.0)
                # the sort is stable: equally rare shingles stay in the order of their hashes
                rare.append(h[np.argsort(often, kind="stable")[: _prefix(len(h), similarity)]].view(np.int64) if len(h) else np.zeros(1, np.int64))
            longs = pa.list_(pa.int64())
            cols = [part.column("key"), pa.array(fps, pa.int64()), pa.array(views, longs), pa.array(sizes, pa.int32()), pa.array(scores, pa.float64()), pa.array(rare, longs)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", "views", "size", "score", "rare"])

    return keyed.mapInArrow(run, "key string, fp long, views array<long>, size int, score double, rare array<long>")


def _sizes_fit(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(n, m) + 1e-6 >= similarity * F.greatest(n, m)


def _unlinked(views: DataFrame, found: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of keys that hold every similar pair of ``views`` whose ends have different roots in ``found(node, root)``.

    Two similar sets share a shingle among the first of both, in any one order of all shingles (prefix
    filter), and k of them among the first of both and k - 1 more; k is 1 and MORE of the smaller set, as far as
    the prefixes reach. Their sizes bound the similarity too.
    """
    texts = views.join(found, views.key == found.node, "left").select("key", F.xxhash64("key").alias("id"), F.xxhash64(F.coalesce("root", "key")).alias("root"))
    texts = scratch.save(texts, "roots")
    rows = views.select(F.xxhash64("key").alias("id"), F.col("size").alias("n"), F.posexplode("rare").alias("i", "shingle"))
    of = Window.partitionBy("shingle")
    rows = rows.withColumns({"low": F.min("id").over(of), "high": F.max("id").over(of)}).where("low <> high").drop("low", "high")
    rows = rows.join(small(texts, 24).select("id", "root").distinct(), "id")
    rows = rows.withColumns({"low": F.min("root").over(of), "high": F.max("root").over(of)}).where("low <> high").drop("low", "high")
    rows = scratch.save(rows, "prefixes")
    a, b = (rows.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "root", "n", "i")]) for s in "ab")
    # so many shingles similar sets share, and so many of the first ones of both, if these parts are that much longer
    needed = F.ceil(similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    room = [F.least(F.col(n), F.floor((1 - similarity) * F.col(n) + 1e-6) + 1) - F.col(n) + needed for n in ("n_a", "n_b")]
    more = F.greatest(F.lit(1), F.least(1 + F.floor(MORE * F.least("n_a", "n_b")), *room))
    early = (F.col("i_a") < F.col("n_a") - needed + more) & (F.col("i_b") < F.col("n_b") - needed + more)
    pairs = a.join(b, "shingle").where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit(F.col("n_a"), F.col("n_b"), similarity) & early)
    pairs = pairs.groupBy("id_a", "id_b").agg(F.count("*").alias("both"), F.first(more).alias("more")).where("both >= more").select("id_a", "id_b")
    for s in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(f"id_{s}"), F.col("key").alias(s)), f"id_{s}")
    out = scratch.save(pairs.select("a", "b"), "unlinked")
    for table_ in (rows, texts):
        scratch.drop(table_)
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays share, repeated ones as often as both have them."""
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _united(found: DataFrame | None, pairs: DataFrame, keyed: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Components ``(node, root)`` of ``found`` and of those ``pairs(a, b)`` of keys whose sets of shingles have a Jaccard similarity of ``similarity`` or more."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text"):
            held = [_distinct(x, words) for x in found]
            short = [np.sort(x.astype(np.uint16)).tobytes() for x in held]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([x.tobytes() for x in held], pa.binary()), pa.array(short, pa.binary())], names=["key", "shingles", "short"])

    def judged(kind: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                    x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                    both = _shared(x, y)
                    keep.append(both >= similarity * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return judge

    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # equal texts are united in each task before the shuffle; one text may make up a third of all rows
    held = keyed.dropDuplicates(["key"]).join(asked, "key", "left_semi").select("key", "text").mapInArrow(sets, "key string, shingles binary, short binary")
    held = scratch.save(held, "shingles")
    of = lambda name, column, as_: held.select(F.col("key").alias(name), F.col(column).alias(as_))
    # two bytes of each shingle never show less in common than there is, and spare most pairs the whole hashes
    likely = pairs.join(of("a", "short", "sa"), "a").join(of("b", "short", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(judged(np.uint16), "a string, b string")
    likely = scratch.save(likely, "likely")
    similar = likely.join(of("a", "shingles", "sa"), "a").join(of("b", "shingles", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(judged(np.uint64), "a string, b string")
    if found is not None:
        similar = similar.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    out = connected_components(similar, scratch)
    scratch.drop(held)
    return out


def drop_near_duplicates(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates; all columns stay.

    Texts are similar if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or
    more; groups are the components of that relation, and the row with the smallest doc_id stays. At a
    similarity of 0.8 two 64-bit fingerprints differ in up to 18 bits, where no bound from bit counts prunes
    anything. So candidates first share a grid cell of the whole fingerprint at two bits (see ``links``), or have
    equal SimHashes of a sample of VIEW_SHINGLES shingles, for one of VIEWS samples: each text of a cell is
    compared with the cell's first and last member and the one of the most common shingles, in a star the
    middle. That unites most groups at little cost. Then every pair of different groups that a prefix filter
    can't exclude is judged as well (see ``_unlinked``), so no link between groups is lost. The exact
    similarity decides both times. Texts that share rare shingles and yet aren't similar are judged pair by pair.

    Null texts count as empty; texts without words are similar to each other only. Rows without doc_id come
    after all others; repeated rows are near-duplicates. An empty table gives an empty result.
    """
    spark = session(docs)
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    seen = scratch.save(_views(keyed, words, similarity, _popularity(keyed, words)), "views")
    views = scratch.save(seen.dropDuplicates(["key"]), "texts")
    scratch.drop(seen)
    text_ = F.struct("key", "size").alias("text")
    cells = views.select(text_, "score", F.posexplode("views").alias("view", "value"))
    cells = cells.unionByName(views.select(text_, "score", F.lit(-1).alias("view"), F.col("fp").alias("value")))
    middle = F.max(F.struct("score", "text"))
    ends = cells.groupBy("view", "value").agg(F.min("text").alias("low"), F.max("text").alias("high"), middle.alias("middle"), F.count("*").alias("n")).where("n > 1")
    met = cells.drop("score").join(ends, ["view", "value"])
    met = met.select("text", F.explode(F.array("low", "high", "middle.text")).alias("other")).where(_sizes_fit(F.col("text.size"), F.col("other.size"), similarity))
    met = met.select("text.key", F.col("other.key").alias("other")).where("key <> other")
    whole = views.groupBy("fp").agg(F.min("key").alias("key"))
    near = links(whole.select("fp"), scratch)
    first, second = whole.select(F.col("fp").alias("a"), F.col("key").alias("ka")), whole.select(F.col("fp").alias("b"), F.col("key").alias("kb"))
    near = near.join(first, "a").join(second, "b").select(F.col("ka").alias("key"), F.col("kb").alias("other"))
    pairs = met.unionByName(near).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    pairs = scratch.save(pairs, "pairs")
    found = _united(None, pairs, keyed, words, similarity, scratch)
    pairs = _unlinked(views, found, similarity, scratch)
    scratch.drop(views)
    if pairs.take(1):
        found = _united(found, pairs, keyed, words, similarity, scratch)

    ids = docs.select("doc_id", F.md5(text.cast("binary")).alias("key"))
    counted = scratch.save(ids.groupBy("doc_id", "key").agg(F.count("*").alias("rows")), "ids")
    rooted = counted.join(found, counted.key == found.node, "left").select("doc_id", "key", "rows", F.coalesce("root", "key").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    stays = rooted.groupBy("root").agg(F.min(order).alias("least"))
    # joined by the row, not by the group: one group may hold a third of all rows
    stays = stays.select(F.col("least.doc_id").alias("__pw_id"), F.col("least.key").alias("__pw_key"))
    judged = rooted.join(stays, rooted.doc_id.eqNullSafe(stays["__pw_id"]) & (rooted.key == stays["__pw_key"]), "left")
    judged = judged.select("doc_id", "key", "rows", F.col("__pw_key").isNotNull().alias("stays"))
    judged = scratch.save(judged, "judged")
    gone = small(scratch.save(judged.where("not stays").select("doc_id", "key"), "gone"), 160).select(F.col("doc_id").alias("__pw_id"), F.col("key").alias("__pw_key"))
    kept = docs.withColumn("__pw_text_key", F.md5(text.cast("binary")))
    kept = kept.join(gone, kept.doc_id.eqNullSafe(gone["__pw_id"]) & (kept["__pw_text_key"] == gone["__pw_key"]), "left_anti")
    if judged.where("stays and rows > 1").take(1):
        kept = kept.dropDuplicates(["doc_id", "__pw_text_key"])
    return kept.select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two bits or fewer, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, max_distance=2)
