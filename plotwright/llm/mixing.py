"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, ``-ln(u) / quality``, from a hash of its id and text. In its source
the smallest keys come first; the prefix sum of sizes up to the source's budget says which are taken. Whole
epochs of a source come before the part of one. The last document taken is the one that brings the sum
nearest to the budget.

Keys are never sorted in one task: histograms of sizes over the keys find, in two rounds, the narrow range in
which the budget ends, and only that range is summed document by document. The decision is then one
comparison of each row's key with its source's last key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, extended, session, slices, small, table

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3.0
SEED = 20
#: Bits of a key, and those of one round.
KEY_BITS, ROUND_BITS = 52, 10
#: Sources whose sizes the driver holds; targets of more are found in the cluster.
MOST_SOURCES = 200_000


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__pw_size`` (words) and ``__pw_quality``: 1, or half for texts whose mean word isn't of 2 to 15 bytes."""
    session(docs)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text"):
            words = [x.split() for x in found]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            letters = np.fromiter((sum(map(len, w)) for w in words), np.int64, len(words))
            mean = letters / np.maximum(sizes, 1)
            quality = np.where((mean >= 2) & (mean <= 15), 1.0, 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), pa.array(quality)], names=[*names, "__pw_size", "__pw_quality"])

    return docs.mapInArrow(run, extended(docs, "__pw_size long, __pw_quality double"))


def exponential_key(seed: int, quality: Column, *of: Column) -> Column:
    """A long that grows with ``-ln(u) / quality``; u comes from a hash of ``of``."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") + 0.5) / float(1 << 53)
    return ((1.0 - F.exp(F.log(u) / quality)) * float(1 << KEY_BITS)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> dict[str | None, float]:
    """The words that each source is to give: by weight, in the order of code points with null last, none above ``repeats`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, list(order), float(sum(sizes.values()))
    while free:
        total = sum(weigh[s] for s in free)
        full = [s for s in free if rest * weigh[s] / total > repeats * sizes[s]]
        if not full:
            out |= {s: rest * weigh[s] / total for s in free}
            break
        out |= {s: repeats * sizes[s] for s in full}
        rest -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def targets_table(sums: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """``sums(source, n)`` with ``target``, by the rule of ``targets``, for any number of sources; the driver holds sums by weight only."""
    # numbers in the order of code points: ranges of sources, each counted on its own
    order = F.struct(F.col("source").isNull().alias("last"), F.col("source").cast("binary").alias("bytes"))
    held = scratch.save(sums.withColumn("__o", order).repartitionByRange("__o").sortWithinPartitions("__o").select("source", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sizes")
    first = F.col("part").cast("long") * (1 << 33)
    counts = sorted((r.part, r.n) for r in held.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, seen = [], 0
    for part, n in counts:
        before.append((part, seen))
        seen += n
    starts = F.broadcast(held.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("at") - first + F.col("before")) % len(weights) + 1).cast("int"))
    held = scratch.save(held.join(starts, "part").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), weight.alias("weight")), "weights")
    # a source is full once the share of a unit of weight is above repeats * n / weight; the share only rises
    ratio, share = repeats * F.col("n") / F.col("weight"), None
    total = float(held.agg(F.sum("n")).first()[0] or 0)
    while True:
        full = F.lit(False) if share is None else ratio < share
        sums_ = held.agg(F.sum(F.when(full, F.col("n"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not sums_.free:
            share = float("inf")
            break
        new = (total - repeats * (sums_.full or 0)) / sums_.free
        if share is not None and new <= share:
            break
        share = new
    target = F.when(ratio < share, repeats * F.col("n")).otherwise(F.col("weight") * share)
    return held.select("source", "n", target.alias("target"))


def mix_plan(rows: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """``(source, source_size, target, epochs, last_key, tied_key, tied_rows)`` of ``rows(source, size, key)``.

    A row is taken ``epochs`` times, and once more if its key isn't above ``last_key``. ``tied_rows`` of the rows
    with the key ``tied_key`` (repeated rows, of which the budget takes a part) are taken once more as well.
    """
    spark = rows.sparkSession
    sums = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("n")), "sums")
    if sums.count() <= MOST_SOURCES:
        sizes = {r.source: r.n for r in sums.collect()}
        plan = [(s, sizes[s], t) for s, t in targets(sizes, weights, repeats).items()]
        plan = spark.createDataFrame(plan, "source string, n long, target double")
    else:
        plan = targets_table(sums, scratch, weights, repeats)
    epochs = F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(int(repeats)))).otherwise(0).cast("int")
    plan = plan.select("source", F.col("n").alias("source_size"), "target", epochs.alias("epochs"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # rest: what is to come from the range of keys that is still open; at: that range's number
    open_ = plan.select("source", "rest", F.lit(0).cast("long").alias("at"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    left = KEY_BITS
    for _ in range(2):
        inside = rows.join(open_, rows.source.eqNullSafe(open_.source)).where(F.shiftright("key", left) == F.col("at")).select(rows.source, "rest", F.shiftright("key", left - ROUND_BITS).alias("bin"), "size")
        left -= ROUND_BITS
        bins = inside.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        # the bin in which the budget ends; if it ends in none, the last one
        last = Window.partitionBy("source")
        bins = bins.withColumn("end", F.max("bin").over(last)).withColumn("hit", (F.col("before") <= F.col("rest")) & ((F.col("before") + F.col("n") > F.col("rest")) | (F.col("bin") == F.col("end"))))
        open_ = scratch.save(bins.where("hit").groupBy("source").agg(F.min("bin").alias("at"), F.min_by("before", "bin").alias("before"), F.first("rest").alias("rest")).select("source", (F.col("rest") - F.col("before")).alias("rest"), "at"), "range")
    inside = rows.join(open_, rows.source.eqNullSafe(open_.source)).where(F.shiftright("key", left) == F.col("at")).groupBy(rows.source, "key").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("at").alias("at"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # how many of a key's rows bring the sum nearest; rows of one key are repeated rows and have one size
    room = F.col("rest") - F.col("before")
    fit = F.when(F.col("n") > 0, F.floor(room * F.col("rows") / F.col("n") + 0.5)).when(room >= 0, F.col("rows")).otherwise(0)
    inside = inside.withColumn("fit", F.least(F.greatest(fit, F.lit(0)), F.col("rows")))
    whole, part = F.col("fit") == F.col("rows"), (F.col("fit") > 0) & (F.col("fit") < F.col("rows"))
    taken = inside.groupBy("source").agg(F.max(F.when(whole, F.col("key"))).alias("key"), F.max(F.when(part, F.struct(F.col("key").alias("tied_key"), F.col("fit").alias("tied_rows")))).alias("tied"))
    floor = open_.select(F.col("source").alias("s"), (F.shiftleft("at", left) - 1).alias("floor"))
    ends = floor.join(taken, floor.s.eqNullSafe(taken.source), "left").select("s", F.coalesce("key", "floor").alias("last_key"), "tied.tied_key", "tied.tied_rows")
    out = plan.join(ends, plan.source.eqNullSafe(ends.s), "left")
    open_rest = F.col("rest") > 0
    last_key = F.when(open_rest, F.coalesce("last_key", F.lit(-1))).otherwise(-1)
    tied = [F.when(open_rest, F.col(c)).cast("long").alias(c) for c in ("tied_key", "tied_rows")]
    return scratch.save(out.select("source", "source_size", "target", "epochs", last_key.cast("long").alias("last_key"), *tied), "plan")


NEW = ("size", "source_size", "target", "copies", "taken")


def _keyed(docs: DataFrame, quality: str | None, labels: DataFrame | None, seed: int) -> DataFrame:
    weight = F.coalesce(F.col(quality).cast("double"), F.lit(1.0)) if quality else F.col("__pw_quality")
    out = _measured(docs)
    if labels is not None:
        out = out.join(labels, F.col("doc_id") == F.col("__pw_id"), "left")
        weight = weight * F.when(F.col("__pw_label") == 0, 0.5).otherwise(1.0)
    return out.withColumn("__pw_key", exponential_key(seed, weight, F.col("doc_id"), F.xxhash64("text")))


def _ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Written ``rows`` with ``__pw_rank``, their number from 1 in their source; ranks are counted by task, so that no source goes to one task."""
    part = F.col("__pw_row").bitwiseAND(F.lit(-1 << 33))
    held = scratch.save(rows.withColumn("__pw_row", F.monotonically_increasing_id()), "tied")
    counts = held.groupBy("__pw_source", part.alias("__pw_part")).agg(F.count("*").alias("__pw_n"))
    ahead = Window.partitionBy("__pw_source").orderBy("__pw_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__pw_source").alias("__pw_s"), F.col("__pw_part").alias("__pw_p"), F.coalesce(F.sum("__pw_n").over(ahead), F.lit(0)).alias("__pw_start"))
    inner = F.row_number().over(Window.partitionBy("__pw_source", part).orderBy("__pw_row"))
    held = held.withColumn("__pw_inner", inner).join(starts, F.col("__pw_source").eqNullSafe(F.col("__pw_s")) & (part == F.col("__pw_p")))
    return held.withColumn("__pw_rank", F.col("__pw_start") + F.col("__pw_inner"))


def _decided(keyed: DataFrame, plan: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    plan = plan.select(*[F.col(c).alias(f"__pw_{c}") for c in plan.columns])
    rows = keyed.join(plan, F.col("source").cast("string").eqNullSafe(F.col("__pw_source")), "left")

    def taken(rows: DataFrame, more: Column) -> DataFrame:
        copies, size = F.col("__pw_epochs") + more.cast("int"), F.col("__pw_size")
        new = [size.alias("size"), F.col("__pw_source_size").alias("source_size"), F.col("__pw_target").alias("target"), copies.alias("copies"), (copies * size).alias("taken")]
        return rows.select(*[F.col(c) for c in names if c not in NEW], *new)

    whole = F.col("__pw_key") <= F.col("__pw_last_key")
    if not plan.where("__pw_tied_key is not null").take(1):
        return taken(rows, whole)
    tied = F.coalesce(F.col("__pw_key") == F.col("__pw_tied_key"), F.lit(False))
    return taken(rows.where(~tied), whole).unionByName(taken(_ranked(rows.where(tied), scratch), F.col("__pw_rank") <= F.col("__pw_tied_rows")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS, quality: str | None = None, labels: DataFrame | None = None, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; columns of these names are replaced.

    ``docs`` has ``doc_id``, ``text`` and ``source``. ``copies`` says how often a document is taken, ``taken``
    the words that makes. A column named by ``quality`` (positive; null counts as 1) replaces the built-in
    weight; ``labels(doc_id, quality)`` halves the weight of documents with a label 0 (the lowest of several counts).
    Null and empty texts have size 0. A source without words has target 0. Of equal rows the budget may take a
    part. An empty table stays empty. Runs over the same rows agree. Without text, only doc_id and source stay of
    ``docs``, and it is read once.
    """
    scratch = Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c not in NEW or c == quality]
    if labels is not None:
        labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__pw_id")).agg(F.min("quality").alias("__pw_label"))
        labels = small(scratch.save(labels, "labels"), 24)
    used = docs.select(*dict.fromkeys(["doc_id", "text", "source", *([quality] if quality else [])]))
    keys = scratch.save(_keyed(used, quality, labels, seed).select("doc_id", F.col("source").cast("string").alias("source"), "__pw_size", "__pw_key"), "keys")
    plan = mix_plan(keys.select("source", F.col("__pw_size").alias("size"), F.col("__pw_key").alias("key")), scratch, weights, repeats)
    if not with_text:
        return _decided(keys, plan, ["doc_id", "source"], scratch)
    return _decided(_keyed(docs.select(*names), quality, labels, seed), plan, names, scratch)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them."""
    return mix(docs, **options).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__pw_copy")).drop("__pw_copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for the weights 5, 2, 1; documents labelled as poor come half as likely."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), labels=labels, with_text=False)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")
