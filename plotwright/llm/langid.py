"""Language identification by Bayesian evidence fusion.

For each language the posterior's logarithm is the sum of: the text's likelihood under hashed byte trigrams,
tempered since trigrams overlap; the likelihood of the declared markup language; that of the address suffix;
and the host's prior, smoothed towards its suffix's, which is smoothed towards that of all rows. The priors
come from one grouped aggregation of declared languages. A text is rejected if it has too few letters, if its
best language explains it hardly better than chance, or if the posterior is undecided.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, extended, session, slices, table

LANGUAGES = ("de", "en", "es", "fr")
#: Languages of address suffixes (fixed values); other suffixes say nothing.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "es": "es", "mx": "es", "fr": "fr"}
#: Labelled rows that the text model is fitted on: those with the smallest hashes of their doc_id.
TRAIN_ROWS = 4000
BUCKETS = 1 << 15
SMOOTHING = 0.1
#: Trigrams overlap, so they count as a third of their number.
TEMPER = 1 / 3
DECLARED_RIGHT, SUFFIX_RIGHT = 0.95, 0.9
#: Weight, in rows, of the parent when a prior is smoothed.
PARENT = 20.0
#: Rejected below: share of letters, gain over chance in nats for each trigram, posterior.
LEAST_LETTERS, LEAST_GAIN, LEAST_POSTERIOR = 0.4, 0.2, 0.6
_CHUNK = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not _LETTER[b]]] = 32


def _trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the trigrams, in chunks: ASCII letters lowered, other ASCII as a blank, a blank at both ends. Runs of blanks count no trigram."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, max(0, len(raw) - 2), _CHUNK):
        x = _FOLD[raw[at : at + _CHUNK + 2]]
        a, b, c = x[:-2], x[1:-1], x[2:]
        some = (b != 32) | ((a != 32) & (c != 32))
        yield (((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(17))[some]


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log likelihoods ``(BUCKETS, languages + 1)`` from ``labelled(doc_id, text, lang)``; the last column is the mean of all languages.

    A bounded sample of labelled rows serves: the ``rows`` with the smallest hashes of doc_id. Their whole
    texts count. Rows with null or other languages don't.
    """
    known = labelled.where(F.col("lang").isin(*languages) & F.col("doc_id").isNotNull())
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    session(labelled)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for part, found in slices(batches, "text"):
            for lang, x in zip(part.column("lang").to_pylist(), found):
                for h in _trigrams(x):
                    total[languages.index(lang)] += np.bincount(h, minlength=BUCKETS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.int64())], names=["lang", "bucket", "n"])

    # the ids are at most `rows`, so they may be broadcast
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found.column("bucket").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
    p = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)
    # by chance: any bucket that the sample has, in any language, as often as another
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    return np.column_stack([np.log(p), np.full(BUCKETS, -np.log(seen))]).astype(np.float32)


def host_priors(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``(host, prior array<double>)`` of ``rows(host, suffix, declared)``: counts of declared languages, smoothed to the suffix's and these to all rows'.

    One grouped aggregation over the rows; the levels above sum its result. Null hosts and suffixes are
    levels of their own.
    """
    counts = [F.sum(F.when(F.col("declared") == x, 1).otherwise(0)).alias(f"n_{x}") for x in languages]
    sums = [F.sum(f"n_{x}").alias(f"n_{x}") for x in languages]
    hosts = rows.groupBy("host", "suffix").agg(*counts)
    parents = hosts.groupBy("suffix").agg(*sums)
    top = parents.agg(*sums).first()
    total = sum(top[f"n_{x}"] or 0 for x in languages)
    base = [((top[f"n_{x}"] or 0) + 1.0) / (total + len(languages)) for x in languages]

    def smooth(above: list[Column]) -> list[Column]:
        n = sum((F.col(f"n_{x}") for x in languages), F.lit(0))
        return [(F.col(f"n_{x}") + PARENT * p) / (n + PARENT) for x, p in zip(languages, above)]

    parents = parents.select(F.col("suffix").alias("__pw_suffix"), F.array(*smooth([F.lit(b) for b in base])).alias("up"))
    hosts = hosts.join(parents, hosts.suffix.eqNullSafe(parents["__pw_suffix"]), "left")
    return hosts.select("host", "suffix", F.array(*smooth([F.col("up")[i] for i in range(len(languages))])).alias("prior"))


def identify(rows: DataFrame, model: np.ndarray, scratch: Scratch, languages: tuple[str, ...] = LANGUAGES, without: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``language``, ``posterior`` and ``accepted``; columns of these names are replaced, those of ``without`` don't come back.

    ``rows`` has ``text``, ``declared``, ``suffix`` and ``host``, each of which may be null and then says
    nothing (a null host has its suffix's prior). Declared languages are lowered and cut at ``-`` or ``_``. A
    rejected text has language ``und``. Null and empty texts are rejected. Repeated rows are judged alike; an
    empty table stays empty.
    """
    spark = session(rows)
    names = [c for c in rows.columns if c not in ("language", "posterior", "accepted")]
    back = [c for c in names if c not in without]
    declared = F.regexp_extract(F.lower(F.trim("declared")), "^[a-z]+", 0)
    rows = rows.select(*names, declared.alias("__pw_declared"))
    priors = scratch.save(host_priors(rows.select("host", "suffix", F.col("__pw_declared").alias("declared")), languages), "priors")
    priors = priors.select(F.col("host").alias("__pw_host"), F.col("suffix").alias("__pw_suffix"), F.col("prior").alias("__pw_prior"))
    joined = rows.join(priors, rows.host.eqNullSafe(priors["__pw_host"]) & rows.suffix.eqNullSafe(priors["__pw_suffix"]), "left").drop("__pw_host", "__pw_suffix")
    sent, n = spark.sparkContext.broadcast(model), len(languages)
    wrong = lambda right: (1 - right) / max(1, n - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = sent.value
        for part, found in slices(batches, "text"):
            out = []
            for x, d, s, prior in zip(found, *(part.column(c).to_pylist() for c in ("__pw_declared", "suffix", "__pw_prior"))):
                raw = np.frombuffer(x, np.uint8)
                marks = int(np.count_nonzero(raw > 32))
                letters = int(np.count_nonzero(_LETTER[raw])) / marks if marks else 0.0
                total, grams = np.zeros(n + 1), 0
                for h in _trigrams(x):
                    total += table_[h].sum(axis=0, dtype=np.float64)
                    grams += len(h)
                score = TEMPER * total[:n] + np.log(prior)
                for said, right in ((d, DECLARED_RIGHT), (SUFFIXES.get(s), SUFFIX_RIGHT)):
                    if said in languages:
                        score += np.log([right if y == said else wrong(right) for y in languages])
                p = np.exp(score - score.max())
                p /= p.sum()
                best = int(p.argmax())
                gain = (total[best] - total[n]) / grams if grams else -1.0
                ok = letters >= LEAST_LETTERS and gain >= LEAST_GAIN and p[best] >= LEAST_POSTERIOR
                out.append((languages[best] if ok else "und", float(p[best]), ok, gain, letters))
            kept = [part.column(c) for c in back]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=[*back, "language", "posterior", "accepted"])

    schema = extended(rows.select(*back), "language string, posterior double, accepted boolean")
    return joined.select(*names, "__pw_declared", "__pw_prior").mapInArrow(run, schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """``(page_id, text, declared, suffix, host)`` of ``pages(page_id, url, html)``: the markup without tags, its lang attribute, and the address's host and last label."""
    from .urls import host_and_path

    host, _ = host_and_path(F.col("url").cast("string"))
    html = F.col("html").cast("string")
    plain = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<[^>]*>", " ")
    lang = F.nullif(F.regexp_extract(html, "(?i)<html[^>]*?\\slang\\s*=\\s*[\"']?([A-Za-z_-]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_replace(host, ":\\d*$", ""), F.lit(""))
    return pages.select("page_id", plain.alias("text"), lang.alias("declared"), F.nullif(F.regexp_extract(host, "([a-z]+)$", 1), F.lit("")).alias("suffix"), host.alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents carry a declared language and a source, which stands for the host; they have no address. All columns stay."""
    return docs.withColumns({"declared": F.col("lang").cast("string"), "host": F.col("source").cast("string"), "suffix": F.lit(None).cast("string")})


def reject_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of documents whose language is identified, with their columns as they are."""
    names = {c: f"__pw_own_{c}" for c in docs.columns if c in ("declared", "host", "suffix", "language", "posterior", "accepted")}
    rows = document_evidence(docs.withColumnsRenamed(names))
    out = identify(rows, fit(docs.select("doc_id", "text", "lang")), Scratch(docs.sparkSession)).where("accepted")
    return out.drop("declared", "host", "suffix", "language", "posterior", "accepted").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from its text, its declared language and its source, and of every page, from its text, markup, suffix and host.

    A row has a ``doc_id`` or a ``page_id``; ``lang`` is what it declares. Documents and pages have priors of their own.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model, scratch, missing = fit(docs), Scratch(spark), F.lit(None).cast("long")
    found = identify(document_evidence(docs), model, scratch, without=("text",)).select(F.col("doc_id").cast("long"), missing.alias("page_id"), "lang", "language", "posterior", "accepted")
    # written first, so that pages and documents aren't held at once
    pages = scratch.save(identify(page_evidence(table(spark, sf_dir, "pages")), model, scratch, without=("text", "host", "suffix")), "pages")
    found = found.unionByName(pages.select(missing.alias("doc_id"), F.col("page_id").cast("long"), F.col("declared").alias("lang"), "language", "posterior", "accepted"))
    return found.select("doc_id", "page_id", "lang", "language", F.round("posterior", 6).alias("posterior"), "accepted")
