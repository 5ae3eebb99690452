"""Quality by hierarchical empirical Bayes: a document classifier shrunk toward its host and path."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import forget, source_key, texts

#: The classifier is fitted on at most so many labelled rows, those of the smallest seeded hash of doc_id.
SAMPLE_ROWS = 20_000
WORD_BITS = 18
WORDS = 1 << WORD_BITS
BINS, MEASURES = 32, 9
DIMENSIONS = WORDS + BINS * MEASURES
#: Words of fewer labelled documents, or whose share of bad ones is not this many deviations off, weigh nothing; nor do
#: any beyond the most deviating so many. So a sampled document brings a bounded number of features to the fit.
LEAST_DOCUMENTS, LEAST_DEVIATIONS, MOST_WORDS = 10, 3.0, 2048
EDGES = b".,;:!?\"'()"
#: Probabilities are summed as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000


def log_bin(share: float) -> int:
    return min(BINS - 1, int(3 * math.log2(1 + 1000 * share)))


def features(text: bytes | None) -> list[int]:
    """Numbers of the features that a whole text has: its distinct words, hashed, and a bin for each measure."""
    text = text or b""
    words = text.lower().split()
    n, k = max(1, len(text)), max(1, len(words))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = len(words) - 2
    measured = [
        log_bin(share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        log_bin(share(b"#*$%&|<>")),
        log_bin(share(b"!")),
        log_bin(share(b"0123456789")),
        log_bin(1 - len(set(words)) / k if words else 0),
        log_bin(1 - len(set(lines)) / len(lines) if lines else 0),
        log_bin(1 - len(set(zip(words, words[1:], words[2:]))) / windows if windows > 0 else 0),
        min(BINS - 1, int(2 * math.log2(1 + len(words)))),
        min(BINS - 1, n // k),
    ]
    hashed = {zlib.crc32(w.strip(EDGES)) & (WORDS - 1) for w in set(words)}
    return [*sorted(hashed), *(WORDS + BINS * i + v for i, v in enumerate(measured))]


def fit_weights(rows: list[np.ndarray], good: np.ndarray, steps: int = 200, ridge: float = 0.05, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on present features, by adaptive gradient steps; (weights, bias). One class: all 0."""
    weights = np.zeros(DIMENSIONS)
    if not len(rows) or good.min() == good.max():
        return weights, 0.0
    index, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = 1 - good.mean()
    bias, seen, seen_bias = math.log((1 - share) / share), np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[index], minlength=len(rows)) + bias, -30, 30))) - good
        slope = np.bincount(index, miss[row], minlength=DIMENSIONS) + ridge * weights
        seen += slope * slope
        weights -= rate * slope / np.sqrt(seen)
        seen_bias += miss.sum() ** 2
        bias -= rate * miss.sum() / math.sqrt(seen_bias)
    return weights, float(bias)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        found = [features(t) for t in texts(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "good", "mark", "features"])


def _narrowed(used: np.ndarray):
    """Only the features that are used, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row, keep = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False)), used[flat]
            ends = np.cumsum(np.bincount(row[keep], minlength=len(b)))
            left = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(flat[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), left], names=["doc_id", "good", "features"])

    return run


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            z = np.array([weights[features(t)].sum() + bias for t in texts(b.column(3))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.round(np.clip(z, -30, 30), 6))], names=["doc_id", "host", "path", "logit"])

    return run


def sampled_features(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, good, features), stored: one row for each of at most sample_rows labelled ids, whatever repeats.

    Of the texts that share an id the one of the smallest hash stands for it.
    """
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # ids and labels only
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = bare.join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text")  # sample_rows narrow rows at most
    found = joined.withColumn("mark", F.xxhash64("text"))
    mapped = found.select("doc_id", "good", "text", "mark").mapInArrow(_featurize, "doc_id long, good int, mark long, features array<int>")
    one = mapped.groupBy("doc_id", "good").agg(F.min_by("features", F.struct("mark", "features")).alias("features"))
    return materialize(one, "quality-sample")


def document_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from at most sample_rows labelled documents.

    Which words are worth a weight is worked out in Spark; the driver sees of each document those only.
    """
    rows = sampled_features(docs, labels, sample_rows)
    n, good = rows.agg(F.count("*"), F.sum("good")).first()
    if not n or good in (0, n):
        return np.zeros(DIMENSIONS), 0.0
    share = 1 - good / n
    each = rows.select(F.explode("features").alias("feature"), "good").filter(F.col("feature") < WORDS).groupBy("feature")
    counts = each.agg(F.count("*").alias("having"), F.sum(1 - F.col("good")).alias("bad"))
    off = F.abs(F.col("bad") - F.col("having") * share) / F.sqrt(F.col("having") * (share * (1 - share)))
    words = counts.filter(F.col("having") >= LEAST_DOCUMENTS).withColumn("off", off).filter(F.col("off") >= LEAST_DEVIATIONS).orderBy(F.desc("off"), "feature").limit(MOST_WORDS)
    used = np.zeros(DIMENSIONS, dtype=bool)
    used[[r["feature"] for r in words.collect()]] = True
    used[WORDS:] = True
    bare = rows.select("doc_id", "good", "features")
    narrow = bare.mapInArrow(_narrowed(used), bare.schema)
    table = narrow.toArrow()
    ids, good = table["doc_id"].to_numpy(), table["good"].to_numpy().astype(np.float64)
    lists = table["features"].combine_chunks()
    each = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    order = np.argsort(ids, kind="stable")
    return fit_weights([each[i] for i in order], good[order])


def strength(groups: DataFrame, n: str, mean: Column, prior: Column) -> float:
    """How many documents a prior is worth: a beta-binomial's, by moments over the groups. Sums only."""
    p, m = prior, mean
    v = groups.agg(F.sum(F.col(n)), F.count("*"), F.sum(F.col(n) * (m - p) * (m - p)), F.sum(F.col(n) * p * (1 - p))).first()
    total, k, between, within = (float(x or 0) for x in v)
    if k < 2 or within <= 0:
        return 100.0
    spread = (between - within * k / total) / total  # what the groups' means vary beyond chance
    usual = within / total
    return min(1e6, max(1.0, usual / spread - 1)) if spread > 0 else 1e6


def address(docs: DataFrame) -> tuple[Column, Column]:
    """(host, path) of a document: of its url where there is such a column, else its source and, below that, its language.

    A path is the host with the first part of the address behind it.
    """
    if "url" in docs.columns:
        bare = F.lower(F.regexp_replace(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
        host = source_key(F.regexp_extract(bare, r"^[^/?#]*", 0))
        return host, F.concat_ws("/", host, F.coalesce(F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1), F.lit("")))
    host = source_key(F.col("source"))
    return host, F.concat_ws("/", host, source_key(F.col("lang")))


def quality_posteriors(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, kept), one row for each document.

    A labelled document is good if its quality is 1 and it is not toxic. A word and shape classifier, fitted on a
    bounded sample of labelled rows, gives every document its evidence: the log odds beyond those of all documents.
    The documents of each host and path (see address) are summed, by label where there is one and by the classifier's
    probability elsewhere. A host's posterior is its mean shrunk toward the global one, a path's is shrunk toward its
    host's; how far, the spread between groups says. A document stands before its site without itself: its own part is
    taken out of both sums, so its evidence counts once, and the only document of a site has the global prior. quality
    joins evidence to the path's posterior as prior odds; documents at 0.5 or more are kept.

    Null texts have no words; null hosts and languages are groups of their own; labels of a repeated doc_id count as
    bad if any is; null labels are ignored. Without labels, or with labels of one class only, there is nothing to tell
    good from bad: evidence is 0 and quality the share of good ones among the labels, 1 without any. Repeated rows
    stay, and count as pages of their site; an empty table gives no rows; extra columns are ignored.
    """
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good"))
    known = materialize(known, "quality-labels")
    weights, bias = document_classifier(docs, known, sample_rows)
    host, path = address(docs)
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col("text").cast("string").alias("text"))
    scored = bare.mapInArrow(_score(weights, bias), "doc_id long, host string, path string, logit double")
    fitted = bool(np.any(weights))
    if fitted:
        share = F.round(UNIT / (1 + F.exp(-F.col("logit"))))
    else:
        n_known, n_good = known.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
        share = F.lit(UNIT if not n_known else UNIT * n_good // n_known)
    soft = F.coalesce(F.col("good") * UNIT, share).cast("long")
    # Null ids have no label; numbered, they do not meet in one task.
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    labelled = scored.withColumn("apart", apart).join(known.withColumn("apart", F.lit(0).cast("long")), ["doc_id", "apart"], "left").drop("apart")
    scored = materialize(labelled.withColumn("soft", soft), "quality-scores")
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("sum")), "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")), "quality-hosts")
    n, total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0))).first()
    prior = (total / UNIT + 1) / (n + 2)
    mean = F.col("sum") / UNIT / F.col("n")
    k_host = strength(hosts, "n", mean, F.lit(prior))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("sum").alias("host_sum"))
    paths = materialize(paths.join(hosts, "host"), "quality-sites")
    k_path = strength(paths, "n", mean, (F.col("host_sum") / UNIT + k_host * prior) / (F.col("host_n") + k_host))
    paths = paths.select("path", "host_n", "host_sum", F.col("n").alias("path_n"), F.col("sum").alias("path_sum"))
    without = lambda side, k, toward: ((F.col(f"{side}_sum") - F.col("soft")) / UNIT + k * toward) / (F.col(f"{side}_n") - 1 + k)
    out = scored.join(paths, "path").withColumn("host_posterior", without("host", k_host, F.lit(prior)))
    out = out.withColumn("path_posterior", without("path", k_path, F.col("host_posterior")))
    base = math.log(prior / (1 - prior))
    odds = lambda p: F.log(p / (1 - p))
    evidence = F.col("logit") - F.lit(base) if fitted else F.lit(0.0)
    logit = evidence + odds(F.least(F.greatest("path_posterior", F.lit(1e-9)), F.lit(1 - 1e-9)))
    out = out.withColumn("evidence", evidence).withColumn("quality", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "quality")], (F.col("quality") >= 0.5).alias("kept"))
