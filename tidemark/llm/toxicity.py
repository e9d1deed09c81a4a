"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled, not clean. The risk of
a classifier on clean text is what it risks on unlabelled text as if all of it were clean, less
the class prior's share of what it risks on positives; where a mini-batch makes that difference
negative, the step goes back up it (Kiryo et al., 2017). Features are the presence of hashed
words and beginnings of words; the model is linear, trained in numpy on a bounded sample and applied to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .words import map_texts, mixed, pieces, small_batches, span_hash, split

BUCKETS = 1 << 20
#: Bytes of a word's beginnings that are features beside the word, so that inflected forms share evidence.
PREFIXES = (4, 5, 6, 7, 8)
#: The sample that is fitted: at most so many positives and unlabelled texts.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 12000
#: Buckets that the model may use: those whose presence differs most between the two samples.
FEATURES = 2000
LEAST_Z, LEAST_FEATURES, LEAST_TEXTS = 4.5, 60, 5
EPOCHS, BATCH, RATE, DECAY = 30, 512, 0.05, 1e-3
#: The decision threshold lies where the predicted share of unlabelled texts is within these multiples of the prior.
NEAR_PRIOR = (1.15, 0.8)
FOLDS = 5
#: ASCII characters other than letters and digits.
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word without the marks around it, and of its beginnings, repeats included."""
    w = split(data, offsets)
    mark = _MARK[data]
    # Marks are skipped at either end of a word: to the next and from the last byte that is none.
    plain = np.flatnonzero(~mark)
    start = plain[np.minimum(np.searchsorted(plain, w.start), len(plain) - 1)] if len(plain) else w.start
    end = plain[np.searchsorted(plain, w.end) - 1] + 1 if len(plain) else w.start
    full = np.flatnonzero((start < w.end) & (end > start))
    start, end, doc = start[full], end[full], w.doc[full]
    docs, keys = [doc], [span_hash(w.sums, start, end)]
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        docs.append(doc[long])
        keys.append(mixed(span_hash(w.sums, start[long], start[long] + k) ^ np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positive and unlabelled texts hold each bucket, one sum for each piece of text."""
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for a, b, data, offsets in pieces(batch.column("body"), lower=True):
            doc, bucket = _parts(data, offsets)
            key = np.unique(doc * BUCKETS + bucket)
            positive = kinds[a:b][key // BUCKETS] == 1
            found, at = np.unique(key % BUCKETS, return_inverse=True)
            p = np.bincount(at[positive], minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(p), pa.array(np.bincount(at, minlength=len(found)) - p)], names=["bucket", "p", "u"])


def _known(chosen: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, index in chosen) of the chosen buckets in each document, each once, by document."""
    doc, bucket = _parts(data, offsets)
    known = np.zeros(BUCKETS, bool)
    known[chosen] = True
    hit = known[bucket]
    key = np.unique(doc[hit] * BUCKETS + bucket[hit])
    return key // BUCKETS, np.searchsorted(chosen, key % BUCKETS)


class _Bags:
    """Documents as lists of features in one flat array."""

    def __init__(self, lists: list) -> None:
        self.flat = np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)])
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row in the batch, feature) of every entry of the documents `which`."""
        n = self.ends[which + 1] - self.ends[which]
        row = np.repeat(np.arange(len(which)), n)
        return row, self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[which], n)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def choose(counts: DataFrame, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """The buckets, ascending, whose shares of positive and of unlabelled texts differ most; counts: bucket, p, u.

    By the two-proportion z statistic; buckets in fewer than LEAST_TEXTS texts are left out.
    """
    a, b = ((F.col(c) + 0.5) / (n + 1) for c, n in (("p", n_positive), ("u", n_unlabelled)))
    z = (a - b) / F.sqrt(a * (1 - a) / (n_positive + 1) + b * (1 - b) / (n_unlabelled + 1))
    rows = counts.where(F.col("p") + F.col("u") >= LEAST_TEXTS).withColumn("z", z).orderBy(F.abs("z").desc(), "bucket").limit(FEATURES).select("bucket", "z").collect()
    return np.sort(np.array([r.bucket for k, r in enumerate(rows) if abs(r.z) >= LEAST_Z or (k < LEAST_FEATURES and r.z > 0)], np.int64))


def fit_nnpu(pos: _Bags, unl: _Bags, features: int, prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias) of the linear classifier with the least non-negative PU risk, logistic loss."""
    w, bias = np.zeros(features), 0.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    rng, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS if len(pos) and len(unl) else 0):
        order = rng.permutation(len(unl))
        for at in range(0, len(order), BATCH):
            iu = order[at : at + BATCH]
            ip = rng.integers(0, len(pos), max(1, BATCH // 4))
            (rp, fp), (ru, fu) = pos.rows(ip), unl.rows(iu)
            zp = np.bincount(rp, w[fp], len(ip)) + bias
            zu = np.bincount(ru, w[fu], len(iu)) + bias
            sp, su = _sigmoid(zp), _sigmoid(zu)
            # Losses: log(1 + exp(-z)) as positive, log(1 + exp(z)) as clean.
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            du, dp_clean, dp = su / len(iu), -prior * sp / len(ip), prior * (sp - 1) / len(ip)
            gp, gu = (dp + dp_clean, du) if clean >= 0 else (-dp_clean, -du)
            g = np.bincount(fp, gp[rp], len(w)) + np.bincount(fu, gu[ru], len(w)) + DECAY * w
            g = np.append(g, gp.sum() + gu.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            bias -= move[-1]
    if features and len(pos):
        bias += _threshold(np.bincount(np.repeat(np.arange(len(unl)), np.diff(unl.ends)), w[unl.flat], len(unl)) + bias, prior)
    return w, bias


def _threshold(z: np.ndarray, prior: float) -> float:
    """What to add to unlabelled scores z so that about the prior's share is above 0: the widest gap near that quantile is put at 0."""
    z = np.sort(z)
    a, b = (int(np.clip(len(z) * (1 - x * prior), 0, len(z) - 1)) for x in NEAR_PRIOR)
    if b <= a:
        return 0.0
    gaps = np.diff(z[a : b + 1])
    k = a + int(np.argmax(gaps))
    if gaps[k - a] <= 0:
        return 0.0
    return -float(z[k] + z[k + 1]) / 2


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(chosen buckets, ascending, their weights, bias), fitted on rows of the training folds. The class prior is the toxic share of all labelled training rows.

    Labels that contradict each other for one id count as toxic. Without a toxic training row,
    or without documents, the model is all zeros with a bias that scores everything as clean.
    """
    spark = docs.sparkSession
    key = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").where(key % FOLDS != 0).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    spread = F.xxhash64("id", F.lit("sample"))
    positive = known.where("y = 1").orderBy(spread, "id").limit(MOST_POSITIVE).select("id", F.lit(1).alias("kind"))
    unlabelled = docs.select(F.col(id_col).alias("id")).where("id is not null").where(key % FOLDS != 0).orderBy(spread, "id").limit(MOST_UNLABELLED).select("id", F.lit(0).alias("kind")).distinct()
    # Bounded by the two parameters.
    ids = spark.createDataFrame([tuple(r) for r in positive.unionByName(unlabelled).collect()], "id long, kind int")
    texts = saved(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(ids), "id"), "tox-sample")
    sizes = {r.kind: r["count"] for r in texts.groupBy("kind").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), -5.0
    small_batches(texts)
    chosen = choose(texts.mapInArrow(_presence, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), n_p, n_u)

    def features(data: np.ndarray, offsets: np.ndarray) -> dict:
        doc, at = _known(chosen, data, offsets)
        return {"features": pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32), pa.array(at.astype(np.int32)))}

    # At most FEATURES numbers for each text of the bounded sample.
    bags = map_texts(texts, "body", features, "features array<int>", lower=True).select("kind", "id", "features").toPandas().sort_values(["kind", "id"], kind="stable")
    w, bias = fit_nnpu(*(_Bags(list(bags[bags.kind == k].features)) for k in (1, 0)), len(chosen), min(max(share, 1e-4), 0.9))
    return chosen, w, bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text") -> DataFrame:
    """docs with `tox_score`, 0 to 1: every word of every text; null and empty texts score the bias alone."""
    chosen, weights, bias = model

    def make(data: np.ndarray, offsets: np.ndarray) -> dict:
        doc, at = _known(chosen, data, offsets)
        z = np.bincount(doc, weights[at], len(offsets) - 1) if len(at) else np.zeros(len(offsets) - 1)
        return {"tox_score": _sigmoid(z + bias)}

    return map_texts(docs, text_col, make, "tox_score double", lower=True)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Null ids are scored too and count as the empty text in the fold rule. Null and empty texts score by the bias alone; equal rows score alike, and columns beyond id and text are not read."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    return score(rows, model, text_col="body").select(
        F.col("id").alias(id_col),
        (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % FOLDS == 0).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, that score under 0.5."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    # A column of docs may be called tox_score: inside, columns go by position.
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return score(inner, model, text_col=f"c{docs.columns.index(text_col)}").where("tox_score < 0.5").drop("tox_score").toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents; see toxicity for nulls, empty texts and repeated rows."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
