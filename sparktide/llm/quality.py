"""Quality classifier with hierarchical empirical Bayes: a document's own evidence meets what its host and path are known for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored
from .words import BLOCK_BYTES, Words

#: Labelled rows that the document classifier is fitted on at most; those of least hash of their id.
SAMPLE_ROWS = 8000
#: Buckets of hashed words, and words that the classifier picks at most.
BUCKETS = 1 << 18
PICKED_WORDS = 300
#: How far apart a word's shares of good and bad documents are, in standard errors of one common share, and documents of one kind that have it, for it to be picked.
PICK_Z, PICK_DOCUMENTS = 5.0, 6

_UPPER, _LOWER, _DIGIT, _PIPE, _MARK, _SYMBOL, _LINE, _BLANK, _HIGH, _REST = range(10)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _chars, _kind in ((b"|", _PIPE), (b"!?.,", _MARK), (b"#$%&*@<>{}[]=_~^\\", _SYMBOL), (b"\n", _LINE), (b" \t", _BLANK)):
    _CLASS[list(_chars)] = _kind
FEATURES = 16


def _shapes(texts: list[str | None]) -> tuple[np.ndarray, Words]:
    """Shape features of each text of a block."""
    w = Words(texts)
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(texts)
    out = np.zeros((n, FEATURES))
    for i, r in enumerate(raw):
        kinds = np.bincount(_CLASS[np.frombuffer(r, np.uint8)], minlength=10) if r else np.zeros(10)
        h = w.hash[w.first[i] : w.first[i + 1]]
        words, size = max(len(h), 1), max(len(r), 1)
        letters = max(kinds[_UPPER] + kinds[_LOWER], 1)
        distinct, counts = np.unique(h, return_counts=True) if len(h) else (h, np.zeros(1, np.int64))
        pairs = (h[1:] == h[:-1]).mean() if len(h) > 1 else 0.0
        thirds = np.unique(h[2:] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[:-2] * np.uint64(7)) if len(h) > 2 else h
        out[i] = (
            kinds[_UPPER] / letters, kinds[_PIPE] / words, kinds[_SYMBOL] / words, kinds[_MARK] / words, kinds[_DIGIT] / size,
            kinds[_LINE] / words, kinds[_HIGH] / size, min(size / words, 30) / 10, np.log1p(len(h)) / 5, pairs,
            counts.max() / words, 1 - len(thirds) / max(len(h) - 2, 1) if len(h) > 2 else 0.0, np.sqrt(pairs), float(kinds[_PIPE] > 0.1 * words), float(kinds[_SYMBOL] > 0.3 * words), float(kinds[_UPPER] > 0.4 * letters),
        )
    return out, w


def _word_buckets(w: Words, i: int) -> np.ndarray:
    return np.unique(w.hash[w.first[i] : w.first[i + 1]] & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass(frozen=True)
class DocumentModel:
    """A logistic regression over shape features and picked words; small enough to go to every task."""

    mean: np.ndarray
    scale: np.ndarray
    buckets: np.ndarray  # sorted
    weight: np.ndarray  # of shapes, of the log number of distinct picked words each way, and the constant
    bad_word: np.ndarray
    base: float  # log odds of the labels fitted on

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihood ratio of good to bad for each text."""
        x = self.inputs(texts)
        return np.clip(x @ self.weight, -30, 30) - self.base

    def inputs(self, texts: list[str | None]) -> np.ndarray:
        shapes, w = _shapes(texts)
        hits = np.zeros((len(texts), 4))
        if len(self.buckets):
            b = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.buckets, b), len(self.buckets) - 1)
            hit = self.buckets[at] == b
            for k, want in enumerate((True, False)):
                total = np.concatenate(([0], np.cumsum(hit & (self.bad_word[at] == want))))
                count = total[w.first[1:]] - total[w.first[:-1]]
                hits[:, 2 * k] = np.log1p(count)
                hits[:, 2 * k + 1] = count > 0
        return np.hstack(((shapes - self.mean) / self.scale, hits, np.ones((len(texts), 1))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(labels: DataFrame) -> DataFrame:
    """One row for each labelled id: good is 1 for quality without toxicity. Ids with a null label or contradicting rows don't count."""
    good = F.when(F.col("quality").isNull(), None).otherwise(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int"))
    held = labels.select(F.col("doc_id").alias("__lid"), good.alias("__good")).where(F.col("__good").isNotNull() & F.col("__lid").isNotNull())
    return held.groupBy("__lid").agg(F.min("__good").alias("__good"), F.max("__good").alias("__most")).where(F.col("__good") == F.col("__most")).drop("__most")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DocumentModel:
    """Fit the document classifier on at most ``sample_rows`` labelled documents; only their features reach the driver."""
    spark = docs.sparkSession
    picked = labelled(labels).orderBy(F.xxhash64("__lid"), "__lid").limit(sample_rows)
    sample = docs.select(column(docs, id_col).alias("__id"), column(docs, text_col).alias("__text")).join(F.broadcast(picked), F.col("__id") == F.col("__lid"))  # at most sample_rows ids
    sample = stored(sample.dropDuplicates(["__id"]).select("__id", "__text", "__good"), "quality-sample")

    def buckets(batches):
        for pdf in batches:
            w = Words(pdf["__text"].tolist())
            each = [_word_buckets(w, i) for i in range(len(pdf))]
            yield pd.DataFrame({"bucket": np.concatenate(each) if each else np.zeros(0, np.int32), "good": np.repeat(pdf["__good"].to_numpy(), [len(e) for e in each])})

    n = sample.agg(F.sum("__good").alias("good"), F.count("*").alias("n")).first()
    n_good, n_bad = float(n["good"] or 0), float((n["n"] or 0) - (n["good"] or 0))
    if not n_good or not n_bad:  # nothing to learn from: every document is as good as any
        return DocumentModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(0, np.int64), np.zeros(FEATURES + 5), np.zeros(0, bool), 0.0)
    share = (F.col("a") + F.col("b")) / (n_good + n_bad)
    apart = (F.col("a") / n_good - F.col("b") / n_bad) / F.sqrt(share * (1 - share) * (1 / n_good + 1 / n_bad))
    seen = sample.mapInPandas(buckets, "bucket int, good int").groupBy("bucket").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b"))
    seen = seen.where(F.least(F.lit(1e9), F.greatest("a", "b")) >= PICK_DOCUMENTS).where(share < 1).withColumn("z", apart).where(F.abs("z") >= PICK_Z)
    words = seen.orderBy(F.abs("z").desc(), "bucket").limit(PICKED_WORDS).toPandas().sort_values("bucket")
    blank = DocumentModel(np.zeros(FEATURES), np.ones(FEATURES), words["bucket"].to_numpy(np.int64), np.zeros(0), (words["z"] < 0).to_numpy(bool), 0.0)

    def features(batches):
        for pdf in batches:
            x = blank.inputs(pdf["__text"].tolist())
            yield pd.DataFrame({"x": list(x), "good": pdf["__good"]})

    got = sample.mapInPandas(features, "x array<double>, good int").toPandas()
    x, y = np.array(got["x"].tolist()), got["good"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows come in
    x, y = x[order], y[order]
    mean, scale = x[:, :FEATURES].mean(0), x[:, :FEATURES].std(0) + 1e-6
    x[:, :FEATURES] = (x[:, :FEATURES] - mean) / scale
    return DocumentModel(mean, scale, blank.buckets, _logistic(x, y), blank.bad_word, float(np.log(n_good / n_bad)))


def _evidence(model: DocumentModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, block, size = [], [], 0
            for t in texts.tolist():
                block.append(t)
                size += len(t or "")
                if size >= BLOCK_BYTES:
                    out.append(model.evidence(block))
                    block, size = [], 0
            if block:
                out.append(model.evidence(block))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        pa.default_memory_pool().release_unused()

    return run(text)


def _strength(rows: DataFrame, n: str, mean: Column, prior: Column) -> float:
    """The weight of the level above, in documents: by moments of how far groups lie from it."""
    spread = F.col(n) * (mean - prior) * (mean - prior)
    r = rows.agg(F.sum(spread).alias("s"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"), F.count("*").alias("k"), F.avg(prior * (1 - prior)).alias("v")).first()
    if not r["n"] or r["k"] < 2 or not r["v"]:
        return 100.0
    left = r["n"] - r["n2"] / r["n"]
    between = max((r["s"] - (r["k"] - 1) * r["v"]) / left if left > 0 else 0.0, 1e-9)
    return float(min(max(r["v"] / between - 1, 1.0), 1e5))


def posteriors(scored: DataFrame, base_odds: float) -> DataFrame:
    """``scored (host, path, evidence, label)`` with ``host_posterior`` and ``path_posterior`` of each row: what the other documents of its host and path say of its being good.

    Goodness of a document is its label where there is one, else the classifier's probability. Sums cover all documents; each
    row's own share is taken out of those of its path and host, so that no evidence counts twice. Hosts shrink toward the
    global mean and paths toward their host, each by a strength that the spread between groups gives.
    """
    good = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + F.lit(base_odds)))))
    each = scored.withColumn("good", good)
    groups = stored(each.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")), "quality-groups")
    top = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = min(max((top["s"] or 0.5) / (top["n"] or 1), 1e-4), 1 - 1e-4)
    hosts = groups.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    k = _strength(hosts, "hn", F.col("hs") / F.col("hn"), F.lit(base))
    hosts = hosts.select(F.col("host").alias("h"), "hn", "hs", ((F.col("hs") + k * base) / (F.col("hn") + k)).alias("whole"))
    both = groups.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    kp = _strength(both, "n", F.col("s") / F.col("n"), F.col("whole"))
    both = stored(both.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "n", "s", "hn", "hs"), "quality-sums")
    out = each.join(both, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    out = out.withColumn("host_posterior", (F.col("hs") - F.col("good") + k * base) / (F.col("hn") - 1 + k))
    out = out.withColumn("path_posterior", (F.col("s") - F.col("good") + kp * F.col("host_posterior")) / (F.col("n") - 1 + kp))
    return out.drop("__host", "__path", "n", "s", "hn", "hs", "good")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep_from: float = 0.5, sample_rows: int = SAMPLE_ROWS, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``evidence``, ``host_posterior``, ``path_posterior``, ``p_good`` and ``keep``; without its text, which then isn't written along, if ``with_text`` is false.

    The posterior log odds of a document are those that the rest of its path gives plus its own log likelihood ratio; it is
    kept from ``keep_from`` on (a tie at it is kept). Each text is scored once; what came of it is stored without the text and
    joined back by id, host, path and the text's hashes.

    Null and empty texts are judged by the features of an empty text, very long ones by those of the whole text. Null hosts or
    paths form a group of their own, a site with one document has the global prior. Repeated rows are judged alike, an empty
    table gives an empty one; without labels of both kinds every document has the prior of its path. Columns of ``docs`` of the
    same names are replaced. The classifier's sample is bounded by ``sample_rows``; the sums behind the posteriors cover all
    documents, added up in each task before the shuffle, and come back by a join that Spark broadcasts where its size allows.
    """
    made = ["evidence", "host_posterior", "path_posterior", "p_good", "keep"]
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    kept = [column(docs, c) for c in docs.columns if c not in made and (with_text or c != text_col)]
    text = column(docs, text_col)
    key = {"__id": column(docs, id_col), "host": column(docs, host_col), "path": column(docs, path_col), "__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)}
    rows = stored(docs.select(*(c.alias(n) for n, c in key.items()), _evidence(model, text).alias("evidence")), "quality-evidence")
    scored = rows.join(labelled(labels), F.col("__id") == F.col("__lid"), "left").withColumnRenamed("__good", "label").drop("__lid")
    out = posteriors(scored, model.base)
    prior = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-4)), F.lit(1 - 1e-4))
    out = out.withColumn("p_good", 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + F.col("evidence")))))
    out = out.withColumn("keep", F.col("p_good") >= keep_from).dropDuplicates(list(key))  # repeated rows are judged alike
    judged = out.select(*(F.col(n).alias(f"__of_{n}") for n in key), *(F.col(c).alias(f"__made_{c}") for c in made))
    keyed = docs.select(F.struct(*kept).alias("__row"), *(c.alias(n) for n, c in key.items()))
    same = [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in key]
    found = keyed.join(judged, same[0] & same[1] & same[2] & same[3] & same[4])
    names = [c for c in docs.columns if c not in made and (with_text or c != text_col)]
    return found.select(*(F.col("__row").getField(c).alias(c) for c in names), *(F.col(f"__made_{c}").alias(c) for c in made))
