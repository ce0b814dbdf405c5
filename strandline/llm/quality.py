"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL, scored as sparse dot products."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BoundedCache, cut, held_out, map_texts
from strandline.llm.ftrl import Ftrl, sigmoid

#: Hashed features.
FEATURES = 1 << 19

#: Labelled rows that the model is fitted on at most, half of each label.
TRAIN_ROWS = 6_000

EPOCHS = 3

_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]{2,}"), "A"), (re.compile(r"\d+"), "0"))


def shape(word: str) -> str:
    """The word with runs of letters and digits reduced to their kind."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


def _word_ids(word: str) -> int:
    return zlib.crc32(word.encode()) | zlib.crc32(b"\0" + shape(word).encode()) << 32


@lru_cache(1)
def _cache() -> BoundedCache:
    return BoundedCache(_word_ids, 400_000)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h % np.uint64(FEATURES)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of a whole text: hashed 1- and 2-grams of words, 1- to 3-grams of word shapes, and
    the share of 6-grams that the text has already had and of words like the word before; values are square roots of counts, scaled to length 1."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.fromiter(map(_cache().__getitem__, words), np.uint64, len(words))
    w, s = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    tag = [np.full(1, t, np.uint64) for t in range(8)]
    found = [_mixed(np.repeat(tag[0], len(w)), w), _mixed(np.repeat(tag[1], len(s)), s)]
    found += [_mixed(np.repeat(tag[2], len(w) - 1), w[:-1], w[1:]), _mixed(np.repeat(tag[3], len(s) - 1), s[:-1], s[1:])]
    if len(s) > 2:
        found.append(_mixed(np.repeat(tag[4], len(s) - 2), s[:-2], s[1:-1], s[2:]))
    ids, counts = np.unique(np.concatenate(found).astype(np.int64), return_counts=True)
    x = np.sqrt(counts)
    x /= np.sqrt((x * x).sum())
    if len(w) > 6:
        six = np.zeros(len(w) - 5, np.uint64)
        for k in range(6):
            six = (six + w[k : len(w) - 5 + k]) * np.uint64(0x9E3779B97F4A7C15)
        again = 1 - len(np.unique(six)) / len(six)
        ids, x = np.append(ids, [FEATURES, FEATURES + 1]), np.append(x, [again, again > 0.1])
    if len(w) > 1:
        ids, x = np.append(ids, FEATURES + 2), np.append(x, (w[1:] == w[:-1]).mean())
    return ids, x


def _featured(rows: DataFrame) -> DataFrame:
    def make():
        def work(texts):
            found = [features(t) for t in texts]
            return [[i.astype(np.int32).tobytes() for i, _ in found], [x.astype(np.float32).tobytes() for _, x in found]]

        return work

    return map_texts(rows, "ids binary, x binary", make, carry=("order", "quality"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last the intercept) fitted on at most ``rows`` labelled documents that are not held out.

    Of each label the rows with the least hashes of their doc_id are taken; the intercept is moved to the
    shares of the labels among all labelled rows. Features are made where the texts lie; one task, of
    bounded input, does the sequential updates. A document with both labels counts as both; of several texts
    under one doc_id the one with the least features teaches, whatever the order of the rows. Without labels
    the weights are 0.
    """
    known = labels.select("doc_id", "quality").filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return np.zeros(FEATURES + 4, np.float32)
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(rows // 2) for q in (0, 1)]
    # the bound on its rows makes the sample small enough to broadcast
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select(order.alias("order"), "quality", "text")

    def fit(batches):
        got = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame({"order": [], "quality": []})])
        got = got.sort_values(["order", "quality"])
        model = Ftrl(FEATURES + 3, 1, alpha=0.6, l1=0.02, l2=0.2)
        data = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32).astype(float), np.array([float(q)])) for i, x, q in zip(got.get("ids", []), got.get("x", []), got["quality"], strict=True)]
        for _ in range(epochs):
            for ids, x, y in data:
                model.step(ids, x, y, sigmoid)
        w = model.weights(slice(None))[:, 0].astype(np.float32)
        n = [max(1, sum(y[0] == q for _, _, y in data)) for q in (0, 1)]
        w[-1] += np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)) - np.log(n[1] / n[0])
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary())})

    # one row for each doc_id and label, from each task too: a doc_id that a third of all rows share sends no more
    one = _featured(texts).groupBy("order", "quality").agg(F.min(F.struct("ids", "x")).alias("f")).select("order", "quality", "f.*")
    got = one.repartition(1).mapInArrow(fit, "w binary").first()
    return np.frombuffer(got["w"], np.float32)


def scored(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """The carried columns and the score of every row: the logistic of a sparse dot product of its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = sent.value.astype(float)

        def one(text):
            ids, x = features(text)
            return float(sigmoid(w[ids] @ x + w[-1]))

        return lambda texts: [[one(t) for t in texts]]

    return map_texts(docs, f"{score} double", make, carry=carry)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    Null and empty texts have no features and score by the intercept alone. A null doc_id is held out.
    Equal texts have equal scores, repeated rows each get one, other columns are never read, very long texts
    count whole, and no rows give no rows; without labels every score is 0.5. The order of rows changes nothing.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least ``threshold``."""
    w = train(docs, labels)
    name = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(name).withColumn("text", F.col(name["text"]))
    kept = scored(plain, w, tuple(name.values()), "__score").filter(F.col("__score") >= threshold)
    return kept.select(*[F.col(v).alias(k) for k, v in name.items()])
