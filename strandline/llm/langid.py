"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained by FTRL with elastic-net penalties; a temperature fitted on rows apart calibrates its probabilities.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import held_out, map_texts
from strandline.llm.ftrl import Ftrl, softmax

#: Hashed n-grams, and the orders of n-grams.
FEATURES, ORDERS = 1 << 15, (1, 2, 3)

#: Documents that the model is fitted on at most, in equal parts by language.
TRAIN_ROWS = 4_000

EPOCHS = 2

#: Values of lang that a model may have: they bound the table of labels and the weights, which are broadcast.
LANGUAGES = 500

#: Code points counted at a time.
CHUNK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, lower-cased, with all runs of other characters as one space; None without letters."""
    if not text:
        return None
    text = text.lower()
    total = np.zeros(FEATURES, np.int64)
    seen = False
    before = np.array([32], np.uint64)  # the last characters counted, which the next n-grams may begin with
    grown = 1  # how many of these are still to count as the end of an n-gram
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        seen = seen or bool(letter.any())
        # a run of other characters is one space, also across chunks and after the space before the text
        keep = letter | np.append(at == 0 or before[-1] != 32, letter[:-1])
        c = np.where(letter, c, 32)[keep].astype(np.uint64)
        last = at + CHUNK >= len(text)
        c = np.concatenate([before, c, np.full(int(last), 32, np.uint64)])
        old = len(before) - grown
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            h = ((h[: len(c) - n + 1] if n > 1 else h) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            new = h[max(0, old - n + 1) :]  # those that end after what was counted
            if n in ORDERS and len(new):
                total += np.bincount((new >> np.uint64(20)).astype(np.int64) % FEATURES, minlength=FEATURES)
        before, grown = c[-max(1, max(ORDERS) - 1) :], 0
    return total if seen else None


def _sparse(text) -> tuple[np.ndarray, np.ndarray] | None:
    c = counts(text)
    if c is None:
        return None
    ids = np.flatnonzero(c)
    return ids, 1 + np.log(c[ids])


def _scaled(ids, tf, idf):
    x = tf * idf[ids]
    return x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents with a letter, how many of them have each feature) over every row of docs.

    Each task sends one vector; vectors meet in a tree, so the driver gets one however large the input is.
    """

    def summed(batches):
        total = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                c = counts(t.as_py())
                if c is not None:
                    total[:-1] += c > 0
                    total[-1] += 1
        yield pa.RecordBatch.from_pydict({"df": pa.array([total.tobytes()], pa.binary())})

    def added(batches):
        total = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"df": pa.array([total.tobytes()], pa.binary())})

    slim = docs.select("text")
    level, parts = slim.mapInArrow(summed, "df binary"), slim.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 16)
        level = level.repartition(parts).mapInArrow(added, "df binary")
    total = sum((np.frombuffer(r["df"], np.int64) for r in level.collect()), np.zeros(FEATURES + 1, np.int64))
    return int(total[-1]), total[:-1]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict:
    """{labels, weights, idf, temperature} fitted on at most about ``rows`` documents with a language that are not held out.

    Each language gives an equal share, those with the least hashes of doc_id: counts of languages set the
    bound on the hash, so the sample is chosen by a filter in the scan. Features are made where the texts
    lie; one task, of bounded input, does the sequential updates. Document frequencies
    are those of all documents that may teach. Every eighth row of the sample fits the temperature and no weight.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(n) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang: the model would not fit")
    if not n:
        return {"labels": []}
    names = sorted(n)
    share = max(8, rows // len(names))
    n_docs, df = document_frequencies(known)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    hashed = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(x) for k in names for x in (k, int(min(1.0, share / n[k]) * (1 << 30)))])
    sample = known.filter(hashed <= F.try_element_at(bound, F.col("lang"))).select(F.xxhash64("doc_id").alias("order"), "lang", "text")

    def make():
        def work(texts):
            found = [_sparse(t) for t in texts]
            return [[None if f is None else f[0].astype(np.int32).tobytes() for f in found], [None if f is None else f[1].astype(np.float32).tobytes() for f in found]]

        return work

    made = map_texts(sample, "ids binary, tf binary", make, carry=("order", "lang")).filter("ids is not null")

    def fit(batches):
        got = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame({"order": [], "lang": [], "ids": [], "tf": []})])
        got = got.sort_values(["order", "lang", "ids"]).drop_duplicates(["lang", "ids", "tf"])
        data = [(np.frombuffer(i, np.int32), np.frombuffer(t, np.float32).astype(float), names.index(y)) for i, t, y in zip(got["ids"], got["tf"], got["lang"], strict=True)]
        model = Ftrl(FEATURES, len(names), alpha=0.5, l1=0.01, l2=0.1)
        eye = np.eye(len(names))
        data = [(ids, _scaled(ids, tf, idf), y) for ids, tf, y in data]
        for _ in range(epochs):
            for k, (ids, x, y) in enumerate(data):
                if k % 8 != 7:
                    model.step(ids, x, eye[y], softmax)
        w = model.weights(slice(None))
        apart = [(x @ w[ids] + w[-1], y) for ids, x, y in data[7::8]]

        def loss(t):
            return -sum(np.log(max(softmax(m / t)[y], 1e-12)) for m, y in apart)

        best = min(np.geomspace(0.5, 5, 40), key=loss) if apart else 1.0
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "t": pa.array([float(best)])})

    # one row for each doc_id and language, from each task too: a doc_id that a third of all rows share sends no more
    one = made.groupBy("order", "lang").agg(F.min(F.struct("ids", "tf")).alias("f")).select("order", "lang", "f.*")
    got = one.repartition(1).mapInArrow(fit, "w binary, t double").first()
    return {"labels": names, "weights": np.frombuffer(got["w"], np.float32).reshape(FEATURES + 1, len(names)), "idf": idf, "temperature": got["t"]}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def one(text):
            found = _sparse(text) if m["labels"] else None
            if found is None:
                return "und", 0.0
            ids, tf = found
            p = softmax((_scaled(ids, tf, m["idf"]) @ m["weights"][ids].astype(float) + m["weights"][-1]) / m["temperature"])
            k = int(np.argmax(p))
            return m["labels"][k], float(p[k])

        return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[], []]

    return map_texts(docs.select("doc_id", "text"), "lang_pred string, score double", make)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents.

    A null text, or one without a letter, is ``und`` with score 0, as is all if nothing can be learned from.
    A null lang teaches nothing; a null doc_id is held out; of several texts under one doc_id and language, one
    teaches, and the order of rows changes nothing. Very long texts count whole. Equal texts have equal predictions, repeated
    rows each get one, other columns are never read, and no rows give no rows. Ties go to the lesser name.
    """
    out = predict(docs, train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
