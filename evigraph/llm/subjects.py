"""Subject areas of documents (p9): complement naive Bayes, refined by expectation-maximization, with calibrated posteriors.

A document is a list of segments (sentences, list items), a segment a bag of hashed words; documents on two subjects mix
segments, so expectation-maximization gives each segment its subject. The first model comes from labelled documents alone.
Each further round reads all documents: segments of labelled documents lean to their labels, those of others follow the
model. A round sums word counts per subject in each task and then by word, so what reaches the driver is at most FEATURES
rows. A logistic calibration on held-out labelled documents (CALIBRATE at most, lowest hash first) turns a document's
clear segments on a subject into a posterior of that subject, independent of the others'.

Null and blank texts have no subject. Labels of subjects not in use and of unknown documents count for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.sampling import bounded_sample
from evigraph.runtime import cut

FEATURES, ROUNDS = 1 << 18, 2
#: Pseudo-count of a word; words seen less than RARE times tell nothing; lean of labelled documents to their labels.
ALPHA, RARE, LEAN = 0.2, 4.0, 50.0
#: Prior weight of each subject in a document's mixture; segments count in a round from this posterior on.
MIXTURE, SURE = 0.2, 0.7
#: A segment is clear where its best subject has this posterior; a document gets a subject from this posterior on.
CLEAR, POSTERIOR = 0.9, 0.5
CALIBRATE, HELD_OUT = 20_000, 5

SEGMENT = re.compile(r"""(?<=[.!?])["”'’)]*\s+|(?<=[。！？])|\n\s*\n|\n(?=[-*•#>?|]|\d+[.)] )|", "|\}, \{""")
WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]{2,}")
SHAPE = "doc_id long, mask int, held boolean, words array<int>, ends array<int>"


def _words(text: str, known: dict[str, list[int]]) -> list[int]:
    out: list[int] = []
    for w in WORD.findall(text.lower()):
        ids = known.get(w)
        if ids is None:
            parts = [w[i : i + 2] for i in range(len(w) - 1)] or [w] if "㐀" <= w[0] <= "鿿" else [w]
            ids = [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts]
            if len(known) > 500_000:
                known.clear()
            known[w] = ids
        out += ids
    return out


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, list[int]] = {}
    for f in frames:
        words, ends = [], []
        for text in f["text"]:
            ids: list[int] = []
            stops: list[int] = []
            for s in SEGMENT.split(text):
                ids += _words(s, known)
                if len(ids) > (stops[-1] if stops else 0):
                    stops.append(len(ids))
            words.append(np.array(ids, np.int32))
            ends.append(np.array(stops, np.int32))
        yield pd.DataFrame({"doc_id": f["doc_id"], "mask": f["mask"], "held": f["held"], "words": words, "ends": ends})


def featured(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, mask (bit i: labelled with subject i), held (kept from training), words and ends of segments."""
    bit = F.sum(F.when(F.col("subject").isin(subjects), F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, 1 << i)]), F.col("subject"))).otherwise(0))
    masks = labels.where("doc_id IS NOT NULL").select("doc_id", "subject").distinct().groupBy("doc_id").agg(bit.cast("int").alias("mask"))
    base = docs.where(r"text RLIKE '\\S'").select("doc_id", "text").join(masks, "doc_id", "left")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    base = base.select("doc_id", "text", F.coalesce("mask", F.lit(0)).alias("mask"), held.alias("held"))
    return base.mapInPandas(_read, SHAPE)


class Model:
    """Weights of words for subjects: minus the log share of a word in the complement of each subject."""

    def __init__(self, counts: np.ndarray) -> None:
        total = counts.sum(axis=1, keepdims=True)
        rest = total - counts
        share = (rest + ALPHA) / (rest.sum(axis=0, keepdims=True) + ALPHA * len(counts))
        w = -np.log(share)
        w -= w.mean(axis=1, keepdims=True)
        w[total[:, 0] < RARE] = 0
        self.weights = w.astype(np.float32)

    def segments(self, words: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Posteriors of segments (segments, subjects), given the mixture of subjects of each segment's document."""
        starts = np.concatenate([[0], ends[:-1]])
        scores = np.add.reduceat(self.weights[words], starts, axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        alone = np.exp(scores)
        p = alone / alone.sum(axis=1, keepdims=True)
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))
        at = np.cumsum(np.diff(doc, prepend=doc[0]) > 0)
        for _ in range(3):
            mixture = np.add.reduceat(p, firsts, axis=0) + MIXTURE
            mixture /= mixture.sum(axis=1, keepdims=True)
            p = alone * mixture[at]
            p /= p.sum(axis=1, keepdims=True)
        return p


def _flat(f: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words of all documents in a row, ends of all segments, document number of each segment."""
    words, ends = f.column("words"), f.column("ends")
    w = words.flatten().to_numpy()
    counts = np.diff(ends.offsets.to_numpy())
    lengths = np.diff(words.offsets.to_numpy())
    e = ends.flatten().to_numpy().astype(np.int64) + np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), counts)
    return w, e, np.repeat(np.arange(len(counts)), counts)


def _count(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value if shared is not None else None
        total = np.zeros((n, FEATURES), np.float64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                f = whole.slice(start, 1000)
                w, e, doc = _flat(f)
                if not len(w):
                    continue
                mask = np.where(f.column("held").to_numpy(zero_copy_only=False), 0, f.column("mask").to_numpy())
                given = ((mask[:, None] >> np.arange(n)) & 1).astype(np.float64)[doc]
                if model is None:
                    p = given / np.maximum(given.sum(axis=1, keepdims=True), 1)
                else:
                    p = model.segments(w, e, doc) * np.where(given.any(axis=1, keepdims=True), 1 + LEAN * given, 1)
                    p = p / p.sum(axis=1, keepdims=True)
                    p[p.max(axis=1) < SURE] = 0
                per_word = np.repeat(p, np.diff(np.concatenate([[0], e])), axis=0)
                for c in range(n):
                    total[c] += np.bincount(w, weights=per_word[:, c], minlength=FEATURES)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[c, at]) for c in range(n)]], names=["word", *[f"c{c}" for c in range(n)]])

    return run


def _round(features: DataFrame, shared, n: int) -> Model:
    kinds = "word int, " + ", ".join(f"c{c} double" for c in range(n))
    # a first model reads labelled documents alone
    rows = features if shared is not None else features.where("mask > 0 AND NOT held")
    sums = rows.mapInArrow(_count(shared, n), kinds).groupBy("word").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(n)]).toArrow()
    counts = np.zeros((FEATURES, n))
    if sums.num_rows:
        counts[sums.column("word").to_numpy()] = np.stack([sums.column(f"c{c}").to_numpy() for c in range(n)], axis=1)
    return Model(counts)


def _signals(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                f = whole.slice(start, 1000)
                w, e, doc = _flat(f)
                if not len(w):
                    continue
                p = model.segments(w, e, doc)
                clear = np.where(p >= CLEAR, 1.0, 0.0)
                sums = np.stack([np.bincount(doc, weights=clear[:, c], minlength=f.num_rows) for c in range(n)], axis=1)
                d, c = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([
                    f.column("doc_id").take(pa.array(d)), pa.array(((f.column("mask").to_numpy()[d] >> c) & 1).astype(np.int32)),
                    pa.array(f.column("mask").to_numpy()[d] > 0), f.column("held").take(pa.array(d)), pa.array(c, pa.int32()),
                    pa.array(sums[d, c]), pa.array(sums.sum(axis=1)[d]),
                ], names=["doc_id", "given", "labelled", "held", "c", "hits", "clear"])

    return run


def calibrate(share: np.ndarray, hits: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on the share and the (log) number of clear segments; weights of (1, share, log hits)."""
    if not len(given) or given.min() == given.max():
        return np.array([-4.0, 10.0, 1.0])
    x = np.stack([np.ones_like(share), share, np.log(hits)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        r = p * (1 - p) + 1e-6
        step = np.linalg.solve((x * r[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (given - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def subject_posteriors(docs: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, subject, posterior, labelled: for each document and each subject that it has a clear segment on."""
    spark = docs.sparkSession
    subjects = sorted({r["subject"] for r in areas.select("subject").where("subject IS NOT NULL").collect()})  # the fixed table of subjects in use
    n = len(subjects)
    features = cut(featured(docs, labels, subjects), "features")
    model = _round(features, None, n)
    for _ in range(rounds):
        model = _round(features, _share(spark, model), n)
    kinds = "doc_id long, given int, labelled boolean, held boolean, c int, hits double, clear double"
    signals = cut(features.mapInArrow(_signals(_share(spark, model), n), kinds), "signals")
    sample = bounded_sample(signals.where("held AND labelled"), CALIBRATE, "doc_id", "c").toPandas()
    a, b, c = calibrate((sample["hits"] / sample["clear"]).to_numpy(), sample["hits"].to_numpy(), sample["given"].to_numpy(float))
    posterior = 1 / (1 + F.exp(-(F.lit(float(a)) + F.lit(float(b)) * F.col("hits") / F.col("clear") + F.lit(float(c)) * F.log("hits"))))
    names = F.array(*[F.lit(s) for s in subjects])
    return signals.select("doc_id", F.element_at(names, F.col("c") + 1).alias("subject"), posterior.alias("posterior"), "labelled")


class _Shared:
    """A broadcast of weights; the model is built anew where it is used, so workers need no copy of this package."""

    def __init__(self, weights) -> None:
        self.weights = weights

    @property
    def value(self) -> Model:
        model = Model.__new__(Model)
        model.weights = self.weights.value
        return model


def _share(spark, model: Model) -> _Shared:
    return _Shared(spark.sparkContext.broadcast(model.weights))  # FEATURES x subjects, whatever the corpus


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject of documents without a label."""
    return subject_posteriors(docs, labels, areas).where((F.col("posterior") >= POSTERIOR) & ~F.col("labelled")).select("doc_id", "subject")


def composition(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """subject, documents, mean_posterior: the make-up of the corpus, labelled documents included by their posteriors."""
    p = subject_posteriors(docs, labels, areas)
    return p.groupBy("subject").agg(F.count_if(F.col("posterior") >= POSTERIOR).alias("documents"), F.round(F.sum("posterior"), 3).alias("expected_documents"))
