"""Near-duplicate records with small edits (p6) by covering locality-sensitive hashing.

A text is the set of its runs of ``SHINGLE`` words. Its sketch is FAMILIES x 7 minhash values. Within a family the seven
positions are the non-zero vectors of {0,1}^3, and there is one table for each non-zero mask v, keyed by the values at
the four positions p with <p, v> = 1. Any two positions lie in the kernel of some mask, so two sketches that differ at no
more than two of a family's seven positions collide in one of its seven tables for certain (the covering property of
structured masks; Pagh, "CoveringLSH"). At a similarity of 0.65 a family misses a pair with probability 0.41, all eight
together with 0.0009; at 0.6 with 0.006. Candidates are verified on their whole sets.

Texts with equal sets are one class and enter once, by the hash of the set. Tables are joined on their keys (equi-join,
split by adaptive execution where a key is hot), never grouped; a set travels once, and once more for each candidate of it.
Each step is written to a table and the shuffle files and tables behind it are removed, so the disk used is that of the
widest step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.pages import bodies
from evigraph.runtime import cut

WORD = re.compile(r"[^\W_]+")
SHINGLE, SIMILARITY, FAMILIES = 3, 0.6, 8
SKETCH = "document_id string, n int, class long, grams array<int>"
KEYS = "class long, n int, key long"


def _mix(h: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: masks[v - 1] lists the four of seven positions that mask v keeps.
MASKS = [[p - 1 for p in range(1, 8) if bin(p & v).count("1") % 2] for v in range(1, 8)]


class _Hashes(dict):
    """Hashes of the words of a chunk between white space, which no word spans; each made when it is first asked for."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        h = self[chunk] = tuple(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in WORD.findall(chunk))
        return h


class Sketcher:
    """Shingle sets, minhash values and table keys of texts."""

    def __init__(self, shingle: int = SHINGLE, families: int = FAMILIES) -> None:
        self.k, self.families, self.words = shingle, families, _Hashes()
        seeds = np.arange(1, families * 7 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.factors = _mix(seeds) | np.uint64(1)
        self.powers = [_mix(np.array([i + 101], dtype=np.uint64))[0] | np.uint64(1) for i in range(max(shingle, 4))]

    def grams(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of ``shingle`` words."""
        words = self.words
        if len(words) > 500_000:
            words.clear()
        h = np.fromiter(chain.from_iterable(map(words.__getitem__, text.lower().split())), np.uint64)
        if len(h) < self.k:
            return np.empty(0, np.uint64)
        n = len(h) - self.k + 1
        total = h[:n] * self.powers[0]
        for i in range(1, self.k):
            total = total + h[i : i + n] * self.powers[i]
        grams = np.sort(_mix(total))
        return grams[np.append(True, grams[1:] != grams[:-1])]

    def minhash(self, grams: np.ndarray) -> np.ndarray:
        """Minima of 32-bit shingle hashes under each of the permutations."""
        grams, out = _mix(grams.astype(np.uint64)), None
        for start in range(0, len(grams), 4096):
            part = (self.factors[:, None] * grams[None, start : start + 4096]).min(axis=1)
            out = part if out is None else np.minimum(out, part)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """Table keys of sketches: (texts, families * 7) from (texts, families * 7)."""
        m = minima.reshape(len(minima), self.families, 7)
        tables = []
        for v, kept in enumerate(MASKS):
            total = np.zeros(m.shape[:2], np.uint64)
            for power, p in zip(self.powers, kept):
                total = total + _mix(m[:, :, p]) * power
            family = np.arange(self.families, dtype=np.uint64)[None, :]
            tables.append(_mix(total + family * np.uint64(64) + np.uint64(v + 1)))
        return np.stack(tables, axis=2).reshape(len(minima), -1)


def _lists(values: np.ndarray, offsets: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(shingle)
        with np.errstate(over="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    ids, counts, classes, grams = [], [], [], []
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        g = s.grams(text)
                        if not len(g):
                            continue
                        ids.append(key)
                        counts.append(len(g))
                        classes.append(xxhash.xxh64_intdigest(g.tobytes()))
                        grams.append((g & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                    if ids:
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids, pa.string()), pa.array(counts, pa.int32()), pa.array(np.array(classes, np.uint64).view(np.int64)),
                            _lists(np.concatenate(grams), [0, *np.cumsum(counts).tolist()], pa.int32()),
                        ], names=["document_id", "n", "class", "grams"])

    return run


def _table_keys(families: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(1, families)
        with np.errstate(over="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    lists = part.column(2)
                    values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
                    keys = s.keys(np.stack([s.minhash(g.view(np.uint32)) for g in np.split(values, ends[:-1])]))
                    per = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(part.column(0).to_numpy(), per)), pa.array(np.repeat(part.column(1).to_numpy(), per)), pa.array(keys.reshape(-1).view(np.int64)),
                    ], names=["class", "n", "key"])

    return run


def sketches(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """document_id, n (distinct shingles), class (hash of the set), grams (lower 32 bits of the shingle hashes).

    ``texts`` has document_id and body; null bodies and bodies of fewer words than a shingle give no row.
    """
    return texts.where("body IS NOT NULL").select("document_id", "body").mapInArrow(_sketches(shingle), SKETCH)


def classes_of(texts: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Two tables: document_id, class of each document; class, n, grams of each class."""
    sketched = cut(sketches(texts, shingle), "sketches")
    members = cut(sketched.select("document_id", "class"), "members")
    return members, cut(sketched.groupBy("class").agg(F.any_value("n").alias("n"), F.any_value("grams").alias("grams")), "classes", done=(sketched,))


def similar_classes(classes: DataFrame, similarity: float = SIMILARITY, families: int = FAMILIES) -> DataFrame:
    """class_a < class_b, shared, similarity: pairs of different sets with a Jaccard similarity from ``similarity`` on."""
    tables = classes.select("class", "n", "grams").mapInArrow(_table_keys(families), KEYS)
    a, b = tables.select("key", F.col("class").alias("class_a"), F.col("n").alias("na")), tables.select("key", F.col("class").alias("class_b"), F.col("n").alias("nb"))
    near = a.join(b, "key").where("class_a < class_b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("class_a", "class_b").distinct()
    near = cut(near, "candidates")
    sa, sb = classes.select(F.col("class").alias("class_a"), F.col("grams").alias("ga"), F.col("n").alias("na")), classes.select(F.col("class").alias("class_b"), F.col("grams").alias("gb"), F.col("n").alias("nb"))
    both = near.join(sa, "class_a").join(sb, "class_b").select("class_a", "class_b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("shared"))
    found = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    found = both.select("class_a", "class_b", "shared", found.alias("similarity")).where(F.col("similarity") >= similarity)
    return cut(found, "similar", done=(near, classes))


def near_duplicate_classes(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with a shingle: document_id, class, copies (documents of the class), links (similar classes)."""
    members, classes = classes_of(texts, shingle)
    pairs = similar_classes(classes, similarity)
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    return members.join(copies, "class").join(links, "class", "left").select("document_id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """document_id_a < document_id_b: all pairs of documents with a similarity from ``similarity`` on, copies included."""
    member, classes = classes_of(texts, shingle)
    pairs = similar_classes(classes, similarity).select("class_a", "class_b")
    ma, mb = member.select(F.col("class").alias("class_a"), F.col("document_id").alias("x")), member.select(F.col("class").alias("class_b"), F.col("document_id").alias("y"))
    across = pairs.join(ma, "class_a").join(mb, "class_b").select(F.least("x", "y").alias("document_id_a"), F.greatest("x", "y").alias("document_id_b"))
    within = ma.join(mb, F.col("class_a") == F.col("class_b")).where("x < y").select(F.col("x").alias("document_id_a"), F.col("y").alias("document_id_b"))
    return across.unionByName(within).where("document_id_a < document_id_b")


def page_texts(docs: DataFrame) -> DataFrame:
    """document_id and main body of records that are not residue."""
    return bodies(docs).where("NOT residue").select("document_id", "body")
