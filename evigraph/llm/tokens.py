"""Token ids of a whole corpus with a public tokenizer (p7), and sizes in tokens for packing (p8).

Each Python worker turns an Arrow batch of texts into pieces, and only pieces it has not met go through the merges, all
at once, by a pair occurrence index: a map from each adjacent pair of symbols to all its positions in the batch. The
ranks of pairs present sit in a heap; the smallest is applied at all its positions, which removes the pairs beside them
and adds new ones. A pair holding a merged symbol was learnt after that symbol, so new ranks are larger than the one
applied and one ascending pass gives what merging word by word gives. Nothing is shuffled.

Null and empty texts get an empty list of ids (size 0). Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"
#: The splitting patterns of the two vocabularies.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Pieces whose ids a worker keeps; it starts anew when full.
KEEP = 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest counts up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndex:
    """Merges of a BPE vocabulary, applied to many pieces together."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        self.words = model["suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.words] for s in symbols]
        self.split = regex.compile(PATTERNS["word" if self.words else "byte"])
        self.known: dict[str, array] = {}

    def pieces(self, text: str) -> list[str]:
        if self.words:  # this vocabulary reads composed, lower-case text
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.split.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Ids of ``pieces``, added to ``known``."""
        order = list(pieces)
        ids: list[int] = []
        ends: list[int] = []
        for p in order:
            raw = p.encode("utf-8", "replace")
            ids.extend(self.inner[b] for b in raw[:-1])
            ids.append(self.final[raw[-1]])
            ends.append(len(ids))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = 0
        for end in ends:
            before[start], after[end - 1] = -1, -1
            start = end
        where: dict[tuple[int, int], list[int]] = {}
        merges = self.merges
        for i in range(n):
            j = after[i]
            if j >= 0 and (pair := (ids[i], ids[j])) in merges:
                where.setdefault(pair, []).append(i)
        heap = [(merges[p][0], p) for p in where]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            merged = merges[pair][1]
            left, right = pair
            for i in sorted(where.pop(pair)):
                j = after[i]
                if ids[i] != left or j < 0 or ids[j] != right:
                    continue  # taken by a merge before it
                k, h = after[j], before[i]
                ids[i], ids[j], after[i] = merged, -1, k
                if k >= 0:
                    before[k] = i
                    if (p := (merged, ids[k])) in merges:
                        if p not in where:
                            where[p] = []
                            heapq.heappush(heap, (merges[p][0], p))
                        where[p].append(i)
                if h >= 0 and (p := (ids[h], merged)) in merges:
                    if p not in where:
                        where[p] = []
                        heapq.heappush(heap, (merges[p][0], p))
                    where[p].append(h)
        start = 0
        for p, end in zip(order, ends):
            self.known[p] = array("i", (x for x in ids[start:end] if x >= 0))
            start = end

    def split_all(self, texts: list[str | None]) -> list[list[str]]:
        """Pieces of each text; all of them are known afterwards."""
        split = [self.pieces(t) if t else [] for t in texts]
        new = set().union(*split) if split else set()
        if len(self.known) + len(new) > KEEP:
            self.known.clear()
        self.learn({p for p in new if p not in self.known})
        return split


def load_spec(tokenizer: str, folder: str = TOKENIZERS) -> str:
    """The vocabulary file ``{folder}/{tokenizer}.json``, cut down to what merging needs (a few MB)."""
    with open(f"{folder}/{tokenizer}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    return json.dumps({"vocab": model["vocab"], "merges": [m if isinstance(m, list) else m.split(" ") for m in model["merges"]], "suffix": model.get("end_of_word_suffix")})


def _over(spark: SparkSession, spec: str, text_at: int, make: Callable[[PairIndex, list[str | None]], pa.Array], name: str, kind: pa.DataType):
    shared = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PairIndex(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                made = make(index, part.column(text_at).to_pylist())
                kept = [part.column(i) for i in range(part.num_columns) if i != text_at]
                names = [f.name for i, f in enumerate(part.schema) if i != text_at]
                yield pa.RecordBatch.from_arrays([*kept, made.cast(kind)], names=[*names, name])

    return run


def _ids(index: PairIndex, texts: list[str | None]) -> pa.Array:
    flat, offsets = array("i"), [0]
    for pieces in index.split_all(texts):
        for ids in map(index.known.__getitem__, pieces):
            flat += ids
        offsets.append(len(flat))
    values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _sizes(index: PairIndex, texts: list[str | None]) -> pa.Array:
    split = index.split_all(texts)
    size = {p: len(index.known[p]) for p in set().union(*split)} if split else {}
    return pa.array([sum(map(size.__getitem__, pieces)) for pieces in split], pa.int32())


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ids, one row per row of ``docs``, without special tokens; their strings in a text are ordinary text."""
    run = _over(docs.sparkSession, load_spec(tokenizer, folder), 1, _ids, "ids", pa.list_(pa.int32()))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_sizes(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and n_tokens, one row per row of ``docs``."""
    run = _over(docs.sparkSession, load_spec(tokenizer, folder), 1, _sizes, "n_tokens", pa.int32())
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
