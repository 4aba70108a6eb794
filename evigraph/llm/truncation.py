"""Texts cut off by field limits (p5), and the share of cut records per source.

Per source and column the lengths of all values, in characters and in bytes and without a mark of omission at the end,
are counted; a length that occurs far more often than the lengths beside it is a spike, and a value at a spike without
terminal punctuation is cut. A source has several limits (one for each way its pages come), so spikes are sought at every
length; ``route`` tells those at the maximum (fewer open values of the source are longer than are at the spike) from others.

Cuts in mid-transfer have no common length. For these a small classifier says how often a sentence ends after the last
words of a value: it is fitted on the sentences of all values, whose ends and insides label themselves. It knows contexts of
one to three words, and longer ones in which only frequent words keep their form; what it keeps are shares of all words, so
its size is bounded. Evidence that ends on a whole name of its own triplet is a complete
statement without its mark, and no cut.

Null and blank values are no cases. Values that end in terminal punctuation are complete, whatever their length. Values
of no known host share one histogram.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.pages import bodies
from evigraph.runtime import cut, drop, host_of

#: A spike: so many values at one length, and so many times the mean of the lengths within NEAR of it.
SPIKE_COUNT, SPIKE_TIMES, NEAR = 5, 8, 15
#: Words seen less often are known by their class alone; contexts seen less often are not kept. These counts hold up to TOKENS
#: words in all, and grow in proportion beyond.
WORD_COUNT, CONTEXT_COUNT, FRAME_COUNT, TOKENS = 8, 4, 10, 1_500_000
#: In frames, contexts of FRAMES words, a word keeps its form if it is one in COMMON words or more frequent.
FRAMES, COMMON = (8, 7, 6, 5, 4), 300
#: A value is cut where sentences end after its last words more rarely than this; with a mark of omission, than the second.
RATE, MARKED_RATE = 0.05, 0.75

# --- Fixed values: marks of omission at the end of a text; closing marks. ---
MARK = re.compile(
    r"\s*(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…|more)\)|\[truncated\]|\[\+\d+ chars\]|<(?:conn|trunc|eof|end of)[^<>\n]{0,40}>?|read more|weiterlesen|lire la suite|leer más)\s*$", re.I
)
CLOSED = re.compile(r"""[.!?。！？;:]["'”’»)\]]*(?:\s*(?:[:;]-?[)(]|[\U0001F300-\U0001FAFF☀-➿]️?))*$|```$|["”»]$|[:;]-?[)(]$|[\U0001F300-\U0001FAFF☀-➿]️?$""")
# --- End of fixed values. ---
TOKEN = re.compile(r"https?://\S+|\d+(?:[.,:]\d+)*|[㐀-鿿]|[^\W_]+|[^\w\s]")
ENDS = frozenset(".!?。！？")


#: Contexts are hashed as sums of hashes of their words, the last word first, times these, with a last bit of 0; places are counted
#: in blocks of PLACES or a little more.
FACTORS, WORD64, PLACES = [xxhash.xxh64_intdigest(str(i)) | 1 for i in range(max(FRAMES))], (1 << 64) - 1, 400_000
#: Marks and closing marks are looked for in so many characters at the end of a text first. Chunks of text whose tokens are kept.
TAIL, CHUNKS = 100, 300_000


def _hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))


class Endings:
    """How often a sentence ends after given last words. ``words``: counts of frequent words; ``common``: words that keep
    their form in frames; ``rates``: context hash to share of ends."""

    def __init__(self, words: dict[str, int], total: int, rates: dict[int, float] | None = None) -> None:
        self.words, self.rates = words, rates or {}
        self.common = {w for w, n in words.items() if n * COMMON >= total}

    @staticmethod
    def shape(w: str) -> str:
        if w[0].isdigit():
            return "<9>"
        if w.startswith("http"):
            return "<url>"
        return "<A>" if w.isupper() else "<Aa>" if w[0].isupper() else "<a>"

    def forms(self, tokens: list[str]) -> tuple[list[str], list[str]]:
        """The tokens as frames and as contexts of words see them, behind a mark of the line's start."""
        plain = [None if w[0].isalnum() else w for w in tokens]
        shapes = [w or self.shape(x) for w, x in zip(plain, tokens)]
        frame = ["<s>", *(x if x in self.common and not x[0].isdigit() else s for x, s in zip(tokens, shapes))]
        return frame, ["<s>", *(x if x in self.words and not x[0].isdigit() else s for x, s in zip(tokens, shapes))]

    def contexts(self, forms: tuple[list[str], list[str]], i: int) -> Iterator[tuple[int, int]]:
        """Size and hash of each context that ends with token i - 1: frames from the longest, then words from the longest."""
        for parts, sizes in zip(forms, (FRAMES, (3, 2, 1))):
            for n in sizes:
                if i + 1 >= n:
                    key = (sum(_hash(w) * x for w, x in zip(parts[i + 1 - n : i + 1][::-1], FACTORS)) + n) & WORD64 - 1
                    yield n, key - (key >> 63 << 64)

    def rate(self, text: str) -> float:
        """Share of the times that a sentence ended after the longest known context of the last words."""
        tokens: list[str] = []
        for chunk in reversed(text.rsplit("\n", 1)[-1].split()):
            tokens = TOKEN.findall(chunk) + tokens
            if len(tokens) >= max(FRAMES):  # no context is longer
                break
        if not tokens:
            return 1.0
        last = tokens[-1]
        if last not in self.words and self.shape(last) == "<a>" and last[0].isalnum():
            return 0.0  # a word never seen whole
        for _, key in self.contexts(self.forms(tokens), len(tokens)):
            if key in self.rates:
                return self.rates[key]
        return 0.5


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """No token spans white space, so chunks are counted and then read once each."""
    for f in frames:
        chunks: Counter[str] = Counter()
        seen: Counter[str] = Counter()
        for text in f["text"]:
            chunks.update(text.split())
        for chunk, n in chunks.items():
            for w in TOKEN.findall(chunk):
                seen[w] += n
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})


class _Tokens:
    """Numbers of tokens, by chunks of text, with their hashes as frames and as contexts of words see them; 0 is the mark of a line's start."""

    def __init__(self, model: Endings) -> None:
        self.model, self.hashes = model, {}
        self.clear()

    def clear(self) -> None:
        self.chunks, self.numbers, self.ends = {}, {}, [False]
        self.frame, self.plain = ([self.hashed(x)] for x in ("<s>", "<s>"))

    def hashed(self, w: str) -> int:
        if w not in self.hashes:
            self.hashes[w] = _hash(w)
        return self.hashes[w]

    def read(self, chunk: str) -> list[int]:
        tokens, out = TOKEN.findall(chunk), []
        for w, frame, plain in zip(tokens, *(x[1:] for x in self.model.forms(tokens))):
            if w not in self.numbers:
                self.numbers[w] = len(self.ends)
                self.ends.append(w in ENDS)
                self.frame.append(self.hashed(frame))
                self.plain.append(self.hashed(plain))
            out.append(self.numbers[w])
        self.chunks[chunk] = out
        return out


def _context_counts(words: dict[str, int], total: int):
    """size, key, n, ends of the contexts before each place in blocks of texts: ``Endings.contexts`` for all places at once."""

    def keys(known: _Tokens, ids: list[int], line_ends: list[int], last_lines: list[bool]) -> Iterator[tuple[int, np.ndarray]]:
        """Size and, for all places that are asked about, the key with the end as its last bit."""
        at, close, is_end = np.array(ids), np.array(line_ends), np.array(known.ends)
        size = np.diff(close, prepend=-1)
        place = np.arange(len(at)) - np.repeat(close - size + 1, size)
        asked, ends = place > 0, np.append(is_end[at[1:]], True)
        ends[close] = True
        asked[close] &= ~(np.array(last_lines) | is_end[at[close]])  # the end of the text itself is what is asked about
        for hashes, sizes in ((known.frame, FRAMES), (known.plain, (3, 2, 1))):
            parts = np.array(hashes, np.uint64)[at]
            key = np.zeros(len(at), np.uint64)
            for n in range(1, max(sizes) + 1):
                key[n - 1 :] += parts[: len(at) - n + 1] * np.uint64(FACTORS[n - 1])
                if n in sizes:
                    where = asked & (place >= n - 1)
                    yield n, (key[where] + np.uint64(n)) & np.uint64(WORD64 - 1) | ends[where]

    def counted(found: list[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for n in sorted({n for n, _ in found}):
            key = np.sort(np.concatenate([k for m, k in found if m == n]))
            bits, key = (key & np.uint64(1)).astype(np.int64), key & np.uint64(WORD64 - 1)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            yield pd.DataFrame({
                "size": np.full(len(starts), n, np.int32), "key": key[starts].view(np.int64), "n": np.diff(starts, append=len(key)),
                "ends": np.add.reduceat(bits, starts) if len(starts) else starts,
            })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Tokens(Endings(words, total))
        ids: list[int] = []
        line_ends: list[int] = []
        last_lines: list[bool] = []
        for f in frames:
            for text in f["text"]:
                lines = [line for line in text.split("\n") if line.strip()]
                for line in lines:
                    ids.append(0)
                    for chunk in line.split():
                        ids += known.chunks[chunk] if chunk in known.chunks else known.read(chunk)
                    line_ends.append(len(ids) - 1)
                if lines:
                    last_lines += [False] * (len(lines) - 1)
                    last_lines.append(True)
                if len(ids) >= PLACES:
                    yield from counted(list(keys(known, ids, line_ends, last_lines)))
                    ids, line_ends, last_lines = [], [], []
                    if len(known.chunks) > CHUNKS:
                        known.clear()
        if ids:
            yield from counted(list(keys(known, ids, line_ends, last_lines)))

    return run


def _marked(text: str) -> int | None:
    """Where a mark of omission at the end of a stripped text, or the white space before it, begins."""
    # all marks are shorter than TAIL but one that holds a number
    m = MARK.search(text, 0 if text[-6:].lower() == "chars]" else max(0, len(text) - TAIL))
    return len(text[: m.start()].rstrip()) if m else None


def _is_closed(core: str) -> bool:
    """Whether a text ends in terminal punctuation."""
    at = max(0, len(core) - TAIL)
    if CLOSED.search(core, at):
        return True
    return at > 0 and not any(c.isalpha() for c in core[at:]) and CLOSED.search(core) is not None


def _ends_on(text: str, names) -> bool:
    """Whether the text ends on one of the names as a whole."""
    low = text.lower()
    return any(x and low.endswith(x) and not low[: -len(x)][-1:].isalnum() for x in names)


def _features(endings) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Endings(*endings.value)
        for f in frames:
            rows = []
            for text, names in zip(f["text"], f["names"]):
                text = text.rstrip()
                marked = _marked(text)
                core = text[:marked]
                broken = core.endswith("�")
                core = core.rstrip("�")
                open_end = broken or not _is_closed(core)
                named = open_end and not broken and marked is None and names is not None and _ends_on(core, names)
                rate = (0.0 if broken else model.rate(core)) if open_end and not named else 1.0
                rows.append((len(core), len(core.encode("utf-8", "replace")), open_end, rate < (RATE if marked is None else MARKED_RATE)))
            made = pd.DataFrame(rows, columns=["chars", "bytes", "open_end", "inside"])
            yield pd.concat([f[["record_kind", "record_id", "host", "method"]].reset_index(drop=True), made], axis=1)

    return run


def text_values(docs: DataFrame, triplets: DataFrame) -> DataFrame:
    """record_kind, record_id, host, method, names, text: main bodies of documents that are not residue, and evidence of triplets.

    ``names`` are the triplet's own subject and object, trimmed and in lower case (null for documents, and where ``triplets``
    lacks these columns). One row per id; of repeated ids the row with the smallest hash of its text stays.
    """
    where = docs.groupBy("document_id").agg(F.min(host_of(F.col("url"))).alias("host"), F.min("acquisition_method").alias("method"))
    pages = bodies(docs).where("NOT residue").select("document_id", "body").join(where, "document_id")
    none = F.lit(None).cast("array<string>").alias("names")
    a = pages.select(F.lit("source_document").alias("record_kind"), F.col("document_id").alias("record_id"), "host", "method", none, F.col("body").alias("text"))
    ends = [F.lower(F.trim(c)) for c in ("subject", "object") if c in triplets.columns]
    t = triplets.where("triplet_id IS NOT NULL AND evidence IS NOT NULL").select("triplet_id", "evidence", "source_url", F.array(*ends).cast("array<string>").alias("names") if ends else none)
    t = t.groupBy("triplet_id").agg(F.min_by(F.struct("evidence", "source_url", "names"), F.xxhash64("evidence", "source_url", "names")).alias("t"))
    b = t.select(F.lit("triplet").alias("record_kind"), F.col("triplet_id").alias("record_id"), host_of(F.col("t.source_url")).alias("host"), F.lit(None).cast("string").alias("method"), F.col("t.names").alias("names"), F.col("t.evidence").alias("text"))
    return a.unionByName(b).where(r"text RLIKE '\\S'")


def fit_endings(values: DataFrame) -> tuple[dict[str, int], int, dict[int, float]]:
    """Frequent words, total of all words, and rates of the classifier, from all values.

    All are counted in tasks; what is sent to the driver has a share of all words and is bounded by it.
    """
    seen = cut(values.select("text").mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "seen")
    total = seen.agg(F.sum("n")).first()[0] or 0
    times = max(1.0, total / TOKENS)
    got = seen.where(F.col("n") >= WORD_COUNT * times).toArrow()
    words = dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))
    found = values.select("text").mapInPandas(_context_counts(words, total), "size int, key long, n long, ends long").groupBy("size", "key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    least = F.when(F.col("size") >= min(FRAMES), FRAME_COUNT * times).when(F.col("size") > 1, CONTEXT_COUNT * times).otherwise(1)
    got = found.where(F.col("n") >= least).select("key", ((F.col("ends") + 0.1) / (F.col("n") + 0.2)).alias("rate")).toArrow()
    rates = dict(zip(got["key"].to_pylist(), got["rate"].to_pylist()))
    drop(seen)
    return words, total, rates


def cut_values(values: DataFrame) -> DataFrame:
    """record_kind, record_id, host, method, route, is_cut for each value.

    route of cut values: maximum (at a spike beyond which the source has fewer open values than at it), length (at another
    spike), inside (by its last words alone); null for others.
    """
    values = cut(values, "values")
    endings = values.sparkSession.sparkContext.broadcast(fit_endings(values))  # bounded by shares
    kinds = "record_kind string, record_id string, host string, method string, chars int, bytes int, open_end boolean, inside boolean"
    measured = cut(values.mapInPandas(_features(endings), kinds), "measured", done=(values,))
    sources = F.array(F.struct(F.lit("host").alias("by"), F.coalesce("host", F.lit("")).alias("source")), F.struct(F.lit("method").alias("by"), F.col("method").alias("source")))
    sizes = F.array(*[F.struct(F.lit(unit).alias("unit"), F.col(unit).alias("size")) for unit in ("chars", "bytes")])
    key = ["record_kind", "by", "source", "unit", "size"]
    each = measured.withColumn("s", F.explode(sources)).where("s.source IS NOT NULL").withColumn("z", F.explode(sizes)).select("record_kind", "record_id", "open_end", "s.*", "z.*")
    bars = each.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("open_end").alias("open"))
    column = Window.partitionBy("record_kind", "by", "source", "unit").orderBy("size")
    near = column.rangeBetween(-NEAR, NEAR)
    mean = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    longer = F.coalesce(F.sum("open").over(column.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    spikes = bars.withColumn("mean", mean).withColumn("at_maximum", longer < F.col("open")).where((F.col("open") >= SPIKE_COUNT) & (F.col("open") * 2 > F.col("n")) & (F.col("open") >= SPIKE_TIMES * F.col("mean")))
    at = each.where("open_end").join(spikes.select(*key, "at_maximum"), key).groupBy("record_kind", "record_id").agg(F.max("at_maximum").alias("at_maximum"))
    joined = measured.join(at, ["record_kind", "record_id"], "left")
    route = F.when(F.col("at_maximum"), "maximum").when(~F.col("at_maximum"), "length").when(F.col("inside"), "inside")
    return joined.select("record_kind", "record_id", "host", "method", F.when(F.col("open_end"), route).alias("route"), F.coalesce(F.col("open_end") & route.isNotNull(), F.lit(False)).alias("is_cut"))


def cut_share(found: DataFrame) -> DataFrame:
    """Per record_kind and source (by: host or method): records, cut_records and cut_share. Null hosts and methods are one source each."""
    sources = F.array(*[F.struct(F.lit(by).alias("by"), F.col(by).alias("source")) for by in ("host", "method")])
    each = found.withColumn("s", F.explode(sources)).where("NOT (record_kind = 'triplet' AND s.by = 'method')").select("record_kind", "s.*", "is_cut")
    totals = each.groupBy("record_kind", "by", "source").agg(F.count("*").alias("records"), F.count_if("is_cut").alias("cut_records"))
    return totals.withColumn("cut_share", F.round(F.col("cut_records") / F.col("records"), 6))
