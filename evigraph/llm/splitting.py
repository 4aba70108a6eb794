"""Splitting oversized texts at natural boundaries (p4) by agglomerative merging.

A text larger than the limit starts as atomic segments: sentences and lines; one that does not fit is broken at clauses,
then at white space, and a run without any is cut hard. Boundaries have strengths (paragraph, line, sentence, clause,
word, none). Adjacent pairs sit in a heap by strength of the boundary between them, then by joint size, then by place; the
weakest is merged first, as long as the joint size plus the overlap fits, so the boundaries that remain are the strongest
that can be kept. Every piece but the first then reaches back over ``chunk_overlap`` units of the text before it.

Null contents give no rows; contents within the limit give no rows either, they need no cut. An overlap is taken as at
least 0 and at most chunk_size - 1; settings with a null or non-positive chunk_size or an unknown unit give no rows.
Concatenating the pieces without their overlaps restores the content. Of rows repeating a document_id with differing
contents the one with the smallest hash counts; equal repeats count once.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^ \t\n\r]+")
#: Boundaries, strongest first: blank line, line end, sentence end, sentence end of scripts without spaces.
BOUNDARY = re.compile(r"(\n[ \t\r]*\n[ \t\r\n]*)|(\n[ \t\r]*)|([.!?…][\"”’)\]]*[ \t\r]+)|([。！？][\"”’）」]*)")
CLAUSE = re.compile(r"[,;:–—，；：、][ \t]*")
SPACE = re.compile(r"[ \t\r\n]+")
PARAGRAPH, LINE, SENTENCE, CLAUSE_END, WORD_END, NONE = 5, 4, 3, 2, 1, 0
UNITS = ("words", "chars", "bytes")


def measure(text: str, unit: str) -> int:
    """Size of a text: words are longest runs without space, tab or line end; chars are code points; bytes are of UTF-8."""
    if unit == "words":
        return sum(1 for _ in WORD.finditer(text))
    return len(text) if unit == "chars" else len(text.encode("utf-8", "surrogatepass"))


def _within_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] not in " \t\n\r" and text[at - 1] not in " \t\n\r"


def _atoms(text: str, unit: str, room: int) -> tuple[list[int], list[int], list[int]]:
    """Ends, strengths of the boundary at each end, and sizes of the atomic segments."""
    marks = [(m.end(), (PARAGRAPH, LINE, SENTENCE, SENTENCE)[m.lastindex - 1]) for m in BOUNDARY.finditer(text)]
    ends, strengths, sizes = [], [], []

    def add(start: int, end: int, strength: int, level: int) -> None:
        if start >= end:
            return
        size = measure(text[start:end], unit)
        if size <= room:
            ends.append(end)
            strengths.append(strength)
            sizes.append(size)
            return
        if level < 2:
            at = start
            for m in (CLAUSE, SPACE)[level].finditer(text, start, end):
                if m.end() < end and not (unit == "words" and _within_word(text, m.end())):
                    add(at, m.end(), (CLAUSE_END, WORD_END)[level], level + 1)
                    at = m.end()
            add(at, end, strength, level + 1)
            return
        at = start
        while at < end:  # no boundary at all: as much as fits
            if unit == "bytes":
                stop, left = at, room
                while stop < end and (width := len(text[stop].encode("utf-8", "surrogatepass"))) <= left:
                    left -= width
                    stop += 1
                stop = max(stop, at + 1)
            else:
                stop = min(end, at + room)
            ends.append(stop)
            strengths.append(strength if stop == end else NONE)
            sizes.append(measure(text[at:stop], unit))
            at = stop

    at = 0
    for end, strength in marks:
        if end < len(text) and not (unit == "words" and _within_word(text, end)):
            add(at, end, strength, 0)
            at = end
    add(at, len(text), PARAGRAPH, 0)
    return ends, strengths, sizes


def split_text(text: str, chunk_size: int, overlap: int, unit: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each piece with its overlap; empty if the text is within ``chunk_size``."""
    if measure(text, unit) <= chunk_size:
        return []
    overlap = max(0, min(overlap, chunk_size - 1))
    room = chunk_size - overlap
    ends, strengths, sizes = _atoms(text, unit, room)
    n = len(ends)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strengths[i], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or sizes[i] + sizes[j] != size:
            continue  # one of the two has been merged since
        sizes[i], ends[i], strengths[i], alive[j], after[i] = size, ends[j], strengths[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if size + sizes[after[i]] <= room:
                heapq.heappush(heap, (strengths[i], size + sizes[after[i]], i, after[i]))
        if before[i] >= 0 and size + sizes[before[i]] <= room:
            heapq.heappush(heap, (strengths[before[i]], size + sizes[before[i]], before[i], i))
    starts = [m.start() for m in WORD.finditer(text)] if unit == "words" and overlap else []
    pieces, start = [], 0
    for i in range(n):
        if not alive[i]:
            continue
        begin = start
        if start and overlap:
            if unit == "words":
                begin = starts[max(0, bisect_left(starts, start) - overlap)]
            elif unit == "chars":
                begin = max(0, start - overlap)
            else:
                left = overlap
                while begin and (width := len(text[begin - 1].encode("utf-8", "surrogatepass"))) <= left:
                    left -= width
                    begin -= 1
        pieces.append((begin, ends[i]))
        start = ends[i]
    return pieces


NAMES = ["settings_id", "document_id", "chash", "piece_no", "start_char", "end_char", "piece_size", "piece"]
KINDS = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]


def _split(settings: list[tuple[int, int, int, str]], with_text: bool):
    """Pieces of each text. With texts, batches come in order of document_id and hash: of an id's contents the first that has to be
    split for a settings row is, the others are not."""
    width = len(NAMES) - (not with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows: list[list] = [[] for _ in range(width)]
                part = batch.slice(at, 200)
                for key, text, chash in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if key != now:
                        now, taken = key, {}
                    for settings_id, size, overlap, unit in settings:
                        if with_text and settings_id in taken:
                            continue
                        for k, (start, end) in enumerate(split_text(text, size, overlap, unit), 1):
                            taken[settings_id] = chash
                            piece = text[start:end]
                            for column, value in zip(rows, (settings_id, key, chash, k, start, end, measure(piece, unit), piece)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, KINDS)], names=NAMES[:width])

    return run


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows of an id and content that the task has passed on already, so that a row repeated very often is sent once a task."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keep = []
        for pair in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            keep.append(pair not in seen)
            seen.add(pair)
        yield batch.filter(pa.array(keep, pa.bool_()))


def split_documents(docs: DataFrame, settings: DataFrame, with_text: bool = True) -> DataFrame:
    """settings_id, document_id, piece_no (from 1), start_char, end_char, piece_size and, if asked, piece.

    ``settings`` is the table of settings profiles: settings_id, chunk_size, chunk_overlap, chunk_unit. Repeated rows count once;
    where contents of an id differ, that of the smallest hash is split, of those that have to be. With pieces, contents are
    brought together by id before they are split, and nothing is shuffled after; without, the few numbers of each piece are.
    """
    rows = settings.where("settings_id IS NOT NULL AND chunk_size > 0").select("settings_id", "chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("o"), "chunk_unit").collect()
    used = sorted((r[0], r[1], r[2], r[3]) for r in rows if r[3] in UNITS)
    least = min((r[1] for r in used), default=0)  # a text has no more words or code points than bytes
    base = docs.where("document_id IS NOT NULL AND content IS NOT NULL").where(F.octet_length("content") > least).select("document_id", "content", F.xxhash64("content").alias("chash"))
    kinds = "settings_id int, document_id string, chash long, piece_no int, start_char int, end_char int, piece_size int" + ", piece string" * with_text
    if with_text:
        once = base.mapInArrow(_without_repeats, base.schema).repartition("document_id").sortWithinPartitions("document_id", "chash")
        return once.mapInArrow(_split(used, True), kinds).drop("chash")
    made = base.mapInArrow(_split(used, with_text), kinds).dropDuplicates(["settings_id", "document_id", "piece_no", "chash"])
    # the smallest hash among contents that had to be split
    first = F.min("chash").over(Window.partitionBy("settings_id", "document_id"))
    return made.withColumn("first", first).where("chash = first").drop("chash", "first")


def restored(pieces: DataFrame, settings: DataFrame) -> DataFrame:
    """settings_id, document_id, text_hash (SHA-1 of the text that the pieces make without their overlaps), over_limit (pieces larger than chunk_size)."""
    before = F.lag("end_char", 1, 0).over(Window.partitionBy("settings_id", "document_id").orderBy("piece_no"))
    new = pieces.withColumn("at", before).withColumn("new", F.expr("substring(piece, at - start_char + 1)"))
    sized = new.join(F.broadcast(settings.select("settings_id", "chunk_size")), "settings_id")  # a table of settings
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), "")
    return sized.groupBy("settings_id", "document_id").agg(F.sha1(text).alias("text_hash"), F.count_if(F.col("piece_size") > F.col("chunk_size")).alias("over_limit"))
