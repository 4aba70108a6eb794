"""Variant spellings of names of people and organisations (p2) by metric-space partitioning.

Distinct strings are read into folded words, initials, and the words of organisations (legal forms, lines of business).
Misspelt words are found by an exact radius join under the Levenshtein metric: the cell of a string holds all words that become it
when letters are left out, as many as the radius at most, so each word is replicated to the cells within its radius. Two words within
distance r of each other leave out so many letters at most before they are equal, so they meet in a cell, and the metric itself decides
on what meets. Words of more than LETTERS letters would have too many cells: they are cut into r + 1 segments, one of which a word
within r holds unchanged and at most r places off, and segments are their cells. A word has some tens of cells, however many words
there are, and a cell holds words that are alike alone; cells are joined on their hashes (an equi-join), never grouped. The
radius depends on length: 2 from LONG_WORD letters on, 1 below (and two letters exchanged), 0 below MIN_WORD. A rare word takes the
spelling of its most frequent neighbour, and that of this word's, to the end of the chain.

With corrected words the rarest word of a name is its stem (surname, or the firm's own name). Strings with one stem are one
entity if given names (or nicknames of one name) or lines of business agree and middle initials or legal forms don't differ;
where several entities of a stem differ in these, strings that leave them out are not linked to any. Initials and bare
surnames link only where one entity of the stem fits. Places, events, technologies and concepts are left out by their kind
words and by the types in the registry.

Null and empty strings are no names; strings of no letters have no entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import cut

RADIUS = 2
#: Words of more letters than this are found by segments, whose number doesn't grow with the word.
LETTERS = 14
#: Words shorter than this are compared at radius 1 (or two letters exchanged), and not at all below MIN_WORD.
LONG_WORD, MIN_WORD = 6, 4

# --- Fixed values: words of names. ---
LEGAL = "ag gmbh group partners holdings incorporated limited company corporation sa plc llc".split()
BUSINESS = (
    "energy telecom shipping oil gas power analytics motors systems biotech robotics pharma capital dairy logistics chemicals foods textiles media "
    "minerals insurance research development data services department university institute association international technology carriers growers "
    "lenders coaches transport education agriculture health finance justice bank college school council agency ministry hospital foundation"
).split()
SHORT = {
    "grp": "group", "ptnrs": "partners", "hldgs": "holdings", "inc": "incorporated", "ltd": "limited", "co": "company", "corp": "corporation",
    "intl": "international", "assn": "association", "assoc": "association", "inst": "institute", "tech": "technology", "univ": "university",
    "uni": "university", "dept": "department", "sys": "systems", "chem": "chemicals", "log": "logistics", "svcs": "services", "mfg": "manufacturing",
}
TITLES = set("dr prof professor mr mrs ms miss sir dame rev hon".split())
STOP = set("the of and de la der von van for".split())
OTHER = set(
    "protocol cup summit outage inverter bay valley assay shortage storage pricing access safety reform resilience backlog oversight fatigue "
    "lake river mountain island city county championship festival conference".split()
)
NICKNAMES = {
    "ted": "theodore", "teddy": "theodore", "theo": "theodore", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "bob": "robert", "rob": "robert",
    "bobby": "robert", "dick": "richard", "rick": "richard", "fritz": "friedrich", "sam": "samuel", "sasha": "aleksandra", "mitya": "dmitri", "dima": "dmitri",
    "nell": "eleanor", "nellie": "eleanor", "ellie": "eleanor", "larry": "lawrence", "lupe": "guadalupe", "paco": "francisco", "pancho": "francisco",
    "kit": "christopher", "chris": "christopher", "beth": "elizabeth", "liz": "elizabeth", "betty": "elizabeth", "trish": "patricia", "pat": "patricia",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "bill": "william", "will": "william", "billy": "william", "tony": "anthony", "joe": "joseph",
    "hank": "henry", "harry": "henry", "ned": "edward", "ed": "edward", "eddie": "edward", "chuck": "charles", "charlie": "charles", "becky": "rebecca",
    "sue": "susan", "dot": "dorothy", "dolly": "dorothy", "vicky": "victoria", "tori": "victoria", "nate": "nathaniel", "nat": "nathaniel", "alex": "alexander",
    "sandy": "alexander", "hans": "johannes", "bella": "isabel", "izzy": "isabel", "jack": "john", "jim": "james", "mike": "michael", "tom": "thomas",
}
# --- End of fixed values. ---

ORGANISATION = frozenset(LEGAL + BUSINESS)
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "’": "'"})


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s).casefold().translate(PLAIN) if not unicodedata.combining(c))


def read_name(name: str) -> tuple[str, list[str], list[str], list[str], list[str]]:
    """kind (person, organisation, other), full words, initials, words of business, legal forms."""
    s = re.sub(r"[\"“”«»][^\"“”«»]*[\"“”«»]", " ", unicodedata.normalize("NFKC", name))
    s = re.sub(r"\(([A-Za-z]{2,6})\)", " ", s)
    head, comma, tail = s.partition(",")
    s = fold(s)
    s = re.sub(r"\bs\. ?a\.?(?=\W|$)", " sa ", s).replace("int'l", "intl")
    words: list[str] = []
    initials: list[str] = []
    business: list[str] = []
    legal: list[str] = []
    last = 0
    for m in re.finditer(r"((?:[a-z]\.){1,4}(?![a-z]))|([^\W\d_](?:[^\W\d_]|')*)(\.?)|\d+", s):
        if m[1]:
            initials += [c for c in m[1] if c != "."]
            continue
        w = m[2]
        if w is None:
            words.append(m[0])
            continue
        w = SHORT.get(w, w)
        if m[3] and w not in ORGANISATION and len(w) >= 3:
            fits = [x for x in (*BUSINESS, *LEGAL) if x.startswith(w)]
            w = fits[0] if len(fits) == 1 else w
        if w in TITLES or w in STOP:
            continue
        if w in ORGANISATION:
            (legal if w in LEGAL else business).append(w)
        elif len(w) == 1:
            initials.append(w)
        else:
            words.append(NICKNAMES.get(w, w))
        last += 1
    if not words and business:  # a name of general words alone, as "Department of Energy", is known by these
        words = sorted(set(business))
    if any(w in OTHER for w in words) or any(w.isdigit() for w in words) or re.match(r"port\s+\S+\s*$", s.strip()):
        return "other", words, initials, business, legal
    if business or legal:
        return "organisation", words, [], sorted(set(business)), sorted(set(legal))
    return ("person" if words else "other"), words, initials, [], []


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(n, *read_name(n)) for n in f["name"]]
        yield pd.DataFrame(rows, columns=["name", "kind", "words", "initials", "business", "legal"])


def all_names(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """Distinct non-empty strings of canonical_name, aliases, subject and object."""
    sides = [entities.select(F.col("canonical_name").alias("name")), entities.select(F.explode("aliases").alias("name")), triplets.select(F.col("subject").alias("name")), triplets.select(F.col("object").alias("name"))]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out.where("name IS NOT NULL AND name <> ''").distinct()


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded, and lengths."""
    n = max(map(len, words), default=1)
    out = np.zeros((len(words), n), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, np.array([len(w) for w in words], np.int32)


def distances(word: str, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distances of one word to many, by dynamic programming over all of them at once."""
    rows = np.broadcast_to(np.arange(others.shape[1] + 1, dtype=np.int32), (len(others), others.shape[1] + 1)).copy()
    steps = np.arange(1, others.shape[1] + 1, dtype=np.int32)
    for i, c in enumerate(word, 1):
        best = np.minimum(rows[:, 1:] + 1, rows[:, :-1] + (others != ord(c)))
        best = np.minimum(best, i + steps)  # a prefix wholly inserted
        rows = np.concatenate([np.full((len(others), 1), i, np.int32), best], axis=1)
        # insertions along the row: running minimum of (value - column)
        columns = np.arange(rows.shape[1], dtype=np.int32)
        rows = np.minimum.accumulate(rows - columns, axis=1) + columns
    return rows[np.arange(len(others)), lengths]


#: Strings are hashed as sums of code points times powers of BASE, which holds for any string with letters left out by three sums.
BASE = 0x9E3779B97F4A7C15
LEFT, RIGHT = 1, 2
CELLS = "key long, word string, n long, side int, radius int"


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = h ^ np.uint64(kind * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def left_out(codes: np.ndarray, most: int) -> list[list[np.ndarray]]:
    """Hashes of words of one length with 0, 1, ... ``most`` (2 at most) letters left out; ``codes``: a row of code points per word."""
    n, powers = codes.shape[1], _powers(codes.shape[1])
    # sums[t][:, k]: the first k letters, each t places further to the left
    sums = [np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(codes[:, t:] * powers[: n - t], axis=1, dtype=np.uint64)], axis=1) for t in range(most + 1)]
    between = lambda t, i, j: sums[t][:, j - t] - sums[t][:, i - t]  # noqa: E731  (letters i to j - 1, i >= t)
    out = [[between(0, 0, n)]]
    if most:
        out.append([between(0, 0, i) + between(1, i + 1, n) for i in range(n)])
    if most > 1:
        out.append([between(0, 0, i) + between(1, i + 1, j) + between(2, j + 1, n) for i in range(n) for j in range(i + 1, n)])
    return out


def _segments(n: int) -> list[tuple[int, int]]:
    """Places of the RADIUS + 1 segments of a word of n letters."""
    ends = [n * (i + 1) // (RADIUS + 1) for i in range(RADIUS + 1)]
    return list(zip([0, *ends], ends))


def word_cells(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Keys of the cells of words of one length, one per word each, with side and radius. Of two words that meet the longer one is on
    the LEFT side (either one if they are as long), the other on the RIGHT."""
    n = codes.shape[1]
    if n <= LONG_WORD:
        # a word of LONG_WORD letters meets shorter ones within 1
        for out, found in enumerate(left_out(codes, 1)):
            side = (LEFT if out == 1 else 0) | (RIGHT if n < LONG_WORD else 0)
            for h in found if side else ():
                yield _mix(h, 16 * (n - out) + 1), side, 1
        if n < LONG_WORD:
            yield _mix((np.sort(codes, axis=1) * _powers(n)[:n]).sum(axis=1, dtype=np.uint64), 16 * n + 2), LEFT | RIGHT, RADIUS
    if LONG_WORD <= n <= LETTERS:
        for out, found in enumerate(left_out(codes, RADIUS)):
            for h in found:
                yield _mix(h, 16 * (n - out) + 3), LEFT | RIGHT if out == RADIUS else RIGHT, RADIUS
    hashed = lambda start, end: (codes[:, start:end] * _powers(end - start)[: end - start]).sum(axis=1, dtype=np.uint64)
    if n > LETTERS:
        for i, (start, end) in enumerate(_segments(n)):
            yield _mix(hashed(start, end), 16 * n + 4 + i), LEFT, RADIUS
    for other in range(max(n, LETTERS + 1), n + RADIUS + 1) if n >= LONG_WORD else ():
        for i, (start, end) in enumerate(_segments(other)):
            for at in range(max(0, start - RADIUS), min(n - (end - start), start + RADIUS) + 1):
                yield _mix(hashed(at, at + end - start), 16 * other + 4 + i), RIGHT, RADIUS


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths).tolist():
            of_n = np.flatnonzero(lengths == n)
            for rows in np.split(of_n, range(2000, len(of_n), 2000)):
                codes, part = _matrix([words[i] for i in rows])[0].astype(np.uint64), batch.take(pa.array(rows))
                keys, sides, radii = zip(*word_cells(codes))
                at = pa.array(np.tile(np.arange(len(rows)), len(keys)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(at), part.column(1).take(at),
                    pa.array(np.repeat(np.array(sides, np.int32), len(rows))), pa.array(np.repeat(np.array(radii, np.int32), len(rows))),
                ], names=["key", "word", "n", "side", "radius"])


def _met(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word, n, other, m, distance: pairs of words within the radius, one way round and once for each cell where they meet; the table
    of cells that it reads."""
    asked = words.where(F.length("word") >= MIN_WORD).select("word", F.col("n").cast("long").alias("n"))
    tasks = max(1, min(512, asked.count() // 2000))
    cells = cut(asked.repartition(tasks).mapInArrow(_cells, CELLS), "cells")
    a = cells.where(F.col("side").bitwiseAND(LEFT) > 0).select("key", "word", "n", "radius")
    b = cells.where(F.col("side").bitwiseAND(RIGHT) > 0).select("key", F.col("word").alias("other"), F.col("n").alias("m"))
    size, other = F.length("word"), F.length("other")
    met = a.join(b, "key").where((size > other) | ((size == other) & (F.col("word") < F.col("other"))))
    return met.withColumn("distance", F.levenshtein("word", "other", RADIUS)).where("distance BETWEEN 1 AND radius").select("word", "n", "other", "m", "distance"), cells


def _both_ways(pairs: DataFrame) -> DataFrame:
    turned = F.array(F.struct("word", "n", "other", "m", "distance"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"), "distance"))
    return pairs.select(F.inline(turned))


def close_words(words: DataFrame) -> DataFrame:
    """word, n, other, m, distance: all pairs of different words within the radius, both ways round. ``words``: word, n."""
    return _both_ways(_met(words)[0].distinct())


def _join_cell(f: pd.DataFrame) -> pd.DataFrame:
    """``close_words`` for the words of one frame, rows of ``home`` against the others, with the metric by ``distances``."""
    words = f.drop_duplicates("word")[["word", "n"]]
    cells = pd.concat([b.to_pandas() for b in _cells(iter([pa.RecordBatch.from_pandas(words, preserve_index=False)]))])[["key", "word", "side", "radius"]]
    met = cells[cells["side"] & LEFT > 0].merge(cells[cells["side"] & RIGHT > 0], on="key").query("word_x != word_y")
    both = pd.concat([met[["word_x", "word_y", "radius_x"]], met[["word_y", "word_x", "radius_x"]].set_axis(["word_x", "word_y", "radius_x"], axis=1)])
    both = both.groupby(["word_x", "word_y"], as_index=False)["radius_x"].max()
    home, near = f[f["home"]].set_index("word")["n"], f[~f["home"]].set_index("word")["n"]
    out = []
    for w, g in both[both["word_x"].isin(home.index) & both["word_y"].isin(near.index)].groupby("word_x"):
        others = g["word_y"].tolist()
        for other, radius, x in zip(others, g["radius_x"], distances(w, *_matrix(others)).tolist()):
            if 0 < x <= radius:
                out.append((w, int(home[w]), other, int(near[other]), x))
    return pd.DataFrame(out, columns=["word", "n", "other", "m", "distance"])


def spellings(words: DataFrame) -> DataFrame:
    """word, spelling: words that take the spelling of a more frequent neighbour (ties: the nearer, then the smaller)."""
    met, cells = _met(words)
    better = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("word")))
    rare = F.col("n") * 2 <= F.col("m") + 1
    best = F.min_by("other", F.struct(-F.col("m"), "distance", "other"))  # the same, however often two words meet
    return cut(_both_ways(met).where(better & rare).groupBy("word").agg(best.alias("spelling")), "spellings", done=(cells,))


def _to_the_end(fixed: DataFrame) -> DataFrame:
    """Follows chains of spellings to their ends, doubling the steps each round. Each step leads to a more frequent word (or one
    as frequent and smaller), so there are no circles."""
    while True:
        two = fixed.alias("a").join(fixed.alias("b"), F.col("a.spelling") == F.col("b.word"), "left")
        more = cut(two.select(F.col("a.word").alias("word"), F.coalesce("b.spelling", "a.spelling").alias("spelling"), F.col("b.word").isNotNull().alias("moved")), "spellings")
        fixed = more.select("word", "spelling")
        if not more.where("moved").limit(1).count():
            return fixed


def name_entities(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """name, entity: each string of a person or organisation with the id of its entity (the entity's key as text)."""
    names = cut(all_names(entities, triplets).mapInPandas(_read, "name string, kind string, words array<string>, initials array<string>, business array<string>, legal array<string>"), "names")
    each = names.where("kind <> 'other'").select("name", "kind", F.explode(F.array_distinct("words")).alias("word"))
    words = cut(each.groupBy("word").agg(F.count("*").alias("n")), "words")
    fixed = _to_the_end(spellings(words))
    read = cut(each.join(fixed, "word", "left").select("name", F.coalesce("spelling", "word").alias("word")), "read")
    known = read.groupBy("word").agg(F.count("*").alias("n"))
    read = read.join(known, "word")
    stems = read.groupBy("name").agg(F.min_by("word", F.struct("n", -F.length("word"), "word")).alias("stem"), F.array_sort(F.collect_set("word")).alias("all"))
    rest = F.array_except("all", F.array("stem"))
    parsed = names.where("kind <> 'other'").join(stems, "name").select(
        "name", "kind", "stem",
        F.when(F.col("kind") == "organisation", F.array_join(F.array_union(rest, F.col("business")), " ")).otherwise(F.array_join(rest, " ")).alias("given"),
        F.when(F.col("kind") == "organisation", F.nullif(F.array_join("legal", " "), F.lit(""))).when(F.size(rest) > 0, F.nullif(F.array_join("initials", ""), F.lit(""))).alias("mark"),
        F.when((F.col("kind") == "person") & (F.size(rest) == 0), F.array_join("initials", "")).alias("bare"),
    )
    parsed = cut(parsed, "parsed")
    full = parsed.where("bare IS NULL")
    marks = full.where("mark IS NOT NULL").groupBy("kind", "stem", "given").agg(F.count_distinct("mark").alias("marks"), F.min("mark").alias("only"))
    # without a mark: the one entity of the group, if there is one; else a group of its own
    full = full.join(marks, ["kind", "stem", "given"], "left").select("name", "kind", "stem", "given", F.coalesce("mark", F.when(F.col("marks") == 1, F.col("only")), F.lit("")).alias("mark"))
    key = F.concat_ws("|", "kind", "stem", "given", "mark")
    full = cut(full.select("name", "kind", "stem", "given", "mark", key.alias("entity")), "full")
    groups = full.select("kind", "stem", "given", "mark", "entity").distinct()
    people = groups.where("kind = 'person'").select("stem", "given", "mark", "entity")
    short = parsed.where("bare IS NOT NULL AND bare <> ''").select("name", "stem", "bare")
    fits = (F.substring("given", 1, 1) == F.substring("bare", 1, 1)) & ((F.length("bare") == 1) | (F.col("mark") == "") | F.col("mark").startswith(F.substring("bare", 2, 1)))
    # "Stem P.A." for "Stem Pharma AG": first letters of the lines of business and the legal form
    firms = groups.where("kind = 'organisation'").select("stem", "entity", F.array_join(F.array_sort(F.transform(F.filter(F.split(F.concat_ws(" ", "given", "mark"), " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1))), "").alias("letters"))
    letters = F.array_join(F.array_sort(F.filter(F.split("bare", ""), lambda c: c != "")), "")
    candidates = short.join(people, "stem").where(fits).select("name", "entity").unionByName(
        short.where(F.length("bare") > 1).join(firms, "stem").where(F.col("letters") == letters).select("name", "entity")
    )
    by_initial = candidates.groupBy("name").agg(F.count("*").alias("k"), F.min("entity").alias("entity")).where("k = 1").select("name", "entity")
    alone = parsed.where("bare = ''").select("name", "stem").join(groups, "stem").groupBy("name").agg(F.count("*").alias("k"), F.min("entity").alias("entity")).where("k = 1").select("name", "entity")
    initials = short.join(by_initial, "name", "left_anti").select("name", F.concat(F.lit("initials|"), "stem", F.lit("|"), "bare").alias("entity"))
    found = full.select("name", "entity").unionByName(by_initial).unionByName(alone).unionByName(initials)
    other = entities.where("lower(type) NOT IN ('person', 'people', 'organization', 'organisation', 'org', 'orgs', 'company', 'companies')").select(F.col("canonical_name").alias("name"))
    wrong = found.join(other.distinct(), "name").select("entity").distinct()
    return found.join(wrong, "entity", "left_anti").select("name", "entity")


def variant_pairs(entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """name_a < name_b (UTF-8 bytes): pairs of different strings of one entity."""
    found = cut(name_entities(entities, triplets), "entities")
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
