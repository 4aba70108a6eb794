import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

import pandas as pd

from evigraph.llm import names, subjects


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_distances():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    m, n = names._matrix(words)
    for w in words[:25]:
        assert names.distances(w, m, n).tolist() == [levenshtein(w, x) for x in words]


def test_close_words_match_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    words = set(base)
    for w in base:
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice("xyz") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]}
    words = sorted(w for w in words if len(w) >= names.MIN_WORD)
    def near(a, b):
        d = levenshtein(a, b)
        return 0 < d <= (2 if min(len(a), len(b)) >= names.LONG_WORD or sorted(a) == sorted(b) else 1)
    want = {(a, b) for a in words for b in words if near(a, b)}
    df = spark.createDataFrame([(w, 1) for w in words] + [("ab", 1)], "word string, n long")
    got = [(r["word"], r["other"]) for r in names.close_words(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


SAME = [
    ["Theodore J. Marivokal", "Marivokal, Theodore", "MARIVOKAL Theodore", "Ted Marivokal", 'Theodore "Ted" Marivokal', "Dr. Theodore  Marivokal", "Theodore Marivokla", "T. J. Marivokal", "theodore j. marivokal "],
    ["Margaret Marivokal", "Peggy Marivokal", "Mrgaret Marivokal"],
    ["Zepofalik Telecom Holdings", "Zepofalik Telecom, Hldgs", "The Zepofalik Telecom Holdings", "Zepofalik Telecom Holdings (ZTH)", "Telecom Zepofalik", "Zepofalic Telecom Holdings", "Zepofalik T.H."],
    ["Zepofalik Shipping GmbH", "ZEPOFALIK SHIPPING GMBH"],
    ["International Bovirames Lenders Association", "Bovirames Int'l Assn. of Lenders"],
    ["University of Cadolipen", "Uni of Cadolipen", "The University of Cadolipen"],
]
OTHER = ["Port Gusaved", "Fanilo Bay", "2024 Rikemo summit", "tariff shortage", "Dupelov protocol", "Xxtyped Thing"]


def test_entities(spark):
    rng = random.Random(3)
    more = [f"{g} {''.join(rng.choice('bdfgklmnprst') + rng.choice('aeiou') for _ in range(5))}" for g in ("Theodore", "Margaret") for _ in range(30)]
    every = [n for g in SAME for n in g] + OTHER + more
    entities = spark.createDataFrame([("Xxtyped Thing", "concept", [None, ""]), (None, None, None)], "canonical_name string, type string, aliases array<string>")
    triplets = spark.createDataFrame([(n, every[i - 1], 1) for i, n in enumerate(every)] + [("", None, 1), ("!!", " ", 1)], "subject string, object string, entity int")
    got = {r["name"]: r["entity"] for r in names.name_entities(entities, triplets).collect()}
    for group in SAME:
        assert len({got[n] for n in group}) == 1, [(n, got.get(n)) for n in group]
    assert len({got[g[0]] for g in SAME}) == len(SAME) and not set(OTHER) & set(got) and not {"", "!!", " "} & set(got)
    pairs = {tuple(r) for r in names.variant_pairs(entities, triplets).collect()}
    assert all(a < b for a, b in pairs) and ("Peggy Marivokal", "Theodore Marivokla") not in pairs and tuple(sorted(SAME[3])) in pairs
    assert names.variant_pairs(entities.limit(0), triplets.limit(0)).count() == 0


def test_ambiguous_strings_are_left_alone(spark):
    rows = ["Kofi A. Banodel", "Kofi T. Banodel", "Kofi Banodel", "K. Banodel", "Lusefor Power GmbH", "Lusefor Power Limited", "Lusefor Power"]
    e = spark.createDataFrame([], "canonical_name string, type string, aliases array<string>")
    got = {r["name"]: r["entity"] for r in names.name_entities(e, spark.createDataFrame([(r, None) for r in rows], "subject string, object string")).collect()}
    assert len({got[r] for r in rows[:4]}) == 4 and len({got[r] for r in rows[4:]}) == 3


def labelled_corpus():
    rng = random.Random(4)
    vocab = {s: [f"{s}{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(30)] for s in ("law", "sport", "energy")}
    common = [f"common{chr(97 + i)}" for i in range(20)]
    docs, labels, truth = [], [], {}
    for i in range(600):
        about = rng.sample(sorted(vocab), rng.choice([1, 1, 1, 2]))
        sentences = [" ".join(rng.choice(vocab[s] if rng.random() < 0.35 else common) for _ in range(12)) + "." for s in about for _ in range(5)]
        if rng.random() < 0.2:
            sentences.append(" ".join(rng.choice(common) for _ in range(12)) + ".")
        rng.shuffle(sentences)
        docs.append((i, " ".join(sentences)))
        truth[i] = set(about)
        if i % 4 == 0:
            labels += [(i, s, "r1") for s in about]
    return docs + [(9000, None), (9001, " "), (9002, "nothing known at all")], labels + [(0, "unused", "r2"), (None, "law", "r1"), (99999, "law", "r1")], truth


def test_subjects(spark):
    docs, labels, truth = labelled_corpus()
    d, l = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, mask int"), spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    a = spark.createDataFrame([(s, "") for s in ("law", "sport", "energy")], "subject string, about string")
    got = {tuple(r) for r in subjects.document_subjects(d, l, a).collect()}
    want = {(i, s) for i, ss in truth.items() if i % 4 for s in ss}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got) and not {i for i, _ in got} & {0, 9000, 9001, 9002}
    c = {r["subject"]: r["documents"] for r in subjects.composition(d, l, a).collect()}
    assert set(c) == {"law", "sport", "energy"}
    assert subjects.document_subjects(d.limit(0), l.limit(0), a).count() == 0


def test_calibration_orders_posteriors():
    rng = np.random.default_rng(0)
    share, hits = rng.random(500), rng.integers(1, 9, 500).astype(float)
    w = subjects.calibrate(share, hits, (rng.random(500) < share).astype(float))
    assert w[1] > 0 and subjects.calibrate(share, hits, np.ones(500)).shape == (3,)


def test_segments_lose_no_pair_within_the_radius():
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 11))) for _ in range(250)]
    words = sorted({*base, *(w[:i] + rng.choice("abcde") + w[i + rng.randint(0, 1) :] for w in base for i in (1, 3)), *(w[1] + w[0] + w[2:] for w in base)})
    words = [w for w in words if len(w) >= names.MIN_WORD]
    f = pd.DataFrame([(w, 1, home) for w in words for home in (True, False)], columns=["word", "n", "home"])
    got = {(r.word, r.other): r.distance for r in names._join_cell(f).itertuples()}
    matrix, lengths = names._matrix(words)
    want = {}
    for w in words:
        for o, d in zip(words, names.distances(w, matrix, lengths)):
            if 0 < d <= (2 if min(len(w), len(o)) >= names.LONG_WORD or sorted(w) == sorted(o) else 1):
                want[w, o] = int(d)
    assert got == want and len(want) > 500


def test_chains_of_spellings_end_at_one_word(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "word string, spelling string")
    assert {tuple(r) for r in names._to_the_end(chain).collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e"), ("x", "y")}


def test_words_meet_those_that_are_alike_alone(spark):
    rng = random.Random(6)
    some = lambda n: {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(7, 20))) for _ in range(n)}
    rows = lambda words: spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    cells = lambda words: next(names._cells(iter([pa.RecordBatch.from_pydict({"word": sorted(words), "n": [1] * len(words)})]))).num_rows
    assert cells({"x" * 5000}) < 300  # of a word as long as this, too
    words = some(4000)
    met, _ = names._met(rows(words))
    keys = [k for b in names._cells(iter([pa.RecordBatch.from_pydict({"word": sorted(words), "n": [1] * len(words)})])) for k in b.column(0).to_pylist()]
    assert sum(n - 1 for n in Counter(keys).values()) < 40 * len(words) and met.count() < len(words)  # all pairs: 8,000,000


def test_long_words_and_odd_letters_match_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abeéß中😀") for _ in range(rng.choice((5, 6, 12, 13, 14, 15, 16, 17, 40)))) for _ in range(90)]
    words = set(base)
    for w in base:
        i, j = rng.randrange(len(w)), rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "xy" + w[i:], w[:i] + "x" + w[i + 1 :], (w[:j] + "y" + w[j:]).replace(w[i], "", 1)}
    words = sorted(w for w in words if len(w) >= names.MIN_WORD)
    want = {(a, b) for a in words for b in words if 0 < levenshtein(a, b) <= (2 if min(len(a), len(b)) >= names.LONG_WORD or sorted(a) == sorted(b) else 1)}
    got = [(r["word"], r["other"]) for r in names.close_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
