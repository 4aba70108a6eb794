import random

import pytest

from evigraph.llm import neardup, splitting
from evigraph.llm.queries import P4_SQL


def check(text, size, overlap, unit):
    pieces = splitting.split_text(text, size, overlap, unit)
    assert bool(pieces) == (splitting.measure(text, unit) > size)
    if pieces:
        assert "".join(text[(pieces[i - 1][1] if i else 0) : p[1]] for i, p in enumerate(pieces)) == text
        assert all(splitting.measure(text[a:b], unit) <= size for a, b in pieces)
    return pieces


@pytest.mark.parametrize("unit", splitting.UNITS)
def test_round_trip(unit):
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "\n", ". ", "。", "é", "漢", "\t", "\n\n", "😀", ", ", " "]) for _ in range(rng.randint(0, 150)))
        size = rng.randint(8, 40)
        check(text, size, rng.randint(0, size - 5), unit)


def test_boundaries_and_overlap():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven twelve."
    p = check(text, 7, 0, "words")
    assert [text[a:b] for a, b in p] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven twelve."]
    p = check(text, 8, 2, "words")
    assert text[p[1][0] : p[1][1]].split()[:3] == ["five", "six.", "Seven"]
    for unit in ("chars", "words"):
        long = " ".join(f"w{i}" for i in range(500))
        p = check(long, 50, 10, unit)
        assert all(splitting.measure(long[p[i][0] : p[i - 1][1]], unit) == 10 for i in range(1, len(p)))
    assert len(check("x" * 1000, 100, 0, "bytes")) == 10 and check("", 5, 0, "words") == []


def test_documents(spark):
    rows = [("a", "w " * 50, 1), ("a", "w " * 50, 2), ("b", None, 3), ("c", "", 4), (None, "w " * 50, 5), ("d", "漢" * 30, 6)]
    docs = spark.createDataFrame(rows, "document_id string, content string, piece_no int")
    settings = spark.createDataFrame([(1, 20, 5, "words"), (2, 29, None, "chars"), (3, 89, 4, "bytes"), (4, 0, 0, "words"), (5, 9, 0, "pages")], "settings_id int, chunk_size int, chunk_overlap int, chunk_unit string")
    got = splitting.split_documents(docs, settings).collect()
    assert {(r["settings_id"], r["document_id"]) for r in got} == {(1, "a"), (2, "a"), (3, "a"), (2, "d"), (3, "d")}
    assert len({(r["settings_id"], r["document_id"], r["piece_no"]) for r in got}) == len(got) and all(len(r["piece"]) == r["end_char"] - r["start_char"] for r in got)
    assert splitting.split_documents(docs.limit(0), settings).count() == 0 and splitting.split_documents(docs, settings.limit(0)).count() == 0


def test_found_against_sql(spark, sf_dir):
    from evigraph.llm.queries import p4_found
    from tests.oracle import connect, rows

    assert rows(p4_found(spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(P4_SQL).df())


def shingles(text, k):
    w = [x.lower() for x in neardup.WORD.findall(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for v in range(5):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.08, 0.12]))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((f"d{g:02d}{v}", " ".join(w)))
    return rows + [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("short", "one two"), ("null", None), ("empty", "")]


@pytest.mark.parametrize("k,s", [(3, 0.6), (5, 0.8)])
def test_pairs_match_brute_force(spark, k, s):
    rows = corpus()
    sets = {i: shingles(t, k) for i, t in rows if t and len(neardup.WORD.findall(t)) >= k}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(*r, 1) for r in rows], "document_id string, body string, class int")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df, k, s).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) > 20
    classes = {r["document_id"]: r for r in neardup.near_duplicate_classes(df, k, s).collect()}
    assert classes["copy1"]["class"] == classes["copy2"]["class"] and classes["copy1"]["copies"] >= 3 and "short" not in classes
    assert neardup.near_duplicate_pairs(df.limit(0), k, s).count() == 0


def test_masks_cover_two_differences():
    for a in range(7):
        for b in range(7):
            assert any(a not in kept and b not in kept for kept in neardup.MASKS)


def test_chunks_between_white_space_are_read_once():
    from evigraph.llm.neardup import Sketcher

    s = Sketcher()
    text = "The grid-code, of_the GRID\u00a0fails.\n-- the grid-code of the grid fails"
    assert s.grams(text).tolist() == Sketcher().grams("the grid code of the grid fails the grid code of the grid fails").tolist()
    assert set(s.words) == {"the", "grid-code,", "of_the", "grid", "fails.", "--", "grid-code", "of", "fails"} and not len(s.grams("-- grid _ code"))
