import os
import random

import pytest

from evigraph.llm import packing, tokens

TEXTS = ["", None, " ", "Hello world", "  two  spaces \n\n\ttabs", "naïve café — Ωmega ΣΑΣ İstanbul", "中文字符测试。", "emoji 😀👩‍👩‍👧 zero​width", "<|endoftext|> <|startoftext|>", "don't we'll I'M '", "a" * 3000, "x y " * 2000, "퟿", "12345 67.89 1e5", "\r\n 　"]
needs = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabularies")


@needs
@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x4E00, 0x4E80), 0x1F600, 10])) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    lib = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{name}.json")
    lib.encode_special_tokens = True
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    index = tokens.PairIndex(tokens.load_spec(name))
    assert tokens._ids(index, texts).to_pylist() == want
    assert tokens._sizes(index, texts).to_pylist() == [len(w) for w in want]


@needs
def test_encode(spark):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS) if t != "퟿"], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert len(got) == len(TEXTS) - 1 and got[0] == [] and got[1] == [] and got[3] == [15496, 995]
    assert tokens.encode(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(df, "byte_bpe_50k").collect()} == {k: len(v) for k, v in got.items()}


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_within_capacity(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 7, 50, 512])
    hist = {rng.randint(1, cap): rng.randint(1, 300) for _ in range(rng.randint(0, 60))}
    runs, used = packing.plan_containers(hist, cap)
    load, seen = {}, {n: set() for n in hist}
    for n, a, b, first, each in runs:
        for r in range(a, b + 1):
            assert r not in seen[n]
            seen[n].add(r)
            c = first + (r - a) // each
            load[c] = load.get(c, 0) + n
    assert all(seen[n] == set(range(k)) for n, k in hist.items()) and all(v <= cap for v in load.values()) and set(load) == set(range(used))
    total = sum(n * k for n, k in hist.items())
    assert used <= 1.25 * -(-total // cap) + 1


def test_fill(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([5, 5, 5, 30, rng.randint(1, 99), 100, 250, 0]), "x") for i in range(3000)] + [(9001, None, "x"), (9002, 100, "x"), (9002, 100, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, piece_no string")
    placed = packing.fill_containers(df, 100).collect()
    load, items = {}, {}
    for r in placed:
        items.setdefault(r["doc_id"], []).append((r["piece_no"], r["piece_tokens"]))
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["piece_tokens"]
        else:
            assert r["piece_tokens"] == 0
    assert all(v <= 100 for v in load.values())
    for i, n, _ in rows[:3000]:
        assert sum(t for _, t in items[i]) == n and (len(items[i]) == 1 or n > 100) and sorted(p for p, _ in items[i]) == list(range(1, len(items[i]) + 1))
    assert len(items[9002]) == 2 and items[9001] == [(1, 0)]
    total = sum(n or 0 for _, n, _ in rows)
    assert len(load) <= 1.02 * -(-total // 100) + 1
    use = packing.container_use(packing.fill_containers(df, 100), 100).first()
    assert use["tokens"] == total and use["containers"] == len(load)
    assert packing.fill_containers(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(df, 0)


def test_specs(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    specs = spark.createDataFrame([(1, "w", 2), (2, "w", 9)], "spec_id int, tokenizer string, capacity_tokens int")
    size = lambda d, t: d.selectExpr("doc_id", "CAST(coalesce(size(split(text, ' ')), 0) AS INT) AS n_tokens").withColumnRenamed("n_tokens", "n_tokens")
    got = packing.fill_by_specs(docs, specs, size).collect()
    assert {(r["spec_id"], r["doc_id"]): 0 for r in got}.keys() == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert packing.fill_by_specs(docs, specs.limit(0), size).count() == 0
