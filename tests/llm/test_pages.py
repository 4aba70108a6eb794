from evigraph.llm import pages, truncation

SCHEMA = "document_id string, url string, content string, acquisition_method string, extra int"
MENU = "Home\nNews\nZebra corner"


def site(n=12):
    """Pages of one host with a template of its own words, and pages of hosts seen once."""
    rows = []
    for i in range(n):
        body = f"Headline {chr(97 + i) * 5} of the day\nThe {i}th study of river number {i * 7} found a value of {i * 13} in the town.\n## Findings\nA second paragraph about item {i} closes the story here."
        rows.append((f"d{i:02d}", f"https://www.acme-post.example/{i}", f"{MENU}\n{body}\nMost read\n► How river {i} froze\n► Why {i} matters\nOdd footer of this house\nCopyright Acme Post 2024", "playwright", i))
    rows.append(("one", "https://single.test/a", "Home\nMenu\nA real sentence stands here, all alone.\n3 comments\n© 2020 Single Wire. All rights reserved.", "playwright", 0))
    return rows


def furniture(spark, rows):
    out = {}
    for r in pages.furniture_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["document_id"], set()).add(r["line_no"])
    return out


def test_template_lines_go_and_the_article_stays(spark):
    got = furniture(spark, site())
    # lines 1-3 menu (the third known by its recurrence alone), 8-12 teasers, footer and copyright
    assert all(got[f"d{i:02d}"] == {1, 2, 3, 8, 9, 10, 11, 12} for i in range(12))
    assert got["one"] == {1, 2, 4, 5}


def test_template_of_a_large_host_needs_no_share_of_it(spark):
    rows = []
    for i in range(300):  # a corner on 12 of 300 pages would be 4 %; it is on 8, a line of an article's edited copies on 4
        lines = [f"The report of station {chr(97 + i % 26)}{i} on the river was read in full by {i * 7} people."]
        rows.append((f"d{i:03d}", f"https://large.test/{i}", "\n".join((["Zebra corner"] if i < 8 else []) + lines + (["The station was built in stone."] if i >= 296 else [])), "playwright", i))
    got = furniture(spark, rows)
    assert got == {f"d{i:03d}": {1} for i in range(8)}


def test_repeats_nulls_and_empty_tables(spark):
    rows = site()
    extra = [rows[0], ("null", "https://x.test", None, None, None), ("blank", "https://x.test/b", " \n\t", None, None), (None, "https://x.test/c", "Home", None, None), ("local", "file:///a", "Home\nMenu", None, None), ("nourl", None, "Home", None, None)]
    got = furniture(spark, rows + extra)
    assert got["d00"] == {1, 2, 3, 8, 9, 10, 11, 12} and not {"null", "blank", "local", "nourl", None} & set(got)
    assert furniture(spark, []) == {}


def test_very_long_page(spark):
    text = "Home\n" + "\n".join(f"Line {i} of a very long article that goes on." for i in range(5000)) + "\n" + "x" * 300_000
    assert furniture(spark, [("d", "https://a.test/1", text, None, 0)]) == {"d": {1}}


RESIDUE = {
    "tpl": "Dear {{ name }}, thank you for reading {{ title }}.\n{{ title }}: {{ city }}", "filler": "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "error": "Error 404\nPage not found",
    "script": "JavaScript is disabled\nPlease enable JavaScript to continue.", "json": '{"status": 502, "message": "bad"}', "framed": "Home\nMenu\nAccess denied\n© 2024 X. All rights reserved.",
}
REAL = {
    "quote": "The style guide tells authors to write {{ title }} in double braces, and the build replaces it with the real heading. " * 3 + "Nothing else of the page is out of the ordinary, and the story goes on for quite a while.",
    "furn": "Some features of this page need JavaScript.\nA long and real article about the weather in the north, with many words of its own, follows the notice.", "short": "The vote was postponed.", "lorem": "Designers still use lorem ipsum in drafts, but the board banned it from print last June.",
}


def test_residue(spark):
    rows = [(k, "https://h.test/" + k, v, "tavily_extract", 0) for k, v in (RESIDUE | REAL).items()] + [("null", None, None, None, 0), ("blank", None, "  ", None, 0), ("tpl", "https://h.test/tpl", RESIDUE["tpl"], "x", 1)]
    got = sorted(r["document_id"] for r in pages.residue_records(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(RESIDUE)


def framed(lines, n, notice=""):
    """Pages of one host in a frame of over 1200 characters of its own words, with a long text each, and such a page with these lines."""
    frame = [f"Zebra corner of house {w} and all of its many friends in the wide valley of the upper river and its quiet side arms" for w in "abcdefghijklm"]
    own = lambda i: [f"The {w} part of report {chr(97 + i) * 3} was read by the council of the town, and every single member of it had a view on the matter at hand." for w in ("first", "second", "third", "fourth", "fifth")]
    page = lambda x: "\n".join([*frame, *([notice] if notice else []), *x])
    rows = [(f"real{i}", f"https://framed.test/{i}", page(own(i)), "playwright", i) for i in range(n)]
    return rows + [("error", "https://framed.test/x", page(lines), "playwright", 0)]


def test_evidence_is_measured_after_the_template_is_subtracted(spark):
    docs = framed(["Error 404", "Page could not be found"], 8)
    dump = "\n".join(["Traceback (most recent call last)", *(f"at render.page_{chr(97 + i % 26)} ({i}:23)" for i in range(70))])
    docs.append(("dump", "https://dump.test/1", dump, "playwright", 0))
    assert sorted(r["document_id"] for r in pages.residue_records(spark.createDataFrame(docs, SCHEMA)).collect()) == ["dump", "error"]


def test_notices_of_the_template_are_furniture_and_recurring_errors_are_not(spark):
    notice = "This corner needs JavaScript"
    docs = framed(["A short note of the day is all there is here."], 8, notice)
    errors = [(f"e{i}", f"https://errors.test/{i}", f"Error 404\nThe page {chr(97 + i) * 4} of the archive could not be found", "playwright", i) for i in range(8)]
    df = spark.createDataFrame(docs + errors, SCHEMA)
    assert sorted(r["document_id"] for r in pages.residue_records(df).collect()) == [f"e{i}" for i in range(8)]
    got = furniture(spark, docs + errors)
    assert all(14 in got[d] for d in ["error", *(f"real{i}" for i in range(8))])


def test_residue_has_no_furniture_rows(spark):
    rows = [(k, "https://h.test/" + k, v, "tavily_extract", 0) for k, v in RESIDUE.items()]
    assert furniture(spark, rows) == {}


def test_bodies_join_the_remaining_lines(spark):
    got = {r["document_id"]: r["body"] for r in pages.bodies(spark.createDataFrame(site(), SCHEMA)).collect()}
    assert got["one"] == "A real sentence stands here, all alone."


def test_truncation(spark):
    full = [f"The committee of town {i} reviewed the plan in the spring of {2000 + i % 20}." for i in range(400)]
    docs, triplets = [], []
    for i, s in enumerate(full):
        triplets.append((f"t{i:03d}", s, "https://src.test/1"))
    for i in range(20):  # a limit of 40 characters, and cuts in mid-transfer
        triplets.append((f"limit{i:02d}", (full[i] + " " + full[i + 1])[:40], "https://limit.test/1"))
        triplets.append((f"mid{i:02d}", full[i][: 25 + i], "https://src.test/2"))
    triplets += [("nomark", full[3][:-1], "https://src.test/3"), ("dots", "The committee of town 9 reviewed the…", "https://src.test/3"), ("quote", '"We waited, and then the season came back…"', "https://src.test/4"), ("null", None, "u"), ("blank", " ", "u"), ("t000", full[0], "https://src.test/1")]
    d = spark.createDataFrame(docs, SCHEMA)
    t = spark.createDataFrame(triplets, "triplet_id string, evidence string, source_url string")
    values = truncation.cut_values(truncation.text_values(d, t))
    got = {r["record_id"]: r["is_cut"] for r in values.collect()}
    assert all(got[f"limit{i:02d}"] for i in range(20)) and got["dots"]
    assert sum(got[f"mid{i:02d}"] for i in range(20)) >= 18
    assert not any(got[f"t{i:03d}"] for i in range(400)) and not got["nomark"] and not got["quote"] and not {"null", "blank"} & set(got)
    share = {(r["by"], r["source"]): r["cut_share"] for r in truncation.cut_share(values).collect()}
    assert share["host", "limit.test"] == 1.0
    routes = {r["record_id"]: r["route"] for r in values.collect()}
    assert {routes[f"limit{i:02d}"] for i in range(20)} == {"maximum"} and routes["mid05"] == "inside" and routes["t000"] is None
    empty = truncation.cut_values(truncation.text_values(d, t.limit(0)))
    assert empty.count() == 0


def test_evidence_that_ends_on_its_own_object_is_whole(spark):
    rows = [(f"t{i:03d}", f"Anna Berg advises loan storage under a {i}-month agreement signed in May {2000 + i % 20}.", "https://src.test/1", "Anna Berg", "loan storage") for i in range(200)]
    rows += [("whole", "Anna Berg advises loan storage", "https://src.test/2", "Anna Berg", " Loan Storage "), ("other", "Anna Berg advises loan storage under", "https://src.test/2", "Anna Berg", "loan storage"), ("null", "Anna Berg advises loan stor", "https://src.test/2", None, None)]
    t = spark.createDataFrame(rows, "triplet_id string, evidence string, source_url string, subject string, object string")
    got = {r["record_id"]: r["is_cut"] for r in truncation.cut_values(truncation.text_values(spark.createDataFrame([], SCHEMA), t)).collect()}
    assert not got["whole"] and got["other"] and got["null"] and not any(got[f"t{i:03d}"] for i in range(200))


def test_share_against_a_table_by_hand(spark):
    found = spark.createDataFrame([("triplet", "a", "h", None, "inside", True), ("triplet", "b", "h", None, None, False), ("triplet", "c", None, None, None, False), ("source_document", "d", "h", "m", "length", True)], "record_kind string, record_id string, host string, method string, route string, is_cut boolean")
    got = {(r["record_kind"], r["by"], r["source"]): (r["records"], r["cut_records"], r["cut_share"]) for r in truncation.cut_share(found).collect()}
    assert got == {("triplet", "host", "h"): (2, 1, 0.5), ("triplet", "host", None): (1, 0, 0.0), ("source_document", "host", "h"): (1, 1, 1.0), ("source_document", "method", "m"): (1, 1, 1.0)}


def test_template_lines_of_any_length_and_lines_of_items(spark):
    notice = "The zebra house keeps a small record of what you read here so that it can offer more of the same, " * 4
    names = ["Zebra", "Okapi", "Quagga", "Bongo"]
    rows = []
    for i in range(8):  # items in an order of its own on each page, once parted by capitals alone
        order = names[i % 4 :] + names[: i % 4]
        menu = " ".join(order) if i == 7 else " | ".join(order)
        rows.append((f"d{i}", f"https://items.test/{i}", f"{menu}\n{notice}\nThe report of station {chr(97 + i) * 3} was read in full by {i * 7} people.", "playwright", i))
    assert furniture(spark, rows) == {f"d{i}": {1, 2} for i in range(8)}


def test_filler_needs_no_word_list_and_long_texts_with_a_weak_word_stay(spark):
    words = "vorem ultras ipsor elitu velum donec sedula quisma fermi".split()
    filler = "\n".join(" ".join(words[(i * 3 + j) % 9] for j in range(12)).capitalize() + "." for i in range(6))
    same = "\n".join(["Some body of the page will be put here by the desk."] * 4)
    real = "The court asked for more time. " + "The town council read the plan of the new bridge over the river in full. " * 12
    rows = [("filler", "https://f.test/1", filler, "x", 0), ("same", "https://f.test/2", same, "x", 0), ("real", "https://f.test/3", real, "x", 0)]
    assert sorted(r["document_id"] for r in pages.residue_records(spark.createDataFrame(rows, SCHEMA)).collect()) == ["filler", "same"]


def test_sentence_ends_are_counted_over_all_values(spark):
    values = spark.range(25_000).selectExpr("'triplet' AS record_kind", "cast(id AS string) AS record_id", "'grid fails' AS text")
    words, total, rates = truncation.fit_endings(values)
    assert total == 50_000 and words == {"grid": 25_000, "fails": 25_000} and rates


def test_contexts_counted_in_blocks_are_those_that_are_looked_up():
    import pandas as pd

    words = {"the": 900, "grid": 9, "fails": 9}
    model, texts = truncation.Endings(words, 1000), ["The grid fails. the grid\n the Grid of 12 fails.\nthe end", "", "grid"]
    frames = list(truncation._context_counts(words, 1000)([pd.DataFrame({"text": texts})]))
    got = {(r.size_, r.key): (r.n, r.ends) for f in frames for r in f.rename(columns={"size": "size_"}).itertuples()}
    want = {}
    for text in texts:
        lines = text.split("\n")
        for at, line in enumerate(lines):
            tokens = truncation.TOKEN.findall(line)
            for i in range(1, len(tokens) + 1):
                if i < len(tokens) or not (at == len(lines) - 1 or tokens[-1] in truncation.ENDS):
                    for k in model.contexts(model.forms(tokens), i):
                        n, e = want.get(k, (0, 0))
                        want[k] = n + 1, e + (i == len(tokens) or tokens[i] in truncation.ENDS)
    assert got == want


def test_contexts_of_many_texts_leave_a_task_once():
    import pandas as pd

    run = truncation._context_counts({"grid": 9}, 1000)
    frames = list(run([pd.DataFrame({"text": ["The grid fails here.\nthe grid"] * 1200})] * 2))
    keys = [k for f in frames for k in f["key"]]
    assert len(keys) == len(set(keys)) and not any(n % 2400 for f in frames for n in f["n"])


def test_ends_of_long_texts_are_those_of_whole_searches():
    import random

    rng = random.Random(8)
    ends = ["...", "…", "[truncated]", "[+12 chars]", "[+" + "7" * 300 + " chars]", "<conn reset by peer", "Read more", "(more)", ".", '."', "”", "?\n", ":-)", ". \U0001f600\ufe0f", ". :)" * 90, "\"" * 300, ".\"" + ")" * 300, "```", "word", " ", "\n\n", "[…]", "." * 300]
    for _ in range(3000):
        text = ("a b. " * rng.choice((0, 3, 80)) + rng.choice(("x", "", " " * 200, "foo.\n")) + "".join(rng.choice(ends) for _ in range(rng.randint(0, 3)))).rstrip()
        m = truncation.MARK.search(text)
        assert truncation._marked(text) == (m.start() if m else None), text
        assert truncation._is_closed(text) == bool(truncation.CLOSED.search(text)), text


def test_lines_that_recur_are_read_once_for_each_site(monkeypatch):
    calls, read = [], pages._line
    monkeypatch.setattr(pages, "_line", lambda words, raw, *of: calls.append((raw, *of)) or read(words, raw, *of))
    words, text = pages._Words(), "Home | News | Zebra 12\nThe report of zebra was read in full.\n" * 2 + "x" * 400
    made = [pages._page(words, text, host, web, site) for host, web, site in (("zebra.test", True, "zebra"), ("okapi.test", True, "okapi"), (None, True, ""), ("zebra.test", False, "zebra")) * 2]
    assert len(calls) == len(set(calls)) + 4 == 16  # only the long line is read again
    assert made[:4] == made[4:] and made == [pages._page(pages._Words(), text, h, w, s) for h, w, s in (("zebra.test", True, "zebra"), ("okapi.test", True, "okapi"), (None, True, ""), ("zebra.test", False, "zebra")) * 2]
    assert made[0][2][0] != made[1][2][0] and made[2][2] == [None] * 5
