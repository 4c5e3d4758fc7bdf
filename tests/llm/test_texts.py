"""The text problems: index against a naive search, operators on small corpora with known answers, and their edge cases."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import mixing, spam
from rankloom.llm import text as tx
from rankloom.llm.fmindex import FMIndex, WaveletMatrix
from rankloom.llm.leakage import Items, body, leaks, merge
from rankloom.llm.mixing import Mix

DOC = "doc_id long, text string, source string, d long, t string, s string, k int"


def docs(spark, texts, source=None):
    return spark.createDataFrame([(i, t, (source or {}).get(i, "web"), 1, "x", "y", 2) for i, t in enumerate(texts)], DOC)


# ---------------------------------------------------------------- index


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 5), min_size=3, max_size=3), min_size=1, max_size=6))
def test_backward_search_and_location(seq, phrases):
    seq = np.array([0, *seq])
    index = FMIndex(seq, 6, sample=4)
    p = np.array(phrases)
    which, pos = index.locate(*index.search(p))
    want = sorted((i, a) for i, ph in enumerate(phrases) for a in range(len(seq) - 2) if seq[a : a + 3].tolist() == ph)
    assert sorted(zip(which.tolist(), pos.tolist())) == want


@given(st.lists(st.integers(0, 20), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_wavelet_ranks(seq):
    s = np.array(seq)
    w = WaveletMatrix(s, 21)
    c = np.repeat(np.arange(21), len(s) + 1)
    i = np.tile(np.arange(len(s) + 1), 21)
    assert w.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i)]


# ---------------------------------------------------------------- leakage

INSTRUCTION = "Read the following note with great care and then answer the question that comes after it in one short sentence only."
PASSAGE = "Harbour master Ellingsen counted forty seven grey barges before noon, wrote their cargo of limestone and copper wire into a ledger bound in green leather, and sent the youngest clerk across the frozen square to warn the customs office."
QUESTION = "Which colour had the leather of the ledger that the harbour master used before noon?"
OTHER = "Gardener Petrosyan planted nineteen crooked pear trees behind the chapel, tied their stems with tarred rope from an abandoned trawler, and asked the deaf miller to keep his goats away until the spring floods had gone."
ITEMS = [(1, f"{INSTRUCTION}\n\n{PASSAGE}\n\n{QUESTION}"), (2, f"{INSTRUCTION}\n\n{OTHER}\n\nWho kept goats near the chapel?"), (3, None), (None, f"a\n\n{PASSAGE}")]
FILL = "The weather stayed mild for most of the week and nobody in the village thought of rain. "


def found(spark, texts):
    items = spark.createDataFrame(ITEMS, "item_id long, item_text string").withColumn("doc_id", F.lit(0))
    return sorted((r[0], r[1]) for r in leaks(docs(spark, texts), items, "doc_id", "text", "item_id", "item_text").select("doc_id", "item_id").collect())


def edited(t, step=7):
    w = t.split()
    return " ".join("really" if i % step == 3 else x for i, x in enumerate(w) if i % (2 * step) != 9)


def test_passages_are_found_however_they_are_written(spark):
    w = PASSAGE.split()
    texts = [
        FILL + PASSAGE + FILL,
        PASSAGE.upper(),
        "> " + PASSAGE.replace(", ", ",\n> "),
        PASSAGE.replace("o", "о").replace("e", "е"),  # Cyrillic
        "".join(c + ("​" if i % 3 == 0 else "") for i, c in enumerate(PASSAGE)),
        PASSAGE.replace("limestone", "lime-\nstone").replace("warn", "w-\n  arn"),
        "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>",
        edited(PASSAGE),
        " ".join(w[:22]) + " " + FILL * 2 + QUESTION,
        "| " + " | ".join(w) + " |",
        PASSAGE + " " + FILL + OTHER,
    ]
    assert found(spark, texts) == [(i, 1) for i in range(len(texts))] + [(10, 2)]


def test_what_is_no_leak(spark):
    w = PASSAGE.split()
    texts = [
        INSTRUCTION,
        FILL * 3,
        " ".join(w[:9]) + ". " + FILL,
        "Ellingsen, Petrosyan, the harbour master, the chapel, a ledger, the customs office.",
        " ".join(f"{a} {b}" for a, b in zip(w, FILL.split() * 9)),
        " ".join(random.Random(1).sample(w, len(w))),
        "",
        None,
        " \n ",
        "word " * 200_000,
    ]
    assert found(spark, texts) == []


def test_leaks_of_copies_spans_and_empty_tables(spark):
    d = docs(spark, [FILL + PASSAGE, FILL + PASSAGE]).union(docs(spark, [PASSAGE]).withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    got = leaks(d, items, "doc_id", "text", "item_id", "item_text").collect()
    n, m = len(tx.words([tx.plain(FILL)]).start), len(tx.words([tx.plain(PASSAGE)]).start)
    assert sorted((r["doc_id"], r["words"], [tuple(s) for s in r["spans"]]) for r in got) == [(i, len(PASSAGE.split()), [(n, n + m - 1)]) for i in (0, 1)]
    assert leaks(d.where("false"), items, "doc_id", "text", "item_id", "item_text").count() == 0
    assert leaks(d, items.where("false"), "doc_id", "text", "item_id", "item_text").count() == 0


def test_many_blocks_of_items_and_one_scan(spark):
    rng = random.Random(5)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    many = [(n, f"{INSTRUCTION}\n\n" + " ".join(letters() for _ in range(40))) for n in range(100, 150)]
    texts = [FILL + t.split("\n\n")[1] + FILL for _, t in many[::7]] + [PASSAGE]
    items = spark.createDataFrame(many + ITEMS[:2], "item_id long, item_text string")
    read = lambda **o: leaks(docs(spark, texts), items, "doc_id", "text", "item_id", "item_text", **o)
    whole, cut = read(), read(item_bytes=300)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(cut) and {(r[0], r[1]) for r in cut.select("doc_id", "item_id").collect()} == {(i, 100 + 7 * i) for i in range(8)} | {(8, 1)}
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_shared_turns_of_phrase_go_to_the_item_that_has_more_of_them(spark):
    turn = "Branch {} sorted {} names by size and branch {} by age, yet {} ended last under either of the two orders that week."
    a, b = turn.format("Norwood", 361, "Calder", "Moss"), turn.format("Easton", 766, "Torrance", "Reed")
    items = spark.createDataFrame([(1, f"x\n\n{a}\n\n{PASSAGE}"), (2, f"x\n\n{b}\n\n{OTHER}"), (3, f"x\n\n{OTHER}\n\n{b}")], "item_id long, item_text string")
    got = leaks(docs(spark, [FILL + a + FILL, FILL + b, a + " " + FILL * 2 + OTHER]), items, "doc_id", "text", "item_id", "item_text")
    # 2 and 3 have the same wording
    assert sorted((r[0], r[1]) for r in got.select("doc_id", "item_id").collect()) == [(0, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_very_long_text_and_helpers(spark):
    assert found(spark, [FILL * 30_000 + PASSAGE + FILL * 10]) == [(0, 1)]
    assert merge([(5, 9), (1, 3), (4, 4), (20, 30), (25, 27)]) == [(1, 9), (20, 30)]
    assert body("a\n\nb\n\nc") == "b\n\nc" and body("only") == "only"
    assert len(Items([], []).phrases) == 0


# ---------------------------------------------------------------- mixing

needs_files = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")


def mix(spark, n=3000, seed=1):
    rng = random.Random(seed)
    sources = {i: rng.choices(["big", " BIG", "mid-size", "Mid_Size ", "tiny", None, "unlisted"], [40, 10, 20, 10, 3, 2, 5])[0] for i in range(n)}
    d = docs(spark, [FILL * rng.randrange(1, 6) if i % 50 else rng.choice(["", None]) for i in range(n)], sources)
    t = spark.createDataFrame([("big", 0.4, 1), ("mid_size", 0.5, 3), ("tiny", 0.08, 2), ("absent", 0.02, 4)], "source string, target_share double, max_repeats int")
    return Mix(d, t), sources


@needs_files
def test_mix_reaches_shares_within_caps_and_keeps_the_size(spark):
    m, _ = mix(spark)
    r = {x["source"]: x for x in m.report().collect()}
    assert sum(x["tokens"] for x in r.values()) == pytest.approx(m.total, rel=0.01)
    tiny = r["tiny"]
    assert tiny["most_repeats"] == 2 and tiny["tokens"] == 2 * tiny["tokens_available"]  # cannot reach its share
    assert r["big"]["share"] / r["mid_size"]["share"] == pytest.approx(0.4 / 0.5, rel=0.02)
    assert r["absent"]["tokens"] == 0 and r["big"]["most_repeats"] <= 1 and r["mid_size"]["most_repeats"] <= 3


@needs_files
def test_mix_rows_agree_with_the_report_and_are_shuffled(spark):
    m, sources = mix(spark)
    rows = m.drawn().collect()
    r = {x["source"]: x for x in m.report().collect()}
    for s in ("big", "mid_size", "tiny"):
        mine = [x for x in rows if x["source"] == s]
        assert len(mine) == r[s]["used"] and len({(x["doc_id"], x["copy"]) for x in mine}) == len(mine)
    ids = [x["doc_id"] for x in rows]
    assert ids != sorted(ids) and {sources[i] for i in ids}.isdisjoint({None, "unlisted"})
    assert sorted((x["doc_id"], x["copy"]) for x in mix(spark)[0].drawn().collect()) == sorted((x["doc_id"], x["copy"]) for x in rows)


@needs_files
def test_token_sizes_are_the_tokenizers(spark):
    e = mixing._encoder(mixing.TOKENIZER)
    texts = ["Hello world", "", None, "déjà vu 12345\n\n  x", "<|endoftext|>", "a" * 50_000]
    got = sorted(r["n"] for r in mixing.sized(docs(spark, texts), "doc_id", "text", "source", 1, mixing.TOKENIZER).collect())
    assert got == sorted(len(e.encode_ordinary(t or "")) for t in texts)


@needs_files
def test_mix_of_empty_tables(spark):
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert Mix(docs(spark, []), t).drawn().count() == 0
    m = Mix(docs(spark, ["a b"]), t.where("false"))
    assert m.drawn().count() == 0 and m.report().count() == 0


def test_poisson_steps():
    assert mixing._steps(float("inf"), 3) == [0.0] * 3
    s = mixing._steps(1.3, 4)
    rng = np.random.default_rng(0)
    u = rng.random(200_000)
    assert sum((u >= p).mean() for p in s) == pytest.approx(np.minimum(rng.poisson(1.3, 200_000), 4).mean(), abs=0.01)


# ---------------------------------------------------------------- spam

PROSE = [
    "When the ferry left the harbour in the evening, the children on the pier waved until it was out of sight.",
    "It is not easy to say why the old mill was never sold, but the owner had his reasons and kept them to himself.",
    "After the storm we walked along the beach and looked for the boards that the sea had taken from the hut.",
    "She told me that the letters had been kept in a box under the stairs since the year of the flood.",
    "If you want to see the garden in spring, come before the first of May and ask for the key at the gate.",
    "They were surprised by how quickly the snow had covered the road between the village and the station.",
]


def page(i, n=10):
    rng = random.Random(i)
    return " ".join(rng.choice(PROSE) for _ in range(n))


HONEST = [
    "date,close,volume\n" + "\n".join(f"2020-01-{i:02d},{100 + i}.25,{i * 331}" for i in range(1, 29)),
    "\n".join(f"10:{i:02d} INFO build step_{i} rows={i * 17} took {i}s" for i in range(40)),
    "\n".join(f"def f_{i}(x):\n    y = x + {i}\n    return y * {i}" for i in range(15)),
    page(3) + "\nTags: garden, ferry, mill, letters",
    page(4) + "\n" + "\n".join(f"[{i}] Note {i}, http://a{i}.example/{i}" for i in range(4)),
    " ".join(f'<span class="n">{x}</span>' for x in page(5).split()),
]
STUFFED = [
    ", ".join(random.Random(1).choices(["cheap loans online", "fast credit card", "best bank offers"], k=60)),
    "\n".join(f"http://shop{i}.example/cheap-loans?id={i}" for i in range(30)),
    " ".join(random.Random(2).choices(["#cheaploans", "#CreditCard", "#BankOffers", "#fastcash"], k=60)),
    " ".join(["Looking for cheap loans? Our cheap loans are the cheap loans that every cheap loans buyer wants."] * 10),
    "<ul>" + "".join(f'<li><a href="//x{i}.example/{i}">cheap loans {i}</a></li>' for i in range(40)) + "</ul>",
    "\n".join(random.Random(3).choices(["Cheap Loans", "CHEAP-LOANS", "fast credit", "FAST CREDIT"], k=60)),
    PROSE[0] + "\n" + " ".join(random.Random(4).choices(["cheap loans online", "fast credit card", "best bank offers"], k=60)),
]


def test_spam_pages_and_honest_ones(spark):
    d = docs(spark, [page(i) for i in range(40)] + HONEST + STUFFED + STUFFED[:1])
    got = sorted(r[0] for r in spam.spam_pages(d, "doc_id", "text").collect())
    n = 40 + len(HONEST)
    assert got == list(range(n, n + len(STUFFED) + 1))


def test_spam_of_many_keywords(spark):
    words = [f"{a}{b}" for a in ("cheap", "best", "loan", "shoe", "watch", "phone", "hotel", "flight", "bag", "ring") for b in ("sale", "deal", "shop", "price", "store", "online", "offer", "buy", "free", "card", "kit", "box", "set", "pro", "max", "lite", "plus", "club", "zone", "land")]
    mixed = np.random.default_rng(0).permutation(np.repeat(words, 20)).tolist()
    stuffed = [" ".join(words * 20), ", ".join(mixed), "\n".join(" ".join(mixed[i : i + 10]) for i in range(0, len(mixed), 10))]
    long = "\n".join(page(i, 40) for i in range(20)) + "\n" + "\n".join(HONEST * 5)
    d = docs(spark, [page(i) for i in range(40)] + stuffed + [long])
    assert sorted(r[0] for r in spam.spam_pages(d, "doc_id", "text").collect()) == [40, 41, 42]


def test_spam_edge_cases(spark):
    d = docs(spark, [page(i) for i in range(20)] + ["", None, " \n\n ", "\x01\x02", "é" * 3, "cheap loans online " * 60_000])
    s = {r[0]: r["spam_share"] for r in spam.spam_scores(d, "doc_id", "text").collect()}
    assert len(s) == 26 and [round(s[20 + i], 3) for i in range(6)] == [0, 0, 0, 0, 0, 1]
    assert spam.spam_scores(docs(spark, []), "doc_id", "text").count() == 0
    assert spam.spam_scores(docs(spark, ["", None]), "doc_id", "text").count() == 2


def test_classes_of_words():
    t = spam.tokens(["The Cat sat_2 AT 14.5 http://a.example/x <b>now</b> #tag, café f(xy) a.b.co/x\n"])
    c = {spam.CODE: "code", spam.BREAK: "break", spam.END: "end", spam.COMMA: "comma", spam.SIGN: "sign", spam.LINK: "link", spam.TAG: "tag", spam.CONTENT: "lower", spam.CONTENT + 5: "title", spam.CONTENT + 10: "upper"}
    assert [c[int(k)] for k in t.kind] == "title title code upper code sign code link lower sign tag comma lower code sign code sign link break".split()
    s = spam.sequence(spam.tokens(["loan loan loan the AB 5 AB , ; xy x"]), spam.tokens(["the"]).code)
    assert [int(k) for k in s.kind] == [spam.CONTENT, spam.CONTENT + 1, spam.CONTENT + 2, spam.FIRST_WORD, spam.CODE, spam.CONTENT + 11, spam.COMMA, spam.CONTENT, spam.CODE]


def test_words_said_before():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 9, 500)
    got = spam._said_before(key.astype(np.uint64), 40)
    counts = [int((key[max(0, i - 40) : i] == key[i]).sum()) for i in range(500)]
    assert got.tolist() == counts
    assert spam._echoes(key.astype(np.uint64), 3, 40).tolist() == [c >= 3 for c in counts]
    assert spam._said_before(key.astype(np.uint64), 600).tolist() == [int((key[:i] == key[i]).sum()) for i in range(500)]


def test_perplexity_decides_alone():
    texts = [page(i) for i in range(40)]
    code, n = spam._spellings(texts)
    learned = np.sort(code[np.argsort(-n, kind="stable")][:60].view(np.uint64))
    s = spam.sequence(spam.tokens(texts), learned)
    use = spam._prose(s)
    c = spam.FIRST_WORD + len(learned)
    a, b, k = (x[use] for x in spam._triples(s))
    m = spam.Model(learned, *np.unique((a * c + b) * c + k, return_counts=True))
    share, loss = m.judge([page(99), *HONEST, *STUFFED, ""])
    assert share[: 1 + len(HONEST)].max() < 0.5 < share[1 + len(HONEST) : -1].min() and share[-1] == loss[-1] == 0
    assert spam.Model(learned, np.zeros(0, np.int64), np.zeros(0, np.int64)).judge(STUFFED)[0].max() == 0  # nothing to hold them against


def test_plain_writing():
    assert tx.plain("Ｆｕｌｌ－width ＡＢ１") == "full-width ab1"
    assert tx.plain("Ze­ro​ width &amp; café") == "zero width & cafe"
    assert tx.plain("<p>over<br>flow</p> ex-\n> ample") .split() == ["over", "flow", "example"]
    a, b = tx.words(["Alpha beta"]), tx.words(["x", "beta Alpha"])
    assert a.code[0] == b.code[2] and a.code[1] == b.code[1] and b.text.tolist() == [0, 1, 1]
