"""Each operator against a plain answer, and on the odd cases its module defines."""

import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from sparkloom.llm import chat_format as chat
from sparkloom.llm import decontamination, fingerprints, language_id, mixing, ngram_jaccard, substring_dedup, token_counts, toxicity
from sparkloom.llm._graph import components
from sparkloom.llm.lm_scoring import lm_scores

tokenizers = pytest.importorskip("public_tokenizers")
BPE = tokenizers.path("byte_bpe_50k.json")
TABLES = os.environ.get("TEST_LARGE_DIR", "/root/testdata/sf0.1")


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def same_rows(got, want):
    """Equal rows, values and all, in any order."""
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


# 1 language id


def test_language_id(spark):
    r = random.Random(1)
    syllables = {"en": ["the", "ing", "ou", "er"], "de": ["sch", "ung", "ä", "ei"], "fr": ["eau", "é", "que", "ois"]}
    rows = []
    for i in range(300):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(r.randint(5, 40))), lang))
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (1003, "the ou", None), (None, "the ing ou", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.language_id(docs, max_train_docs=50).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held and sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "en" and not got[None]["held_out"] and len(got) == len(rows)
    assert all(0 <= x["score"] <= 1 for x in got.values())


@pytest.mark.parametrize("size", [400, 12])
def test_language_id_against_plain_ranks(spark, size):
    """Every prediction and score, with ties between n-grams and between languages."""
    r = random.Random(7)
    alphabet = {"en": "theaoin", "de": "derungsch", "xx": "abcé", "zz": "abcé"}
    rows = [(i, "".join(r.choice([*alphabet[lang], " ", "-", "1"]) for _ in range(r.randint(0, 60))), lang) for i, lang in enumerate(r.choices(list(alphabet), k=150))]
    rows += [(200, "ab ab", "xx"), (201, "ΑΣ ΑΣ. ΣΑ", None), (202, "İstanbul Straße", "en"), (203, None, "de"), (204, "the ", "de"), (205, "老人 the", None)]
    # the same texts for both, so that their profiles tie
    rows += [(300 + i, f"c{i} ab", lang) for i in range(8) for lang in ("xx", "zz")]
    made = spark.createDataFrame([(*x, "own", 1.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = sorted(tuple(x) for x in language_id.language_id(made, size=size).collect())
    held = {x[0]: x[1] for x in got}
    labelled = [(t, lang) for i, t, lang in rows if lang and not held[i]]
    want = brute.rank_order([t for _, t, _ in rows], labelled, size)
    want = sorted((i, held[i], lang, score) for (i, *_), (lang, score) in zip(rows, want, strict=True))
    assert [(*g[:3], round(g[3], 9)) for g in got] == [(*w[:3], round(w[3], 9)) for w in want]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    for text in ("The öld  man's 12 dogs_and cats, Ünd so weiter! " * 40 + "x" * 300 + " end²of it", "y" * 900, "1 " * 400, "ab" * 200 + "ΣΑΣ", ""):
        whole = language_id.grams(text)
        for piece in (1, 2, 3, 170):
            monkeypatch.setattr(language_id, "_PIECE", piece)
            pieces = language_id.grams(text)
            assert all(len(a) == len(b) and (a == b).all() for a, b in zip(whole, pieces, strict=True))
        monkeypatch.undo()


def test_language_id_bounds_its_languages(docs):
    with pytest.raises(ValueError, match="more than 1 languages"):
        language_id.language_id(docs, max_languages=1)


def test_language_id_without_anything_to_learn(docs, none):
    assert {x["lang_pred"] for x in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(none).count() == 0


# 2 language model scores


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(docs, rows, order):
    got = by_id(lm_scores(docs, order=order, slice_bytes=1500), "n_words", "log_score", "n_top", "mean_log_score")
    for i, (n, score, top) in brute.lm([(r[0], r[1]) for r in rows], order).items():
        assert got[i][0] == n and math.isclose(got[i][1], score, abs_tol=1e-6) and (order == 1 or got[i][2] == top)
        assert (got[i][3] is None) == (n == 0)


def test_lm_scores_of_a_very_long_text_and_repeated_rows(spark):
    words = [f"w{i * 7919 % 40_009}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[500:560])), (3, "a b c"), (3, "a b c"), (None, "a b d"), (None, "a b d"), (4, "")]
    got = lm_scores(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, slice int, row string")).collect()
    assert [r["top_share"] for r in got if r["doc_id"] == 2] == [58 / 60] and [r["n_top"] for r in got if r["doc_id"] == 1] == [116]
    # equal rows are one document, so the third word of each is in no other
    assert {(r["n_words"], r["n_top"]) for r in got if r["doc_id"] in (3, None)} == {(3, 0)} and len(got) == 7
    assert [r["mean_log_score"] for r in got if r["doc_id"] == 4] == [None]


def test_lm_scores_odd(odd, none):
    assert lm_scores(odd).count() == 5 and lm_scores(none).count() == 0


# 3 mixing


def sources_of(sizes):
    return [(f"{s}{i}", s, " ".join(["w"] * (1 + i % 7))) for s, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("repeats", [1.0, 1.7, 3.0, 50.0])
def test_mixing_keeps_to_quotas(spark, repeats):
    rows = sources_of({"a": 400, "b": 90, "c": 10})
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(3)
    drawn = mixing.mix(docs, max_repeats=repeats, small=5).toPandas()
    size = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in "abc"}
    _, shares, total = mixing.solve(size, None, repeats, None)
    for s in "abc":
        own = drawn[drawn.source == s]
        quota = shares[s] * total
        assert quota - 7 < own.mix_tokens.sum() <= quota + 1e-3
        assert quota <= repeats * size[s] + 1e-3 and quota >= size[s] - 1e-3
        last = own.mix_epoch.max()
        for epoch, part in own.groupby("mix_epoch"):
            assert part.doc_id.is_unique
            if epoch < last:
                assert part.mix_tokens.sum() == size[s]
    assert set(drawn.doc_id) == {r[0] for r in rows}


def test_mixing_cut_follows_the_permutation(spark):
    """The last epoch is a prefix of the rows in the order of their keys."""
    rows = sources_of({"a": 300})
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    for budget in (0, 1, 100, 555, 1199, 1200):
        drawn = {r["doc_id"] for r in mixing.mix(docs, max_repeats=None, budget=budget, small=4).filter("mix_epoch = 0").collect()}
        left, want = budget, set()
        for key, n, i in sorted((hashlib.md5(f"17:0:{i}".encode()).hexdigest(), len(t.split()), i) for i, _, t in rows):
            if n > left:
                break
            left, _ = left - n, want.add(i)
        assert drawn == want


def test_mixing_meets_an_entropy():
    size = {"a": 1000, "b": 100, "c": 10}
    exponent, shares, _ = mixing.solve(size, 1000, None, 0.8)
    assert 0 < exponent < 1 and math.isclose(mixing.entropy(shares), 0.8 * math.log(3), rel_tol=1e-6)
    assert mixing.solve(size, 1000, None, 1.0)[0] <= 1e-9 and mixing.solve({}, None, 2.0, None)[2] == 0


def test_mixing_of_many_sources(spark):
    """As many as are allowed by default: no part of the plan grows with them."""
    rows = [(i, f"s{i % 9_999}" if i % 10_000 else None, " ".join(["w"] * (1 + i * 7919 % 23))) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    drawn = mixing.mix(docs, max_repeats=2.0)
    got = {r["source"]: r for r in drawn.groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.first("mix_weight").alias("w")).collect()}
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(t.split())
    _, shares, total = mixing.solve(size, None, 2.0, None)
    assert set(got) == set(size) and None in got
    assert all(math.isclose(got[s]["w"], shares[s]) and shares[s] * total - 24 < got[s]["n"] <= shares[s] * total + 1e-3 for s in size)


def test_mixing_keeps_the_values_of_all_columns(odd):
    got = mixing.mix(odd, max_repeats=1.0)
    same_rows(got.select(*odd.columns), odd)


def test_mixing_tells_rows_without_an_id_apart(spark):
    """In a partial epoch some of them are drawn, as of rows with ids."""
    rows = [(None if i % 2 else i, f"text {i} of some words", "small" if i < 40 else "large") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_repeats=None, budget=1500).collect()
    drawn = [x["text"] for x in got if x["source"] == "large"]
    unnamed = [x for x in got if x["doc_id"] is None]
    assert len({(x["mix_epoch"], x["mix_key"]) for x in unnamed}) == len(unnamed) > 50
    assert 0.3 < sum(x["doc_id"] is None for x in got if x["source"] == "large") / len(drawn) < 0.7


def test_of_rows_that_share_an_id_always_the_same_stays(spark):
    rows = [(1, "one text of five words", "a"), (1, "another text of five words", "b"), (1, "another text of five words", "a"), (2, "x", None), (None, "y", None), (None, "y", None)]
    kept = set()
    for parts in (1, 2, 5):
        for turn in (rows, rows[::-1]):
            docs = spark.createDataFrame(turn, "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), F.col("source"))).repartition(parts)
            kept.add(tuple(sorted(repr(r[:3]) for r in ngram_jaccard.one_of_each(docs).collect())))
    assert len(kept) == 1 and len(kept.pop()) == 4


def test_mixing_odd(odd, none):
    got = mixing.mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() >= 5
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError, match="more than 1 sources"):
        mixing.mix(odd, most_sources=1)


# 4 token counts


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    r = random.Random(5)
    pool = ["<|endoftext|>", " ", "  ", "\n", "'s", "'LL", "\u2003", "é", "日本", "😀", "12", "²", "_", "-", "\x1c", "\x85", "a", "\x00", "ǅ", "x<|endo", "\r\n", "ɐ", "The", "zzzq"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 14))) for _ in range(3000)] + [x[1] for x in rows] + ["word " * 3000]
    df = spark.createDataFrame([(i, x, -1, "x") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens long, n_bytes string")
    got = by_id(token_counts.token_counts(df, BPE), "n_bytes", "n_tokens", "over_limit")
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i] == (len((x or "").encode()), n, n > 1024), repr(x)


def test_token_counts_of_every_script():
    """Any code points at all, in the library's own version of Unicode."""
    from tokenizers import Tokenizer

    t, counter, r = Tokenizer.from_file(BPE), token_counts.Counter(token_counts.prove(BPE)), random.Random(8)
    areas = [(0x20, 0x7F), (0x80, 0x250), (0x250, 0x590), (0x590, 0x900), (0x900, 0x1100), (0x1100, 0x2000), (0x2000, 0x3000), (0x3000, 0xA000), (0xA000, 0xD800), (0xE000, 0x10000), (0x10000, 0x20000), (0x20000, 0x110000)]
    for _ in range(4000):
        text = "".join(r.choice([" ", "'s", "\n", "a", "1"]) if r.random() < 0.3 else chr(r.randrange(*r.choice(areas))) for _ in range(r.randint(1, 12)))
        assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_the_shortcut_is_taken_for_every_script():
    """A second text of the same words merges nothing, and words of the vocabulary never do."""
    counter = token_counts.Counter(token_counts.prove(BPE))
    assert counter.count("the man said that “the man” was here — and … there") and counter.counts.merges <= 2
    for text in ("“quoted” – it’s the man’s", "старик и море, старик и море", "老人与海 老人与海", "😀 the 😀 man", "café naïve"):
        counter.count(text)
        before = counter.counts.merges
        counter.count(text)
        assert counter.counts.merges == before
    small = token_counts.Counter(token_counts.prove(BPE), room=500)
    for i in range(200):
        small.count(f"zq{i}xv")
    assert small.counts.room >= 0 and len(small.counts) < len(counter.counts) + 10


def test_whole_tokens_are_proven():
    counter = token_counts.Counter(token_counts.prove(BPE))
    assert len(counter.counts) > 49_000 and all(counter.tokenizer.encode(p).ids.__len__() == 1 for p in random.Random(2).sample(sorted(counter.counts), 300) if not p.startswith("<|"))


def test_other_tokenizers_go_through_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "Some words, and some more"), (2, None)], "doc_id long, text string")
    n = len(Tokenizer.from_file(path).encode("Some words, and some more", add_special_tokens=False).ids)
    assert by_id(token_counts.token_counts(df, path), "n_tokens") == {1: (n,), 2: (0,)}


def test_token_counts_odd(odd, none):
    assert token_counts.token_counts(odd, BPE).count() == 5 and token_counts.token_counts(none, BPE).count() == 0


# 5 chat formatting

MARKS = ["\\", "<", "#", " ", "</turn>", " </turn>\n", "### User: ", ":", "\n", "a", "<image:0>", "\\<image:1>", "é", "😀"]


def test_chat_round_trip():
    r = random.Random(1)
    for _ in range(3000):
        turns = []
        for _ in range(r.randint(0, 4)):
            parts = []
            for _ in range(r.randint(0, 3)):
                kind = r.choice(["text", "image", "audio", "document"])
                part = chat.Part(kind, "".join(r.choices(MARKS, k=r.randint(1, 6)))) if kind == "text" else chat.Part(kind, reference=r.choice(MARKS), tokens=3)
                if parts and parts[-1].kind == part.kind == "text":
                    part = chat.Part("text", parts.pop().text + part.text)
                parts.append(part)
            turns.append((r.choice(["user", "assistant", "User", "", ":x\n", "\\a", "ASSISTANT", "Über", "a b", "<"]), parts or [chat.Part("text")]))
        f = chat.format_conversation(turns)
        assert chat.read_back(f) == turns
        assert chat.loss_text(f) == "".join(p.text for role, ps in turns if role == "assistant" for p in ps if p.kind == "text")


def test_chat_attachments(spark):
    f = chat.format_conversation([("user", [chat.Part("text", "see "), chat.Part("image", reference="u://1"), chat.Part("audio", reference="u://2", tokens=7)])])
    assert f.text == "### User: see <image:0><audio:1> </turn>\n" and f.attachments == [("image", "u://1", 256), ("audio", "u://2", 7)]
    rows = [(1, 0, "user", None, [("text", "hi ", None, None), ("image", None, "u://1", 5)]), (1, 1, "assistant", "ok", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts array<struct<kind:string,text:string,reference:string,tokens:long>>")
    got = chat.chat_format(df, parts_col="parts").first()
    assert got["formatted"] == "### User: hi <image:0> </turn>\n### Assistant: ok </turn>\n" and got["tokens_expanded"] == 5 and got["attachments"][0]["reference"] == "u://1"


def test_chat_digest(spark):
    forged = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", forged), (-7, 1, "assistant", forged), (5, 2, "assistant", None), (5, None, None, "x"), (None, 1, "user", "y"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.chat_format(df)).collect()}
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(forged) and got[-7]["loss_sha256"] == brute.sha(forged)
    assert got[-7]["turns_sha256"] == brute.sha(f"user\n{forged}\nassistant\n{forged}\n")
    assert got[5]["turns_sha256"] == brute.sha("\nx\nassistant\n\n") and got[None]["n_turns"] == 2
    assert chat.digest(chat.chat_format(df.limit(0))).count() == 0


def test_chat_of_very_long_texts_and_clashing_columns(spark):
    long = "a <b> # " * 100_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, "f", "t") for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns string")
    got = {r["conv_id"]: r for r in chat.digest(chat.chat_format(df)).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == brute.sha(long) and got[1]["n_turns"] == 2
    # repeated rows are turns of their own, ties in one order
    assert got[2]["n_turns"] == 3 and got[2]["loss_sha256"] == brute.sha("xx") and got[2]["turns_sha256"] == brute.sha("\n\nassistant\nx\nassistant\nx\n")


# 6 decontamination


def test_contamination(spark, docs, rows):
    words = (rows[-2][1] or "").split()
    items = [(1, " ".join(words[:12])), (2, " ".join(words[20:24])), (3, None), (4, ""), (5, "nothing like it at all in any of them"), (10, " ".join(words[5:30])), (None, " ".join(words)), (2, rows[0][1]), (7, "X")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = brute.contamination([(r[0], r[1]) for r in rows], [i for i in items if i[0] is not None])
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    for block in (8 << 20, 60):
        assert by_id(decontamination.digest(decontamination.contamination(docs, bench, block_bytes=block)), *columns) == want
    left = decontamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, v in want.items() if not v[4]}


def test_contamination_in_several_passes(spark, docs, rows):
    """As if the benchmark were too large for the workers: the answers of all passes are joined."""
    words = (rows[-2][1] or "").split()
    items = [(k, " ".join(words[k : k + 11])) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench, block_bytes=100, pass_bytes=200)
    assert by_id(decontamination.digest(got), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination([(r[0], r[1]) for r in rows], items)
    whole = decontamination.contamination(docs, bench)
    assert by_id(got, "longest") == by_id(whole, "longest")


def test_contamination_by_a_passage_of_many_items_and_places(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    items = [(k, f"{passage} question{k} " + " ".join(f"q{k}x{j}" for j in range(12))) for k in range(400)]
    texts = [(i, f"{passage} own{i} " * 20) for i in range(60)] + [(1000, f"question7 {items[7][1]}"), (1001, "x " * 300_000 + items[3][1])]
    got = by_id(decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "items", "longest")
    assert all(len(got[i][0]) == 400 and got[i][1] == 40 for i in range(60)) and got[1000][1] == 53 == got[1001][1]


def test_longest_match(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["x", *words[3:40], "y"]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = decontamination.contamination(docs, bench).first()
    assert got["longest"] == 37 and [tuple(s) for s in got["spans"]] == [(1, 38)]


def test_longest_match_below_a_window(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(["x", *words[3:12], "y", *words[5:7]]), " ".join(["x", words[29], "w0"]), "none of it", None, " ".join(words[2:13]), " ".join(words[21:30])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (10, "w5 w6 w5 w6 " * 6)], "item_id long, text string")
    for block in (8 << 20, 60):
        assert by_id(decontamination.contamination(docs, bench, block_bytes=block), "longest") == {0: (9,), 1: (1,), 2: (0,), 3: (0,), 4: (11,), 5: (9,)}


def test_contamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(40)))], "item_id long, text string")
    assert decontamination.digest(decontamination.contamination(odd, bench)).filter("contaminated").count() == 4
    left = decontamination.decontaminated(odd, bench)
    same_rows(left, odd.filter("doc_id = 2"))
    assert decontamination.contamination(none, bench).count() == 0 and decontamination.contamination(odd, bench.limit(0)).filter("size(spans) > 0").count() == 0


# 7 n-gram Jaccard join


@pytest.mark.parametrize("options", [{}, {"dense": 3, "rows": 4}, {"sample": 1, "least": 2, "slice_bytes": 2000}, {"dense": 2, "rows": 2, "sample": 1, "most": 50}])
def test_ngram_jaccard(docs, rows, options):
    want = brute.components([(r[0], r[1]) for r in rows])
    assert len({v[1] for v in want.values()}) < len(want)
    assert by_id(ngram_jaccard.ngram_jaccard(docs, **options), "n_shingles", "component_id", "n_links") == want


def test_one_of_each_keeps_the_values_of_all_columns(odd):
    same_rows(ngram_jaccard.one_of_each(odd), odd.dropDuplicates().filter("doc_id IS NULL OR doc_id < 3"))  # 3 is a near copy of 1


def test_ngram_jaccard_of_a_very_long_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:60_000], "x", *words[60_000:]])), (3, " ".join(words[:80_000])), (4, "w1 w2")]
    got = by_id(ngram_jaccard.ngram_jaccard(spark.createDataFrame(texts, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == {1: (119_996, 1), 2: (119_997, 1), 3: (79_996, 3), 4: (1, 4)}


def test_ngram_jaccard_ties_no_texts_by_shared_passages(spark):
    """Common passages make dense columns; below a tenth of a set they tie nothing together."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    texts = [(i, " ".join([f"u{i}-{k}" for k in range(100)] + passage)) for i in range(40)] + [(100 + i, f"{i} " + " ".join(passage * 3)) for i in range(9)]
    made = spark.createDataFrame(texts, "doc_id long, text string")
    blocks, last = 4, spark.sparkContext.broadcast(np.empty(0, np.uint64))
    posted = ngram_jaccard.prefixes(made, "text", 5, 80, blocks, last)
    tied = ngram_jaccard.candidates(posted, 80, 3)
    nodes = {x for t in tied.collect() for x in (t["u"], t["v"])}
    assert len(nodes) == 9
    assert by_id(ngram_jaccard.ngram_jaccard(made, dense=3), "n_shingles", "component_id", "n_links") == brute.components(texts)


def test_ngram_jaccard_exchanges_in_proportion(spark):
    r = random.Random(2)
    texts = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(100))) for i in range(1200)]
    counts = []
    for n in (300, 600, 1200):
        last = spark.sparkContext.broadcast(np.empty(0, np.uint64))
        counts.append(ngram_jaccard.prefixes(spark.createDataFrame(texts[:n], "doc_id long, text string"), "text", 5, 80, n // 10, last).count())
    assert counts[1] <= 2.05 * counts[0] and counts[2] <= 2.05 * counts[1]


def test_ngram_jaccard_deals_even_blocks_each_to_a_task_of_its_own(spark):
    r = random.Random(2)
    made = spark.createDataFrame([(" ".join(f"w{r.randrange(3000)}" for _ in range(100)),) for _ in range(300)], "text string")
    posted = ngram_jaccard.prefixes(made, "text", 5, 80, 16, spark.sparkContext.broadcast(np.empty(0, np.uint64)))
    at = posted.groupBy("block", F.spark_partition_id().alias("task")).count().collect()
    assert len(at) == len({x["block"] for x in at}) == len({x["task"] for x in at}) == 16
    assert max(x["count"] for x in at) < 1.3 * min(x["count"] for x in at)


def test_ngram_jaccard_sends_texts_in_small_batches(spark, monkeypatch):
    """In each job with Python; afterwards the session has its own limit again."""
    name, seen, saved = "spark.sql.execution.arrow.maxBytesPerBatch", [], ngram_jaccard.saved
    before = spark.conf.get(name)
    monkeypatch.setattr(ngram_jaccard, "saved", lambda df: (seen.append((spark.conf.get(name), "InArrow" in df._jdf.queryExecution().toString())), saved(df))[1])
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 2000) AS text").coalesce(1)
    assert ngram_jaccard.ngram_jaccard(docs).count() == 4000
    assert sum(python for _, python in seen) >= 4 and {limit for limit, python in seen if python} == {str(4 << 20)}
    assert spark.conf.get(name) == before

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    with ngram_jaccard.X.batch_bytes(spark, 4 << 20):
        assert docs.mapInArrow(rows, "size long").agg(F.max("size")).first()[0] < 5 << 20


def test_ngram_jaccard_makes_few_pairs_at_a_time():
    """300 columns of 64 classes: 604,800 pairs, which took 24 MB in steps of 500,000."""
    import tracemalloc

    column, cls = np.repeat(np.arange(300), 64), np.tile(np.arange(64), 300)
    table = pa.table({"hash": column, "cls": cls, "n": np.full(len(cls), 100, np.int32)})
    tracemalloc.start()
    got = ngram_jaccard._product(80, 64)((0,), table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 2016 and set(got["shared"].to_pylist()) == {300} and most < 20 << 20


def test_ngram_jaccard_odd(odd, none):
    got = ngram_jaccard.ngram_jaccard(odd).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["1", "1", "1", "2", "None"]
    kept = ngram_jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]
    assert ngram_jaccard.ngram_jaccard(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i + 1, i) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and got[60] == 0 and got[102] == 100


# 8 toxicity


def test_toxicity_models_are_distributions(spark):
    """Both columns, word by word, against plain counting; each sums to 1 over words and places for other words."""
    r = random.Random(6)
    stems = ["abcdefghi", "abcdxy", "qrst", "bomente", "zz"]
    word = lambda: r.choice(stems) + "".join(r.choices("abc", k=r.randint(0, 3)))
    texts = [(" ".join(word() for _ in range(r.randint(0, 9))).title(), int(r.random() < 0.4)) for _ in range(60)]
    texts += texts[:5]
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    own = [(t, c) for t, c in set(texts)]
    counted = {}
    for t, c in own:
        for w in set(brute.ALNUM.findall(brute.lower(t))):
            counted.setdefault(w, [0, 0])[c] += 1
    words = spark.createDataFrame([(w, *n) for w, n in counted.items()], "name string, n0 long, n1 long")
    model = toxicity.estimate(words, 0.75, 2, 1.0, 2)
    p, leaf_of, leaves = brute.toxicity_model(texts, 0.75, 2, 1.0, 2)
    for c in (0, 1):
        assert math.isclose(sum(p(leaf, c) for leaf in leaves), 1)
    ask = [w for w in counted] + ["abcdefghiqq", "abcdxyqqqq", "qrstu", "never", "bomentezz", "zz"]
    got = model.differences(pa.array(ask), np.arange(len(ask) + 1))
    assert all(math.isclose(x, math.log(p(leaf_of(w), 1) / p(leaf_of(w), 0)), abs_tol=1e-9) for x, w in zip(got, ask, strict=True))
    sample = spark.createDataFrame([(c, t) for t, c in own], "toxic int, text string").repartition(3)
    pairs = sample.mapInArrow(toxicity.count_pairs, toxicity.PAIRS).groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model = toxicity.with_pairs(model, words, pairs, 0.75, 2)
    assert len(model.pairs.keys) >= 5
    after = brute.toxicity_pairs(texts, p, leaf_of, 0.75, 2)
    for v in [*list(counted)[:6], "never"]:
        for c in (0, 1):  # all words that were seen, and the places for others, which no pair ends in
            assert math.isclose(sum(after(w, c, v) for w in counted) + sum(p(x, c) for x in leaves if x not in counted) * (1 - _taken(model, v, c)), 1)
    for (_, t), f in zip(rows, model.features(pa.array([t for _, t in rows])), strict=True):
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(f, brute.toxicity_features(t, after), strict=True))


def _taken(model, word, c):
    return model.after.find(toxicity._hashed(pa.array([word])))[0, c]


def test_toxicity_of_ordinary_words_in_a_toxic_order(spark):
    """A phrase whose words are all as frequent in ordinary texts is told by its pairs."""
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 5))) for _ in range(60)]
    rows, labels = [], []
    for i in range(1200):
        toxic, w = int(r.random() < 0.3), r.choices(vocabulary, k=60)
        for _ in range(3):  # in either class the two words, but next to one another in one of them only
            w[r.randrange(0, 58)] = "black"
            w[r.randrange(0, 58)] = "sheep"
        if toxic:
            for _ in range(3):
                at = r.randrange(0, 58)
                w[at : at + 2] = ["black", "sheep"]
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    right = lambda found: sum(x["predicted"] == truth[x["doc_id"]] for x in found) / len(found)
    with_pairs = toxicity.toxicity(docs, told).filter("held_out").collect()
    without = toxicity.toxicity(docs, told, least_pair=10**6).filter("held_out").collect()
    assert right(with_pairs) > 0.8 and right(with_pairs) > right(without) + 0.1


def test_toxicity(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(1, 5))) for _ in range(900)]
    bad = ["nasty", "vile", "foul"]
    rows, labels = [], []
    for i in range(1500):
        toxic, w = int(r.random() < 0.2), r.choices(vocabulary, k=r.randint(20, 200))
        for _ in range(3 * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    labels += [(0, 1 - labels[0][1]), (1, None), (None, 1)]
    rows += [(5000, None), (5001, ""), (None, "vile foul nasty"), (5002, "?! \n"), (5003, "quiet " * 200_000 + "vile foul nasty " * 4)]
    docs = spark.createDataFrame([(*x, "s", 1.0, "n") for x in rows], "doc_id long, text string, score string, toxic double, name string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, told).collect()}
    held = [i for i in range(1500) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert got[None]["predicted"] == 1 and got[5000]["score"] == got[5001]["score"] == got[5002]["score"] and got[5000]["predicted"] == 0
    assert got[5003]["predicted"] == 1
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())


def test_toxicity_of_the_test_tables(spark):
    """Recall and precision on held-out labels."""
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.toxicity(spark.read.parquet(f"{TABLES}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.95 * (n[1, 1] + n.get((0, 1), 0))


def test_toxicity_without_two_classes(docs, none, spark):
    told = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {x["score"] for x in toxicity.toxicity(docs, told).collect()} == {0.0}
    assert toxicity.toxicity(none, told.limit(0)).count() == 0


# 9 substring dedup


def check_factors(found, texts, width=13):
    """Each factor stands in its source word by word, and together they cover what was removed."""
    words = {i: brute.SPACED.findall(t or "") for i, t in texts}
    for r in found.collect():
        own = words[r["doc_id"]]
        for f in r["factors"]:
            n = f["end"] - f["start"]
            assert n >= width and f["source"] < r["doc_id"] and own[f["start"] : f["end"]] == words[f["source"]][f["source_start"] : f["source_start"] + n]
        assert len({k for f in r["factors"] for k in range(f["start"], f["end"])}) == r["n_removed"]


@pytest.mark.parametrize("size", [6 << 20, 800])
def test_substring_dedup(docs, rows, size):
    want = brute.substring_dedup([(r[0], r[1]) for r in rows])
    assert any(v[1] for v in want.values())
    found = substring_dedup.substring_dedup(docs, slice_bytes=size)
    assert by_id(found, "n_words", "n_removed", "kept") == want
    check_factors(found, [(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_of_few_words(spark, seed):
    """Windows in many contexts: anchors with many segments, sources that change inside a passage, repeats inside a text."""
    r = random.Random(seed)
    passages = [[r.choice("abc") for _ in range(r.randint(10, 30))] for _ in range(12)]
    texts = []
    for i in range(80):
        w = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            at = r.randint(0, len(p) // 2)
            w += p[at : r.randint(at, len(p))] + [r.choice("abcdefgh") for _ in range(r.randint(0, 3))]
        texts.append((i, " ".join(w)))
    made = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = substring_dedup.substring_dedup(made, slice_bytes=600)
    assert by_id(found, "n_words", "n_removed", "kept") == brute.substring_dedup(texts)
    check_factors(found, texts)


def test_substring_dedup_of_a_very_long_text(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(150_000)]
    texts = [(5, " ".join(words)), (3, " ".join(words[70_000:70_040])), (9, " ".join(words[149_980:])), (4, "")]
    found = substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert by_id(found, "n_words", "n_removed") == {5: (150_000, 40), 3: (40, 0), 9: (20, 20), 4: (0, 0)}
    check_factors(found, texts)


def test_substring_dedup_exchanges_in_proportion(spark):
    """Slices grow with the corpus, and so do rows: no part with their square."""
    r = random.Random(2)
    shared = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"w{r.randrange(3000)}" for _ in range(80)] + (shared if i % 3 == 0 else [])) for i in range(1600)]
    counts = []
    for n in (400, 800, 1600):
        made = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        by_slice = made.select(F.col("doc_id").alias("id"), "text").withColumn("slice", (F.col("id") % (n // 20)).cast("int")).groupBy("slice")
        counts.append(substring_dedup.segments(by_slice, 13).count())
    assert counts[1] <= 2.1 * counts[0] and counts[2] <= 2.1 * counts[1]


def test_substring_dedup_odd(odd, none, spark):
    got = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 40), (2, 0), (3, 40)], key=str)
    left = substring_dedup.without_repeats(odd)
    assert left.columns == odd.columns and sorted((str(r["doc_id"]), r["text"]) for r in left.collect() if r["doc_id"] in (2, 3)) == [("2", None), ("3", "more")]
    same_rows(left.filter("doc_id = 1"), odd.filter("doc_id = 1"))
    assert substring_dedup.substring_dedup(none).count() == 0
    many = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(20)))] * 300 + [(i, None) for i in range(5)], "doc_id long, text string")
    assert substring_dedup.substring_dedup(many).agg({"n_removed": "max"}).first()[0] == 0
    with pytest.raises(TypeError, match="whole numbers"):
        substring_dedup.substring_dedup(none.withColumn("doc_id", F.lit("a")))


# 10 fingerprints


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, low=0.02, high=0.9).collect()}
    order = sorted((r[:2] for r in rows), reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), brute.sha(text[: len(text) - third] + following[:third]))
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    prints = {}
    for i, text, *_ in rows:
        assert prints.setdefault(text or "", got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(got) == len(rows)


@pytest.mark.parametrize(("low", "high", "size"), [(0.02, 0.9, 200_000), (0.05, 0.3, 200_000), (0.05, 0.3, 0)])
def test_fingerprints_and_likeness(docs, rows, low, high, size):
    got = by_id(fingerprints.fingerprints(docs, low, high, table_terms=size), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    want = brute.i_match([(r[0], r[1]) for r in rows], low, high, fingerprints.LEVELS, fingerprints.TELLING)
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert all(math.isclose(got[i][k], want[i][k]) for i in want for k in (2, 3))


def test_fingerprints_of_null_and_repeated_ids_in_bulk(spark):
    """They are cut into several ranges, and each row is answered."""
    rows = [(None, f"w{i % 7} x{i} y") for i in range(200)] + [(5, f"v{i % 5} z{i}") for i in range(200)] + [(None, "same text")] * 50
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert made.count() == fingerprints.fingerprints(made, 0.0, 1.0).count()
    dealt = fingerprints.with_next(made, ranges=12)
    sizes = [r["count"] for r in dealt.filter("guest = 0").groupBy("part").count().collect()]
    assert len(sizes) >= 8 and sum(sizes) == len(rows) and dealt.filter("guest = 1").count() == len(sizes)


def test_fingerprints_of_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(3, long), (2, long + " more"), (1, "w1 w2 other")]
    got = by_id(fingerprints.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), 0.0, 1.0), "n_chars", "near_next")
    assert got[3] == (len(long), 1.0) and got[2][1] < 0.2


def test_fingerprints_by_join_are_the_same(docs):
    columns = ("fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert by_id(fingerprints.fingerprints(docs, 0.02, 0.9), *columns) == by_id(fingerprints.fingerprints(docs, 0.02, 0.9, table_terms=0), *columns)


def test_fingerprints_odd(odd, none, docs):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(docs.filter("doc_id = 3")).count() == 1


def test_fingerprints_reach_the_whole_lexicon(spark):
    texts = [f"word{i // 2}" for i in range(120)]  # each word is in two texts, so in the lexicon
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (200_000, 0):
        got = by_id(fingerprints.fingerprints(made, low=0, high=1, table_terms=size), "fingerprint", "near_next")
        assert all(set(f) - set("-.") for f, _ in got.values())
        # the next text has the next smaller id; after 0 comes 119
        assert [got[i][1] for i in range(120)] == [float(i % 2) for i in range(120)]


def test_fingerprints_of_short_texts_without_lexicon_terms(spark):
    texts = ["b a", "a b!", "one two", "three", "four", "", None, "?!", "five five", "five"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (200_000, 0):
        got = by_id(fingerprints.fingerprints(made, low=0.5, high=0.5, table_terms=size), "fingerprint", "near_next")
        assert all(not set(f) - set("-.") for f, _ in got.values())
        assert [got[i][1] for i in range(10)] == [0, 1, 0, 0, 0, 0, 1, 1, 0, 1]


def test_fingerprints_run_no_python(docs):
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
