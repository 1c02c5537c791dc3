from __future__ import annotations

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara import config
from opinara.operators import mentions as M
from opinara.operators import passages as G
from opinara.sources.transcripts import parse_transcripts

SUBJECTS = [
    ("NVDA", "Nvidia", ["NVDA", "Jensen Huang"]), ("INTC", "Intel", ["INTC", "Intel Corporation"]),
    ("AAPL", "Apple", ["AAPL", "Apple Inc."]), ("META", "Meta Platforms", ["Facebook", "META"]),
    ("ARM", "Arm Holdings", ["Arm Holdings plc", "ARM stock"]), ("AMD", "AMD", ["NVDA competitor"]),
    ("TSM", "TSMC", ["Taiwan Semiconductor"]), ("BTC-USD", "Bitcoin", ["BTC", "digital gold", "crypto"]),
]


@pytest.fixture(scope="module")
def dim(spark):
    subjects = spark.createDataFrame(SUBJECTS, "proxy string, display string, aliases array<string>")
    return M.alias_dimension(subjects, M.asr_variants(spark)).cache()


def counts(spark, dim, text, strict=True, inline=1000):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    out = M.count_subjects(df, M.AliasSet(dim, inline), strict=strict).collect()
    return {r.subject: r.n for r in out}


def test_alias_dimension(dim):
    have = {}
    for r in dim.collect():
        have.setdefault(r.subject, set()).add(r.alias)
    assert have["BTC-USD"] == {"bitcoin", "btc"}
    assert have["AMD"] == {"amd", "advanced micro devices"}
    assert have["AAPL"] == {"apple", "aapl"} and have["ARM"] == {"arm holdings"}
    assert {"invidia", "nvidea", "in video", "nvidia", "nvda", "jensen huang"} == have["NVDA"]


@pytest.mark.parametrize("inline", [1000, 0])
def test_disambiguation(spark, dim, inline):
    for text, subject in [("their intelligence report was useful in practice", "INTC"),
                          ("she peeled an apple and went for a long walk", "AAPL"),
                          ("everyone was kept at arm's length for years", "ARM"),
                          ("a meta-analysis of all trials found nothing", "META")]:
        assert subject not in counts(spark, dim, text, inline=inline)
    for text, subject in [("Intel's earnings disappointed and the stock fell", "INTC"),
                          ("Apple gave weak guidance to investors", "AAPL"), ("Invidia shares doubled", "NVDA")]:
        assert subject in counts(spark, dim, text, inline=inline)


def test_counts_distinguish_listing_from_discussion(spark, dim):
    assert set(counts(spark, dim, "names such as Nvidia, TSMC, AMD and so on").values()) == {1}
    assert counts(spark, dim, "Nvidia leads. Nvidia's margins say so; if Nvidia slips all slip. TSMC too.") == {"NVDA": 3, "TSM": 1}


def test_longer_alias_covers_shorter(spark, dim):
    assert counts(spark, dim, "taiwan semiconductor and taiwan semi report") == {"TSM": 2}


def test_cue_window_and_percent(spark, dim):
    far = "apple " + "x" * 230 + " earnings"
    assert counts(spark, dim, far) == {} and counts(spark, dim, far, strict=False) == {"AAPL": 1}
    assert counts(spark, dim, "apple fell 12% this week") == {}          # % next to a space is no whole word
    assert counts(spark, dim, "apple fell 12%x") == {"AAPL": 1}


def brute_counts(text, aliases, strict, ambiguous, cues):
    lowered, found = text.lower(), {}
    for subject, names in aliases.items():
        spans = []
        for alias in sorted(names, key=lambda a: (-len(a), a)):
            for hit in re.finditer(r"\b" + re.escape(alias) + r"\b", lowered):
                at = hit.start()
                if strict and alias in ambiguous:
                    near = lowered[max(0, at - config.CUE_WINDOW_CHARS):at + config.CUE_WINDOW_CHARS]
                    if not any(re.search(r"\b" + re.escape(c) + r"\b", near) for c in cues):
                        continue
                if not any(s <= at < e for s, e in spans):
                    spans.append((at, hit.end()))
        if spans:
            found[subject] = (len(spans), min(spans)[0])
    return found


@pytest.mark.parametrize("inline", [1000, 0])
def test_counting_against_brute_force(spark, inline):
    rng = random.Random(11)
    aliases = {"A": ["ab cd", "ab", "cd ab"], "B": ["cd", "é ab"], "C": ["x.y", "ab cd ab"], "D": ["d-e", "naïve"]}
    ambiguous, cues = {"ab", "x.y"}, ("buy", "%")
    vocabulary = ["ab", "cd", "é", "x.y", "d-e", "naïve", "buy", "Ab", "abé", "%", "12%x", "zz", "_ab", "cd_"]
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "-", "\n"]) for _ in range(rng.randint(1, 160)))) for i in range(150)]
    dim = spark.createDataFrame([(s, a, a in ambiguous) for s, names in aliases.items() for a in names], "subject string, alias string, ambiguous boolean")
    df = spark.createDataFrame(texts, "doc_id int, text string")
    for strict in (True, False):
        got = {}
        for r in M.count_subjects(df, M.AliasSet(dim, inline), strict=strict, cues=cues).collect():
            got.setdefault(r.doc_id, {})[r.subject] = (r.n, r.first_start)
        for i, text in texts:
            assert got.get(i, {}) == brute_counts(text, aliases, strict, ambiguous, cues), (i, text)


def test_index_walks_texts_where_they_lie(spark):
    dim = spark.createDataFrame([(f"S{i % 700}", f"name{i} inc", i % 50 == 0) for i in range(20_000)], "subject string, alias string, ambiguous boolean")
    rng = random.Random(12)
    picked = [[rng.randrange(30_000) for _ in range(60)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " and ".join(f"Name{k} Inc" for k in p)) for i, p in enumerate(picked)], "doc_id int, text string")
    counted = M.count_subjects(docs, M.AliasSet(dim), strict=False)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, p in enumerate(picked):
        for k in p:
            if k < 20_000:
                want[i, f"S{k % 700}"] = want.get((i, f"S{k % 700}"), 0) + 1
    assert {(r.doc_id, r.subject): r.n for r in counted.collect()} == want


def test_slices_and_cues_cut_by_the_window(spark, monkeypatch):
    from opinara.operators import alias_index as I

    rng = random.Random(13)
    aliases = {"A": ["ab", "ab ab", "b ab b"], "B": ["cd cd", "cd"], "C": ["xbuy"]}
    cues = ("buy", "y")
    pieces = ["ab", "cd", "b", "xbuy", "buyx", "z" * 30, "é" * 40, " ", "ab ab", "cd cd cd"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    index = I.AliasIndex([(s, a, a in ("ab", "cd")) for s, names in aliases.items() for a in names], True, cues)
    monkeypatch.setattr(I, "SLICE_CHARS", 500)
    got = index.arrays(I.pa.array([*texts, None])).to_pylist()
    for text, found in zip([*texts, ""], got):
        assert {f["subject"]: (f["n"], f["first_start"]) for f in found} == brute_counts(text, aliases, True, {"ab", "cd"}, cues), text


def segs(spark, texts, guid="e1"):
    return spark.createDataFrame([(guid, i, 5.0 * i, 5.0 * i + 5, None, t) for i, t in enumerate(texts)],
                                 "guid string, seg_idx int, start double, end double, speaker string, text string")


def test_a_list_of_names_is_one_opinion(spark, dim):
    texts = ["So how did all of that blow up? The chip index, as you know,", "the big semiconductor index, has dropped over 20% in one month.",
             "That is a bear market for all who do not trade these things.", "The index holds the thirty largest listed makers, people such as",
             "Nvidia, TSMC, AMD, all of those big names, though it recovered.", "Traders were leaning the wrong way with leverage into the fall."]
    out = G.build_passages(segs(spark, texts), M.AliasSet(dim)).collect()
    assert len(out) == 1 and len({r.text for r in out}) == 1


def test_two_discussed_subjects_both_count(spark, dim):
    texts = ["Nvidia looks expensive and Nvidia has stretched guidance if you ask me.", "Meanwhile Intel is cheap, Intel owns capacity, and Intel has a floor",
             "that is higher than people think given foundry earnings and revenue.", "So one is a sale and the other a purchase into the next quarter."]
    out = G.build_passages(segs(spark, texts), M.AliasSet(dim)).collect()
    assert {r.subject for r in out} == {"NVDA", "INTC"} and all(len(r.text.split()) >= 25 for r in out)


def brute_growth(words, i):
    lo = hi = i
    total = words[i]
    while total < config.TARGET_WORDS and (lo > 0 or hi < len(words) - 1):
        if lo > 0:
            lo -= 1
            total += words[lo]
        if total < config.TARGET_WORDS and hi < len(words) - 1:
            hi += 1
            total += words[hi]
    return lo, hi, total


@pytest.mark.parametrize("chunk", [512, 150])
def test_growth_against_brute_force_over_chunk_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(G, "CHUNK_SEGMENTS", chunk)
    rng = random.Random(3)
    lengths = [rng.choice([1, 1, 2, 3, 9, 40]) for _ in range(900)] + [1] * 300
    texts = [" ".join(["w"] * n) for n in lengths]
    got = rows(G.expand_passages(segs(spark, texts), F.col("seg_idx") % 3 == 0), "seg_idx", "lo", "hi", "words")
    assert got == sorted(((i, *brute_growth(lengths, i)) for i in range(0, len(lengths), 3)), key=repr)


@pytest.mark.parametrize("chunk", [512, 150])
def test_growth_over_blank_segments(spark, monkeypatch, chunk):
    monkeypatch.setattr(G, "CHUNK_SEGMENTS", chunk)
    monkeypatch.setattr(G, "BLOCK_SEGMENTS", 400)
    rng = random.Random(5)
    lengths = [rng.choice([0, 0, 0, 1, 2, 9, 40]) for _ in range(700)] + [0] * 200 + [2] + [0] * 200 + [200] + [1] * 100 + [0] * 1500 + [3, 0, 0]
    texts = [" ".join(["w"] * n) for n in lengths]
    got = {r.seg_idx: r for r in G.expand_passages(segs(spark, texts), F.col("seg_idx") % 3 == 0).collect()}
    assert sorted(got) == list(range(0, len(lengths), 3))
    for i, r in got.items():
        lo, hi, words = brute_growth(lengths, i)
        assert (r.lo, r.hi, r.words, r.start_s, r.text) == (lo, hi, words, 5.0 * lo, " ".join(texts[lo:hi + 1]).strip()), i


def test_two_hundred_blanks_beside_a_trigger(spark):
    texts = ["a b"] + [""] * 200 + [" ".join(["w"] * 200)]
    got = rows(G.expand_passages(segs(spark, texts), F.col("seg_idx") == 0), "seg_idx", "lo", "hi", "words")
    assert got == [(0, 0, 201, 202)]
    assert rows(G.expand_passages(segs(spark, ["", "", ""]), F.lit(True)), "seg_idx", "lo", "hi", "words", "text") == [(i, 0, 2, 0, "") for i in range(3)]


def test_transcript_parsing(spark):
    raw = "00:00:02\nSpeaker 1: Radio news\n and more.\n\n00:00:18\nJane Doe: Hello there.\n\n00:00:20\n\n\n01:00:33\nno speaker: lower case\n"
    df = spark.createDataFrame([("g", raw)], "guid string, raw string")
    out = [tuple(r) for r in parse_transcripts(df).orderBy("seg_idx").collect()]
    assert out == [("g", 0, 2.0, 18.0, "Speaker 1", "Radio news and more."), ("g", 1, 18.0, 3633.0, "Jane Doe", "Hello there."),
                   ("g", 2, 3633.0, 3633.0, None, "no speaker: lower case")]


def test_passage_records(spark, dim):
    episodes = spark.createDataFrame([("e1", "Show", "Title", "https://a/1.mp3", None)],
                                     "guid string, show string, title string, audio_url string, published timestamp")
    texts = ["filler " * 30, "Nvidia and Nvidia " + "word " * 150]
    r = G.build_passages(segs(spark, texts), M.AliasSet(dim), episodes).first()
    assert (r.external_id, r.source, r.source_type, r.url) == ("e1:NVDA:5", "Show", "podcast", "https://a/1.mp3#t=5")


def test_both_lookups_agree_also_on_aliases_without_letters(spark):
    rng = random.Random(3)
    aliases = spark.createDataFrame([("PLUS", "+++", False), ("CPP", "c++", False), ("MIX", "a-b", False), ("DOT", "...", False), ("BIG", "big one", False)],
                                    "subject string, alias string, ambiguous boolean")
    texts = ["a+++b is it", "c++x and c++ y", "see a...b", "a-b a-b", "big one"] + [
        "".join(rng.choice(["a", "b", "+", ".", " ", "c", "-", "big one"]) for _ in range(25)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one, other = (rows(M.count_subjects(docs, M.AliasSet(aliases, n), strict=False)) for n in (100, 0))
    assert one == other and any("PLUS" in r for r in one)
