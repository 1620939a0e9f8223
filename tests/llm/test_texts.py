import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinspark.llm import lookalike, packing, quality, tokens

TEXTS = [
    "Hello world's end, it's 12345 times!!  Two  blanks\n\n\ttab", "", None, "   ", "naïve café 東京 Привет 🤖🤖", "<|endoftext|> is text", "a" * 5000,
    "x = 3.14; y\r\n\r\n  z", "  mixed　blanks", "it's we'll I'd they've", "word " * 3000, "𝔘𝔫𝔦 ﻿ zero​width", "Ꟁ newer letters \U0001e030 there",
]


def test_encoding_is_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, block int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, x in enumerate(TEXTS):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, x
    counts = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(docs).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    decoded = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert decoded == {i: x or "" for i, x in enumerate([*TEXTS, TEXTS[0]])}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_blocks_are_cut_by_words(spark, monkeypatch):
    slices = list(tokens._slices(__import__("numpy").array([3, 0, 5_000_000, 1, 1_999_999, 2])))
    assert slices[0] == (0, 2) and slices[1] == (2, 3) and slices[-1][1] == 6


def brute_fill(sizes, room):
    best = {0}
    for s in sizes:
        best |= {b + s for b in best if b + s <= room}
    return max(best)


def test_fullest_filling_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.randint(1, 30) for _ in range(r.randint(0, 9))]
        room = r.randint(0, 60)
        counts = {s: sizes.count(s) for s in sizes}
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(got) == brute_fill(sizes, room) and all(got.count(s) <= counts[s] for s in got)


def test_containers(spark):
    r = random.Random(5)
    sizes = [0, None, 10, 25, 100] + [r.randint(1, 12) for _ in range(200)] + [7] * 150
    items = spark.createDataFrame([(i % 300, s, "x") for i, s in enumerate(sizes)], "doc_id long, tokens long, pack string")
    rows = packing.fill_containers(items, [("a", 10), ("b", 64)], "doc_id", "tokens").collect()
    for pack, capacity in (("a", 10), ("b", 64)):
        mine = [x for x in rows if x["pack_name"] == pack]
        fill = {}
        for x in mine:
            fill[x["container"]] = fill.get(x["container"], 0) + x["size"]
        total = sum(s or 0 for s in sizes)
        assert max(fill.values()) <= capacity and sum(fill.values()) == total and set(fill) == set(range(len(fill)))
        assert len(fill) <= -(-total // capacity) * 1.25 + 1
        assert len(mine) == sum(max(1, -(-(s or 0) // capacity)) for s in sizes)
    assert packing.fill_containers(items.limit(0), [("a", 10)], "doc_id", "tokens").count() == 0
    assert packing.fill_containers(items.limit(2), [("a", 10)], "doc_id", "tokens").count() == 2
    with pytest.raises(ValueError):
        packing.fill_containers(items, [("a", 0)], "doc_id", "tokens")


PROSE = (
    "The invention relates to a pump that is mounted on the frame. It has been found that the flow can be controlled, and the seal is dried before use. "
    "According to one embodiment, the outer shell comprises two sections which are connected to the valve so that losses are avoided."
)
OTHER = {
    "list": "\n".join(f"{i} gas scrubber part {i}" for i in range(10, 40, 2)), "table": "\n".join(f"S-{i} | {i}.5 | n.d. | <0.01 | 7{i}" for i in range(20)),
    "base64": "\n".join("".join(random.Random(i).choices("ABCDEFabcdef0123456789+/", k=64)) for i in range(20)), "repeated": "page left blank " * 60,
    "noise": "th^s #s n;t t*xt w·th |etters <hat @re b!oken i~ ev%ry w_rd /f it " * 6, "dots": ". " * 80, "opened": PROSE.split(". ")[0] + ".\n" + "\n".join(f"{i} valve {i}" for i in range(40)),
}


#: What the thresholds are on a table of patents; a handful of texts has no distributions.
USUAL = {
    "usual": 311.0, "body_common": 0.415, "richness": 1.843, "words_a_sentence": 13.9, "words_a_line": 26.3, "variety": 8.08, "garbled_share": 0.29,
    "delimited_lines": 0.44, "labelled_lines": 0.26, "separator_share": 0.27, "distinct_lines": 0.59, "longest_share": 0.44, "symbol_share": 0.26,
}


def test_thresholds_come_from_the_texts(spark, sf):
    import numpy as np

    counts = np.zeros(100)
    counts[[3, 4, 5]], counts[[70, 71]] = 500, 40
    assert 0.06 <= quality.split_point(counts) <= 0.70 and quality.split_point(np.zeros(100)) == 0.5 and quality.split_point(np.eye(100)[7]) == 0.5
    words = [r["word"] for r in spark.read.parquet(f"{sf}/common_words.parquet").collect()]
    stats = quality.text_statistics(spark.read.parquet(f"{sf}/documents.parquet"), words)
    learnt = quality.learn_thresholds(stats)
    assert set(learnt) == set(USUAL) and all(0 < v for v in learnt.values())
    seen = sorted(r["words_a_line"] for r in stats.filter("words > 0").collect())
    assert learnt["words_a_line"] == pytest.approx(seen[(len(seen) - 1) // 2], rel=0.05)
    assert quality.learn_thresholds(stats.limit(0))["usual"] == 0.0


def test_text_types(spark):
    words = "the a is that on it has been and can be before to one two which are so of in for with".split()
    prose = [PROSE.replace("pump", f"pump {i}").replace("valve", f"valve {i % 7}") for i in range(80)]
    texts = [*prose, *OTHER.values(), None, "", " \n ", *OTHER.values()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r["doc"]: r for r in quality.documents_by_type(docs, words, thresholds=USUAL).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["text_type"] == "prose" for i in range(80))
    for k, name in enumerate(OTHER):
        assert got[80 + k]["p_prose"] < 0.5, name
    blank = [got[80 + len(OTHER) + k] for k in range(3)]
    assert all(b["text_type"] == "blank" and b["words"] == 0 and b["p_prose"] is None for b in blank)
    one = got[0]
    assert one["words"] == len([w for w in texts[0].split()]) and one["lines"] == 1 and one["ended_lines"] == 1.0
    assert one["mean_word"] == pytest.approx(sum(len(w.strip(quality.STRIPPED)) for w in texts[0].split()) / one["words"])
    assert quality.documents_by_type(docs.limit(0), words).count() == 0


def test_lookalikes(spark):
    cases = {
        "Ĳssel": "IJssel", "ĳs": "ijs",
        "Ａpple　Inc．": "Apple Inc.", "Café": "Café", "Zero​Width": "ZeroWidth", "Non break": "Non break", "Grеаtеr": "Greater",
        "Oοps": "Oops", "ﬁnance": "finance", "no‑break": "no-break", "soft­hyphen": "softhyphen", "𝐁old": "Bold", "Energy Ⅱ DRⅣE": "Energy II DRIVE", "Дунавa": "Дунава",
    }
    same = ["Café Zürich", "株式会社グマ", "Вайасопо Мербепа ООД", "АО", "two  blanks", "O'Neil & Co.", "", "straße", "№ 5"]
    filler = [("the quick brown fox jumps over lazy dogs AEO " * 3,)] * 40
    rows = [(i, v, None, 1) for i, v in enumerate([*cases, *same, None])] + [(1000 + i, f[0], "Дунава река", 1) for i, f in enumerate(filler)]
    df = spark.createDataFrame(rows, "rec_id long, name string, address string, form int")
    got = {r["rec_id"]: r["form"] for r in lookalike.consistent_forms(df, "rec_id", ["name", "address"]).collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())
    assert all(i not in got for i in range(len(cases), len(cases) + len(same) + 1))
    again = df.filter(F.col("rec_id") < 0)
    assert lookalike.consistent_forms(again, "rec_id", ["name"]).count() == 0


def test_lookalike_classes_hold_their_members():
    for members in lookalike.same_shape():
        folded = {"".join(c for c in unicodedata.normalize("NFKD", m) if unicodedata.category(c) not in ("Cf", "Mn", "Zs")) for m in members}
        assert len(members) > 1 and all(isinstance(m, str) for m in members) and folded
