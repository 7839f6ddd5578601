"""Collocations against brute force, piece by piece."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import phrases

DOCS = "doc_id bigint, text string, lang string"


def brute(rows, least, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = {}
        for p in kept:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), f[p])
        found = []
        for p in kept:
            a = f[p]
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]):  # noqa: E741
            out.append((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def texts():
    rng = random.Random(4)
    vocabulary = ["the", "of", "new", "york", "city", "hall", "été", "\U0001f600", "a\x00b", "A", "very", "x" * 40]
    rows = []
    for i in range(160):
        words = [rng.choices(vocabulary, [9, 6, 4, 4, 3, 3, 2, 2, 1, 5, 5, 1])[0] for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und", ""])))
    same = [(500 + i, "New York City hall opens; very very very good", "en") for i in range(60)]
    return rows + same + [(900, None, "en"), (901, "", "de"), (902, " .,;", "es"), (None, "the of", None), (903, "the of new york " * 4000, "fr")]


@pytest.mark.parametrize("hot", [1_000, 5])
def test_collocations(spark, monkeypatch, hot):
    """Pivots whole, and all but the rarest dealt out; tasks that send what they have after every few keys."""
    monkeypatch.setattr(phrases, "HOT_WORDS", hot)
    monkeypatch.setattr(phrases, "HOT_SHARE", 10**9)
    rows = texts()
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("phrase", "n", "f", "rank")}).repartition(5)
    for least, top in ((3, 2000), (30, 7)):
        got = phrases.collocations(table, least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = brute(rows, least, top)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_counters_that_words_share_change_nothing(spark, monkeypatch):
    """With two counters nearly all words tie, so owners are told apart by hash or position alone."""
    rows = texts()
    monkeypatch.setattr(phrases, "COUNTERS", 2)
    monkeypatch.setattr(phrases, "PAIR_BITS", 32768)
    got = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def mined(fragments, sizes):
    """The n-grams of these sizes that hold the pivot of each fragment."""
    got = Counter()
    for (left, _), found in fragments.items():
        for fragment, times in found.items():
            words = fragment.split(b" ")
            for s in range(left + 1):
                for e in range(max(left + 1, s + 2), min(s + 4, len(words)) + 1):
                    if e - s in sizes:
                        got[tuple(words[s:e])] += times
    return got


def test_each_occurrence_has_one_owner():
    """What the fragments give, without any limit, is each n-gram as often as it occurs."""
    text = b"a b a c b a a d. c a b b a"
    counters, every = np.ones(phrases.COUNTERS, np.int64), np.full(phrases.PAIR_BITS // 8, 255, np.uint8)
    got = mined(phrases.pair_fragments([text], "en", counters, 100), {2})
    got += mined(phrases.fragments([text], "en", counters, 100, every), {3, 4})
    want = Counter()
    for piece in text.split(b". "):
        words = piece.split(b" ")
        for k in (2, 3, 4):
            want.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    assert got == want


def test_rare_words_and_pairs_cut_fragments():
    counters = np.zeros(phrases.COUNTERS, np.int64)
    for word, n in ((b"the", 90), (b"of", 80), (b"city", 50)):
        counters[phrases._places(phrases.words_in([word]).hash, "en")[1]] = n
    bits = np.full(phrases.PAIR_BITS // 8, 255, np.uint8)
    text = b"the city of the rare the of the the the city"
    found = phrases.fragments([text], "en", counters, 10**6, bits)
    assert found == {
        (1, 1): {b"the city of the": 1, b"the of the the the": 1},
        (3, 1): {b"the the the city": 1},
        (0, 1): {b"the the the": 1},
    }
    hashes = phrases._places(phrases.words_in([b"of the"]).hash, "en")[0]
    (at,) = phrases._pair_places(hashes[:1], hashes[1:])
    bits[at >> 3] &= 255 ^ (1 << (at & 7))
    assert phrases.fragments([text], "en", counters, 10**6, bits) == {
        (1, 1): {b"the city of": 1},
        (3, 1): {b"the the the city": 1},
        (0, 1): {b"the the the": 1},
    }


def test_no_documents(spark):
    for rows in ([], [(1, None, None)], [(1, "a b c", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, DOCS)).count() == 0


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a passes 64 bits from some 4.6e12 on."""
    big = 4 * 10**18
    rows = [("en", "a", big + 3, 1), ("en", "b", big + 5, 1), ("en", "a b", big, 2), ("en", "a b a", big * 4 // 5, 3), ("en", "b a", big // 2, 2)]
    table = spark.createDataFrame(rows, "lang string, phrase string, f bigint, size int")
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in phrases.score(table).collect()}
    assert got["a b"] == (2000000 * big // (2 * big + 8), big + 3, big + 5)
    assert {r["phrase"] for r in phrases.covered(table).collect()} == {"a b", "b a"}
