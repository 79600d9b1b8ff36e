"""Ranked search and collocations against plain Python on small tables, with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from bundlescan.llm import collocations, ranked_search
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, queries, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in queries:
        found = []
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 8 * m))
                        for x, times in Counter(terms(text)).items() if x in bag)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,part", [(1, 20_000), (2, 2)])
def test_search_is_brute_force(spark, monkeypatch, seed, part):
    rnd = random.Random(seed)
    monkeypatch.setattr(ranked_search, "QUERY_ROWS", part)
    monkeypatch.setattr(ranked_search, "BUNDLE", 3)
    words = ["the"] * 8 + ["of"] * 4 + [f"w{i}" for i in range(60)] + ["a" * 20 + "b" + "c" * 20, "a" * 20 + "d" + "c" * 20, "naïve", "日本", "Upper"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 40)))) for i in range(150)]
    docs += [(7, docs[7][1]), (8, "Another, text: w1/w2"), (None, docs[3][1]), (None, "the w5"), (900, None), (901, ""), (902, "?! --"), (903, "the " * 20000)]
    queries = [(f"q{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(7)]
    queries += [("none", "nowhere"), ("null", None), ("empty", " . "), ("q0", "w1 w1 THE"), ("many", " ".join(words))]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id int, text string, score int, block int").repartition(5)
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id string, text string, rank string")
    got = ranked_search.search(df, asked, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, queries, 5)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert ranked_search.search(docs.limit(0), asked).count() == 0
    assert ranked_search.search(docs, asked.limit(0)).count() == 0
    assert ranked_search.search(docs.select("doc_id", F.lit(None).cast("string").alias("text")), asked).count() == 0


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    """All words given one hash: they are told apart by their bytes."""
    import numpy as np
    from bundlescan.llm.tokens import ALNUM, Words
    own = ranked_search.Terms(["alpha beta gamma " + "x" * 30 + "1" + "y" * 30])
    own.codes = np.zeros(len(own.names), np.uint64)
    own.most = len(own.names)
    words = Words(["beta delta alphas " + "x" * 30 + "1" + "y" * 30 + " " + "x" * 30 + "2" + "y" * 30 + " gamma alph"], ALNUM)
    words.code = np.zeros(len(words.code), np.uint64)
    assert [own.names[t] if t >= 0 else None for t in own.find(words).tolist()] == [b"beta", None, None, b"x" * 30 + b"1" + b"y" * 30, None, b"gamma", None]


def brute_phrases(rows, at_least, subsumed, best):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in (1, 2, 3):
                count[lang or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= at_least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= subsumed * a for q, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows_)[:best])]
    return sorted(out)


@pytest.mark.parametrize("seed,chunk", [(1, 12 << 20), (2, 400)])
def test_collocations_are_brute_force(spark, monkeypatch, seed, chunk):
    rnd = random.Random(seed)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    words = ["the"] * 6 + ["New", "york", "new", "York", "of", "a\x1cb", "é", "日本", "x/y", "--"] + [f"w{i}" for i in range(12)]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", ";\r\n"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None]))
            for _ in range(120)]
    rows += [(None, "en"), ("", None), ("red green blue. " * 30, "de"), ("red green blue. " * 30, "de"), ("one two " * 3000, "xx"), (" \t ", "zz"), ("...", "zz"), ("und x", "und")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "text string, lang string, prefix string, f int").repartition(4)
    got = collocations.collocations(df, at_least=4, subsumed=50, best=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 50, 25)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(200):
        a = rnd.randint(10, 10**15 - 1)
        rows.append((a, rnd.randint(a, 10**15 - 1), rnd.randint(a, 10**15 - 1)))
    rows += [(10**15 - 1,) * 3, (3, 3, 3), (10, 30, 10)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = df.select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)
