"""Byte BPE, decontamination, line and substring dedup, Jaccard join: brute force and odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlescan.llm import bpe, decontaminate, jaccard, line_dedup, substrings
from bundlescan.llm.components import components
from bundlescan.llm.tokens import ALNUM, SPACED, Words

SCHEMA = "doc_id bigint, text string"
ODD = [None, "", " ", "\n", "\n\n", "\t \r\n", "a", "A b", "Ünï côde   x", "x" * 5000, "na " * 3000, "😀 é​", "..."]


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame(list(enumerate(texts)), schema).repartition(3)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, low(text))


# ---------------------------------------------------------------- words

@pytest.mark.parametrize("table,pattern", [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_the_pattern(table, pattern):
    texts = ODD + ["x" * 700_000 + " y", "Foo-bar 12,é"]
    words, codes = Words(texts, table), {}
    for i, t in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        got = [words.data[words.start[j]:words.end[j]].decode() for j in range(a, b)]
        assert got == words_of(t, pattern)
        for g, c in zip(got, words.code[a:b].tolist()):
            assert codes.setdefault(g, c) == c
    assert len(set(codes.values())) == len(codes)


# ---------------------------------------------------------------- byte BPE

def test_bpe_is_tiktoken_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary(path).ranks, special_tokens={})
    rnd = random.Random(3)
    bits = ["a", "aa", " ", "\n", "é", "the", "ing", "\t", "1", "99", "漢", "😀", " ", "'s", "<|endoftext|>", "ab", "ba", "=-"]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["ab" * 20_000, "a" * 30_000]
    df = frame(spark, texts).withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN)
    both = bpe.encode(df, path, P.PATTERN, decoded="decoded")
    assert both.columns == out.columns and sorted(map(repr, both.collect())) == sorted(map(repr, out.collect()))
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in out.collect():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == other.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_forgets_without_changing_ids():
    import public_tokenizers as P
    path, texts = P.path("byte_bpe_50k.tiktoken"), ["some words here", "other words there", "some words here"]
    small, large = bpe.Codec(path, P.PATTERN, memo=1), bpe.Codec(path, P.PATTERN)
    assert [small.encode([t])[0] for t in texts] == [large.encode([t])[0] for t in texts]


def test_rank_queue_orders_by_rank_then_position():
    queue, rnd = bpe.RankQueue(70_000), random.Random(1)
    pushed = [(rnd.randrange(70_000), rnd.randrange(100)) for _ in range(2000)]
    for r, p in pushed:
        queue.push(r, p)
    got = []
    while (top := queue.pop()) is not None:
        got += [(top[0], p) for p in sorted(top[1])]
    assert got == sorted(pushed)


# ---------------------------------------------------------------- decontamination

def brute_hits(text, items, width=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, found = words_of(text, pattern), set(), set()
    for name, item in items:
        own = words_of(item, pattern)
        n = min(width, len(own))
        wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 22, 150])
def test_decontamination_is_brute_force(spark, block_bytes):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 12, 13, 14, 30])))) for i in range(6)]
    items += [(7, None), (8, ""), (9, "..."), (10, items[0][1]), (10, items[0][1])]
    texts = list(ODD)
    for _ in range(60):
        t = [rnd.choice(vocabulary + ["q1", "q2", "q3"]) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.5:
            at = rnd.randint(0, len(t))
            t[at:at] = re.split(r"\s", rnd.choice(items)[1] or "")
        texts.append(rnd.choice([" ", ", ", "\n-"]).join(t).title())
    docs = frame(spark, texts).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.verdict(decontaminate.scan(docs, bench, block_bytes=block_bytes))
    rows = {r.doc_id: r for r in found.collect()}
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(found).collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute_hits(t, items)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.hit_items, r.n_items) == (n, hit, names, len(names)), t
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert len(words_of(cut[i], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) == n - hit
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.verdict(decontaminate.scan(docs, empty)).filter("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


# ---------------------------------------------------------------- lines

def brute_lines(docs, min_chars, min_docs):
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    where = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                where[key(x)].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_is_brute_force(spark, batches, fanout):
    rnd = random.Random(7)
    pool = [f"Line number {i} with text" for i in range(15)] + ["short", "", "é" * 9, " Padded line TEXT \t"]
    docs = [(i, rnd.choice(["\n", "\r\n"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, docs[0][1]), (3, docs[3][1]), (None, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4).withColumn("n_lines", F.lit("clash")).withColumn("x", F.lit(1))
    out = line_dedup.dedup(df, min_chars=10, min_docs=5, batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "x", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr)
    assert got == brute_lines(docs, 10, 5)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_columns_named_like_findings_are_not_findings(spark):
    docs = spark.createDataFrame([(1, "clean words only", ["a", "b"], [7])], "doc_id int, text string, hit_items array<string>, hit_words array<int>")
    items = spark.createDataFrame([("a", "other words of an item")], "item_id string, text string")
    r = decontaminate.verdict(decontaminate.scan(docs, items)).first()
    assert r.hit_items == [] and r.n_hit == 0 and not r.contaminated


# ---------------------------------------------------------------- substrings

def test_lines_that_differ_in_signs_stay(spark):
    texts = {1: "if (a < b) { return values[index + 1]; } // and so on, to the line's end", 2: "if (a > b) { return values[index - 1]; } // and so on, to the line's end",
             3: "it was -5.0 degrees on that day, which is little for the season", 4: "it was 5.0 degrees on that day, which is little for the season",
             5: "हिन्दी में यह एक लम्बी पंक्ति है जो दो बार नहीं आती, की", 6: "हिन्दी में यह एक लम्बी पंक्ति है जो दो बार नहीं आती, के"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    assert {r.doc_id: r.text for r in substrings.dedup(df).collect()} == texts
    again = df.unionByName(spark.createDataFrame([(7, "IT was  -5.0 degrees on that day,\twhich is little for the season")], "doc_id int, text string"))
    assert {r.doc_id: r.text for r in substrings.dedup(again).collect()} == texts | {7: ""}


def test_texts_of_one_id_are_cut_apart(spark):
    line = "a line of more than forty characters that stands in two documents"
    rows = [(1, line), (2, f"before\n{line}"), (2, "A wholly different second text, which has no repeated line in it at all"), (2, f"before\n{line}")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, _spans string")
    got = sorted((r.doc_id, r.text, r._spans) for r in substrings.dedup(df).collect())
    assert got == sorted([(1, line, "x"), (2, "before\n", "x"), (2, rows[2][1], "x"), (2, "before\n", "x")])


def test_substring_dedup_keeps_the_earliest(spark):
    passage = " ".join(f"Sentence {i} has quite some words in it." for i in range(9))
    rnd = random.Random(2)
    other = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) + "."
    docs = [(1, f"{other()} {passage} {other()}"), (2, f"{other()}\n{passage.upper()}\n{other()}"), (3, other()),
            (4, f"Glued {passage} {other()}"), (5, None), (6, ""), (None, passage), (7, "Too short. Too short."), (8, "Too short.")]
    df = spark.createDataFrame(docs + [docs[1]], SCHEMA)
    spans = {(r.doc_id, r.kept_in): r for r in substrings.repeats(df).collect()}
    assert set(spans) == {(2, 1), (4, 1)}
    texts = dict(docs)
    r = spans[2, 1]
    assert texts[2][r.start:r.stop] == passage.upper()
    assert spans[4, 1].n_words >= 8 * 7
    out = {r.doc_id: r for r in substrings.dedup(df).collect()}
    assert out[1].text == texts[1] and out[3].text == texts[3] and out[None].text == passage and out[5].text is None
    assert passage.upper() not in out[2].text and len(out[2].removed_spans) == 1
    assert substrings.repeats(df.limit(0)).count() == 0


def test_substring_units_against_brute_force(spark):
    rnd = random.Random(9)
    pool = [" ".join(f"t{rnd.randrange(50)}" for _ in range(rnd.randint(1, 9))) + rnd.choice(".!?") for _ in range(25)]
    docs = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    first = {}
    for i, t in docs:
        for u in substrings.units(t, 3):
            first.setdefault(u["digest"], (i, u["place"]))
    want = set()
    for i, t in docs:
        run = []
        for u in [*substrings.units(t, 3), None]:
            if u is not None and first[u["digest"]] < (i, u["place"]):
                run.append(u)
                continue
            if sum(x["words"] for x in run) >= 10:
                want.add((i, run[0]["start"], run[-1]["stop"]))
            run = []
    got = {(r.doc_id, r.start, r.stop) for r in substrings.repeats(spark.createDataFrame(docs, SCHEMA), unit_words=3, run_words=10).collect()}
    assert got == want and got


def test_repeated_lines_and_paragraphs_go(spark):
    footer = "Licensed under the terms of the public licence, version two."
    poem = "roses are red\nviolets are blue\nsugar is sweet\nand so are you"
    thai = "การทดสอบภาษาไทย" * 8
    han = "".join(chr(0x4e00 + (i * 37) % 3000) for i in range(120))
    docs = [(1, f"First text here.\n{footer}\n\n{poem}\n\n{thai}\n{han}"), (2, f"Second text is here.\n{footer.upper()} \nGo on"),
            (3, f"Third one\n \n{poem}\n\nroses are red"), (4, f"{thai}\nnothing like this before\n{footer}\n{footer}"), (5, f"一二。{han}。三四五"), (6, f"{han}")]
    df = spark.createDataFrame(docs, SCHEMA)
    texts = dict(docs)
    got = sorted((r.doc_id, texts[r.doc_id][r.start:r.stop].strip(), r.kept_in, r.n_words) for r in substrings.repeats(df).collect())
    n = len(substrings._WORD.findall(thai))
    assert got == sorted([(2, footer.upper(), 1, 10), (3, poem, 1, 13), (4, thai, 1, n), (4, f"{footer}\n{footer}", 1, 20),
                          (5, f"{han}。", 1, 1), (6, han, 1, 1)])
    left = {r.doc_id: r.text for r in substrings.dedup(df).collect()}
    assert left[1] == texts[1] and left[4].strip() == "nothing like this before" and left[3].split("\n")[-1] == "roses are red"


# ---------------------------------------------------------------- Jaccard join

def brute_groups(docs, percent, n=3):
    sets, up = {}, {}
    for i, t in docs:
        w = words_of(t)
        k = min(n, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
        up[i] = i

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("percent,seed", [(90, 1), (90, 2), (60, 3)])
def test_jaccard_join_is_brute_force(spark, percent, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    docs = list(ODD) + [ODD[7]] * 2
    for _ in range(12):  # chains of near copies, so that components hold pairs that are not linked
        base = [word() for _ in range(rnd.randint(3, 150))]
        for _ in range(rnd.randint(1, 12)):
            docs.append(" ".join(base))
            base = list(base)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(base))
                base[at:at + 1] = rnd.choice([[word()], [], [base[at], word()]])
            base = base or [word()]
    docs = list(enumerate(docs))
    rnd.shuffle(docs)
    df = spark.createDataFrame([*docs, docs[0], (None, "a b c d"), (None, None)], SCHEMA).repartition(3).withColumn("n_shingles", F.lit("clash"))
    out = jaccard.similar_groups(df, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute_groups(docs, percent)
    assert Counter(r.doc_id for r in out)[None] == 2 and all(r.component_id is None for r in out if r.doc_id is None)
    assert jaccard.similar_groups(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: top(i) for i in up}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
