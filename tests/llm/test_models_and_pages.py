"""N-gram model, language ID, main text, WARC, near vectors: brute force, round trips, odd inputs."""

import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlescan.llm import html, language, ngram_lm, vectors, warc
from bundlescan.llm.common import scratch
from test_text_operators import ODD, SCHEMA, frame, words_of

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- n-gram model

class Brute:
    """The same model over dictionaries."""

    def __init__(self, texts):
        docs = [["<s>", *words_of(t), "</s>"] for t in texts]
        self.words = Counter(w for d in docs for w in d[1:])
        self.pairs = Counter(p for d in docs for p in zip(d, d[1:]))
        self.total, self.follow, self.before = Counter(), defaultdict(list), Counter()
        for (a, b), c in self.pairs.items():
            self.total[a] += c
            self.follow[a].append(c)
            self.before[b] += 1
        tally = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        self.d = ngram_lm.discounts(tally(self.pairs.values()))
        self.low_d = ngram_lm.discounts(tally(self.before.values()))

    def off(self, c, d):
        return c - d[min(c, 3) - 1] if c else 0.0

    def low(self, w):
        types = len(self.pairs)
        free = sum(self.low_d[min(c, 3) - 1] for c in self.before.values()) / types
        return self.off(self.before[w], self.low_d) / types + free / (len(self.words) + 1)

    def p(self, w, v):
        if not self.total[v]:
            return self.low(w)
        free = sum(self.d[min(c, 3) - 1] for c in self.follow[v]) / self.total[v]
        return self.off(self.pairs[v, w], self.d) / self.total[v] + free * self.low(w)

    def score(self, text):
        t = ["<s>", *words_of(text), "</s>"]
        n, v = sum(self.words.values()), len(self.words)
        return (len(t) - 1, sum(self.words[w] > 0 for w in t[1:]), n, sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in t[1:]),
                sum(math.log10(self.p(w, c)) for c, w in zip(t, t[1:])))


@pytest.mark.parametrize("shard_keys,flush", [(4_000_000, 3_000_000), (400, 300)])
def test_model_is_brute_force(spark, monkeypatch, shard_keys, flush):
    monkeypatch.setattr(ngram_lm, "SHARD_KEYS", shard_keys)  # small shards: several of each kind, and hot contexts
    monkeypatch.setattr(ngram_lm, "_FLUSH", flush)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices([f"W{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=rnd.randint(0, 40))) for _ in range(120)]
    texts += ["the and " * 400, *ODD]
    train = texts[20:]
    model = ngram_lm.train(frame(spark, train))
    brute = Brute(train)
    assert model.tokens == sum(brute.words.values()) and model.types == len(brute.words)
    assert model.discounts == pytest.approx(brute.d) and model.low_discounts == pytest.approx(brute.low_d)
    df = frame(spark, texts + ["never seen words W0"]).withColumn("score", F.lit("clash"))
    for r in ngram_lm.score(df, model).collect():
        want = brute.score(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9)
    for v in ("<s>", "w0", "w1", "none"):
        assert sum(brute.p(w, v) for w in [*brute.words, "unknown"]) == pytest.approx(1)


def test_model_without_training_rows(spark):
    model = ngram_lm.train(frame(spark, []))
    r = ngram_lm.score(frame(spark, ["a b"]), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", ngram_lm.fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)


# ---------------------------------------------------------------- language

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = ngram_lm.fold(F.col("doc_id"), 3) == 1
    model = language.train(docs, ~held)
    out = language.predict(docs.filter(held), model)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    rows = out.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.limit(300), F.lit(True), per_language=30)
    odd = frame(spark, [*ODD, "123 !?", "漢字漢字"]).withColumn("lang_pred", F.lit(5))
    for r in language.predict(odd, model).collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.langs) if has_letter else (r.lang_pred == "und" and r.score == 0)
    assert language.train(docs.limit(0), F.lit(True)) is None
    assert language.predict(odd, None).filter("lang_pred <> 'und'").count() == 0


def brute_set(text):
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(plain.split()) + " "
    return {plain[i:i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def test_kernel_and_machines_against_dictionaries(monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 3)
    random.seed(8)
    scripts = {"a": "abcdeé", "b": "абвгде", "c": "".join(map(chr, range(0x4e00, 0x4e00 + 1500)))}
    texts, langs = [], []
    for k in range(36):
        lang = "abc"[k % 3]
        texts.append(" ".join("".join(random.choices(scripts[lang] + "xyz", k=random.randint(1, 6))) for _ in range(30)) + "  12, !")
        langs.append(lang)
    for table, piece in ((1 << 24, 1 << 19), (0, 7)):
        monkeypatch.setattr(language, "_TABLE", table)
        monkeypatch.setattr(language, "_PIECE", piece)
        model = language.Model(texts, langs, 9, 1e-2)
        marks = [texts[i] for lang in "abc" for i in [j for j, x in enumerate(langs) if x == lang][:3]]
        used = set().union(*map(brute_set, marks))
        odd = ["", "a", "é  б", "!!", texts[0] + texts[1], texts[2].upper()]
        want = [[len(brute_set(t) & brute_set(m)) / ((max(1, len(brute_set(t) & used)) * len(brute_set(m))) ** 0.5) for m in marks] for t in texts + odd]
        assert np.allclose(model.kernel(texts + odd), want, atol=1e-5)
        # ridge on the Nyström map, each language weighing the same, by a plain least-squares solver
        k = np.array(want[:len(texts)])
        value, vector = np.linalg.eigh(np.array([[len(brute_set(a) & brute_set(b)) / (len(brute_set(a)) * len(brute_set(b))) ** 0.5 for a in marks] for b in marks]))
        root = vector / np.sqrt(value)
        x, y = k @ root, np.where(np.array(langs)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
        share = np.full(len(texts), 1 / len(texts))[:, None]
        mx, my = (share * x).sum(0), (share * y).sum(0)
        left = np.concatenate([np.sqrt(share) * (x - mx), np.sqrt(1e-2) * np.eye(x.shape[1])])
        w = np.linalg.lstsq(left, np.concatenate([np.sqrt(share) * (y - my), np.zeros((x.shape[1], 3))]), rcond=None)[0]
        assert np.allclose(model.kernel(texts) @ model.weights + model.constant, (x - mx) @ w + my, atol=1e-3)
        assert model.predict(texts)[0] == langs


def test_every_language_and_script_is_learned(spark):
    random.seed(9)
    words = {f"l{k}": ["".join(map(chr, random.sample(range(0x4e00 + 40 * k, 0x4e00 + 40 * k + 40), 3))) for _ in range(30)] for k in range(60)}
    rows = [(i, " ".join(random.choices(words[f"l{i % 60}"], k=20)), f"l{i % 60}") for i in range(60 * 12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = language.train(docs.filter("doc_id % 2 = 0 or doc_id >= 360"), F.lit(True))
    assert len(model.langs) == 60
    out = language.predict(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


# ---------------------------------------------------------------- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div id="cookie-notice"><p>We use cookies on this site, as sites do.</p></div>
%s<h1>Real &amp; true title</h1><p>First paragraph of the text, which has <b>some</b> words&nbsp;in it.<br>And more.
<p>Short one.</p><div class="advert">Buy now, it is cheap and good for all of you.</div><ul><li>point one<li>point two</ul>
<form><label>Mail</label><input></form><script>var x = "</p>";</script><p>Last &lt;paragraph&gt; of the text, as long as the first one.</p>%s
<section id="comments"><p>A reader says that this is a fine text, and says it at some length.</p></section>
<aside><p>Other news that nobody wants to read, but with long sentences.</p></aside><footer>&copy; 2020 us</footer>"""
TEXT = ("Real & true title\nFirst paragraph of the text, which has some words in it. And more.\nShort one.\npoint one\npoint two\n"
        "Last <paragraph> of the text, as long as the first one.")


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("", "")])
def test_main_text(wrap):
    assert html.main_text(PAGE % wrap) == TEXT


WORDS = "<p>" + " ".join(["word"] * 60) + ".</p>"
BODY = ("<header class='entry-header'><h1>The title</h1></header>" + WORDS + "<p>Short <a href='x'>one</a>.</p>" + WORDS)
ROUND = """<html><body><nav><a href='x'>Home</a></nav>%s<div class='sidebar'><p>Side text that goes on and on and on.</p></div>
<div class='related-posts'><article><p>Another text that one could read now.</p></article></div>
<div class='comments'><article class='comment'><p>I like this text a lot, really a lot.</p></article></div><footer>c</footer></body></html>"""


@pytest.mark.parametrize("wrap", [
    "<div class='layout has-sidebar'><article>%s</article></div>", "<div class='page no-comments'><main>%s</main></div>",
    "<div id='main-search-results'><article>%s</article></div>", "<div class='tags-page'><main>%s</main></div>",
    "<div class='post single-post related-post'>%s</div>", "<form id='aspnetForm'><div class='content'>%s</div></form>",
    "<div class='with-nav not-hidden'><div role='main'>%s</div></div>", "<form><article>%s</article></form>"])
def test_wrappers_do_not_empty_an_article(wrap):
    got = html.main_text(ROUND % (wrap % BODY)).split("\n")
    assert got == ["The title", " ".join(["word"] * 60) + ".", "Short one.", " ".join(["word"] * 60) + "."]


def test_linked_items_of_an_article_stay():
    got = html.main_text("<article><h2>List</h2>" + WORDS + "<ul><li><a href='a'>first thing</a></li><li><a href='b'>second</a></li></ul></article>").split("\n")
    assert got[2:] == ["first thing", "second"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "</script", "<script", "<!-", "<b>", "<", "<i><div><b></i>", "<p>x</i>", "&", "<td><tr>"])
def test_broken_pages_take_linear_time(piece):
    for tail in ("", '">"', ">"):
        start = time.time()
        html.main_text("<b>" * 2000 + piece * (10**6 // len(piece)) + tail)
        assert time.time() - start < 8  # a quadratic reading takes hours


def test_main_text_odd_inputs(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>One.<p>Two <!-- open"), (4, "u", '<div "a'), (None, "u", "<script>x"), (5, "u", "&amp;&bogus;")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(3))
    out = {r.page_id: r.text for r in html.extract(df).collect()}
    assert out[1] == "" and out[2] == "" and out[3] == "One.\nTwo" and out[None] == ""
    assert html.extract(df.limit(0)).count() == 0


def test_cut_is_the_minimum():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(1, 8)
        costs = [(rnd.random() * 3, rnd.random() * 3) for _ in range(n)]
        edges = [(a, b, rnd.random() * 2) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]
        price = lambda lab: (sum(c if x else b for x, (c, b) in zip(lab, costs))
                             + sum(w for a, b, w in edges if lab[a] != lab[b]))
        assert price(html.cut(costs, edges)) == pytest.approx(min(map(price, itertools.product([False, True], repeat=n))))


# ---------------------------------------------------------------- WARC

@pytest.mark.parametrize("min_bytes", [0, 4])
def test_warc_round_trip(spark, min_bytes):
    import base64
    import hashlib
    rows = [(5, "http://a/x y", "same page"), (2, "http://b", "same page"), (9, None, "same page"), (3, "u", None), (4, "u", ""), (6, "u\r\nX: 1", "abc"),
            (7, "u", "abc"), (8, "u", "é\r\n\r\n" * 5000), (None, "u", "same page"), (2, "http://b", "same page")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("_first", F.lit(1)).repartition(3)
    folder = scratch(spark, "warc-test")
    parts = warc.write(df, folder, min_bytes=min_bytes).collect()
    assert sum(r.n_records for r in parts) == len(rows)
    with open(parts[0].path, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.DICTIONARY_FRAME
    out = warc.read(spark, folder).collect()
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= min_bytes:
            first[t or ""] = min(i, first.get(t or "", i))
    want, got = [], []
    for i, _, t in rows:
        raw = (t or "").encode()
        again = i is not None and first.get(t or "", i) < i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                     first[t or ""] if again else None, None if again else raw))
    for r in out:
        got.append((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = scratch(spark, "warc-test")
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_archives_roll_at_a_size(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i % 7}</p>" * 200) for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    made = warc.write(df, str(tmp_path), archive_bytes=20_000).collect()
    assert len(made) > 3 and sum(r.n_records for r in made) == 301
    assert all(sum(map(len, warc.frames(open(r.path, "rb").read()))) < 24_000 for r in made)
    out = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.id, r.payload_bytes) for r in out if r.id is not None) == [(i, len(h)) for i, _, h in rows[:-1]]
    again = warc.write(df, str(tmp_path), archive_bytes=20_000).collect()  # a task that runs again
    assert sorted(r.path for r in again) == sorted(r.path for r in made) and warc.read(spark, f"file://{tmp_path}").count() == 301


def test_warc_frames_are_single_records(spark):
    records = [warc.record(i, "u", b"<p>%d</p>" % i * 20, None, warc.sha1_base32(b"<p>%d</p>" % i * 20)) for i in range(300)]
    raw = b"".join(warc.archive(iter(records), 3, 4096, 20_000))
    assert list(warc.frames(raw)) == records


# ---------------------------------------------------------------- vectors

def test_near_vectors_against_brute_force(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(150, 16))
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(base)]
    for i in range(150, 420):  # near copies, in chains
        v = np.array(rows[rnd.integers(0, i)][1]) + rnd.normal(size=16) * rnd.choice([0.0, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rnd.integers(0, 3)) if rnd.random() < 0.1 else rows[i % 150][2]))
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [None, 1.0], 1), (1004, [float("nan")] * 16, 1),
           (1005, [float("inf")] + [0.0] * 15, 1), (1006, rows[0][1], None), (None, rows[0][1], 0), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id bigint, embedding array<double>, label int").repartition(3).withColumn("n_links", F.lit(""))
    out = vectors.near_duplicates(df, block=32).collect()
    valid = [r for r in rows + rows[:1]] + odd[-2:]
    links, up = Counter(), {r[0]: r[0] for r in rows + odd if r[0] is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    pairs = found = 0
    got = {r.vec_id: r for r in out if r.vec_id is not None}
    for a, b in itertools.combinations(valid, 2):
        x, y = np.array(a[1]), np.array(b[1])
        if a[2] == b[2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links[a[0]] += 1
            links[b[0]] += 1
            u, v = sorted((top(a[0]), top(b[0])))
            up[v] = u
            pairs += 1
    assert len(out) == len(rows) + len(odd) + 1 and pairs > 100
    assert all(got[i].n_links <= links[i] for i in got)  # nothing below the threshold
    found = sum(r.n_links for r in out if r.vec_id is not None)
    assert found >= 0.97 * sum(links[r.vec_id] for r in out if r.vec_id is not None)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1007))
    assert [r.component_id for r in out if r.vec_id is None] == [None]
    assert got[1008].component_id == 1007 and got[1007].n_links == 1
    assert sum(got[i].component_id != top(i) for i in got) <= 0.03 * len(got)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_rare_links_across_cells_are_found(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(1500, 16))
    base /= np.sqrt((base ** 2).sum(1))[:, None]
    side = rnd.normal(size=(30, 16))
    side -= (side * base[:30]).sum(1)[:, None] * base[:30]
    side /= np.sqrt((side ** 2).sum(1))[:, None]
    every = np.concatenate([base, 0.935 * base[:30] + np.sqrt(1 - 0.935 ** 2) * side])
    link = every @ every.T >= 0.93
    np.fill_diagonal(link, False)
    tight = np.concatenate([every, base[99] + 1e-4 * rnd.normal(size=(700, 16))])  # a third of the rows in one group
    for rows, size in ((every, 1530), (tight, 2230)):
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, label int")
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, sample_queries=8, block=256).collect()}
        unit = rows / np.sqrt((rows ** 2).sum(1))[:, None]
        assert got == dict(enumerate(((unit @ unit.T >= 0.93).sum(1) - 1).tolist())) and len(got) == size
    assert link.sum() >= 60


def test_reach_holds_every_near_vector():
    rnd = np.random.default_rng(5)
    units = rnd.normal(size=(3000, 4))
    units /= np.sqrt((units ** 2).sum(1))[:, None]
    grid = vectors.Grid(units[:500], 8)
    cells = grid.cells(units)
    reach = grid.reach(units[:200], 0.93)
    for k, own in enumerate(reach):
        assert set(cells[units @ units[k] >= 0.93].tolist()) <= set(own)
    assert np.mean([len(x) for x in reach]) < grid.size / 2


def test_traversal_visits_nearest_cells_first():
    rnd = np.random.default_rng(1)
    grid = vectors.Grid(rnd.normal(size=(200, 6)), 5)
    units = rnd.normal(size=(20, 6))
    a, b = grid.distances(units)
    for k, cells in enumerate(grid.visits(units, 25)):
        total = (a[k][:, None] + b[k][None, :]).reshape(-1)
        assert sorted(cells) == list(range(25)) and np.all(np.diff(total[cells]) >= -1e-12)
        assert cells[0] == grid.cells(units[k:k + 1])[0]
