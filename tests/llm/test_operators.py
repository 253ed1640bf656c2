"""Corpus operators against brute force, held-out accuracy and edge cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontaminate, html, jaccard, language, lm, mixing, topk, toxicity, urls
from loomgraph.llm.common import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOICES = {"en": "the of and to in that is was for with this have from not".split(), "de": "der die und das nicht mit sich auf eine für den von ist ein".split(), "fr": "le la les des une est dans que pour qui sur avec pas par".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang]) + rng.choice(["", "ing", "ung", "eux", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = rng.choice(list(VOICES))
        rows.append((i, sentence(rng, lang, rng.randrange(20, 90)), lang, f"s{min(3, rng.randrange(9))}", 0))
    rows += [(500, None, "en", None, 0), (501, "", None, "s0", 0), (502, "12 34 !!", "en", "s0", 0), (503, "the " * 40_000, "en", "s1", 0), (3, rows[3][1], rows[3][2], "s2", 0), (504, rows[7][1], "en", "s1", 0), (None, rows[9][1], None, "s1", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_language(docs, none):
    model = language.fit(docs, F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False)))
    got = language.identify(docs, model, keep=["doc_id", "lang"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (500, 501, 502):
            assert r["lang_pred"] == "und"
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert language.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None, keep=["doc_id"]).collect()} == {"und"}
    assert language.identify(none, model, keep=["doc_id"]).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = sentence(rng, "en", 60).split()
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["grumbolt", "vilefoot", "snarkgob"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab, F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False)))
    got = {r["doc_id"]: r for r in toxicity.score(d, model, keep=["doc_id"]).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model, keep=["doc_id"]).collect())
    assert toxicity.fit(none, lab, F.lit(True)) is None and toxicity.score(none, model, keep=["doc_id"]).count() == 0
    assert {r["score"] for r in toxicity.score(d, None, keep=["doc_id"]).collect()} == {0.0}


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "/", "block"), ("a.b", "/x", "allow"), ("c.a.b", "/x/y", "block"), ("b", "/", "allow")]


def judged(u):
    host = path = ""
    if u and "://" in u:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fit = [(len(a + b), len(a), v == "block", a + b, v) for a, b, v in RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_url_rules(spark):
    rng = random.Random(1)
    pages = [None, "", "nourl", "http://a.b", "http://z.a.b/x/y", "http://xa.b/", "http:///q", "http://..b/", "x://y://com/", "http://com0/en/", "a\nb://net/es/1", "http://é.a.b/x"]
    pages += ["http://" + ".".join(rng.choice(["a", "b", "c", "WWW", "example", "x"]) for _ in range(rng.randrange(3))) + rng.choice(["", ".com", ".net", ".a.b"]) + rng.choice(["", "/", "/en/1", "/es/", "/x/y?z", "/x#y"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit("clash")})
    rules = spark.createDataFrame([*RULES, RULES[0], ("net", None, "block")], "host string, path string, verdict string")
    got = {r[0]: tuple(r)[1:] for r in urls.judge(df, rules, keep=["page_id"]).collect()}
    assert got == {i: judged(u) for i, u in enumerate(pages)}
    assert urls.judge(df.limit(0), rules, keep=["page_id"]).count() == 0
    assert {r["verdict"] for r in urls.judge(df, rules.limit(0), keep=["page_id"]).collect()} == {"allow"}
    assert "Python" not in (p := urls.judge(df, rules, keep=["page_id"]))._jdf.queryExecution().toString() and "Arrow" not in p._jdf.queryExecution().toString()


def sets_of(rows, n):
    out = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def brute_classes(rows, n, num, den):
    sets = sets_of(rows, n)
    parent = {i: i for i, _ in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b) and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_jaccard(spark, n, num, den):
    rng = random.Random(n)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 160))] for _ in range(12)]
    rows = []
    for i in range(130):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice("klmno")
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a"), (203, "A"), (204, "a b"), (205, "x " * 3000)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)), n=n, num=num, den=den).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows, n, num, den)


def test_jaccard_edges(spark, none):
    assert jaccard.classes(none).count() == 0
    d = spark.createDataFrame([(5, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (None, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.classes(d).collect()), key=str) == sorted([(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, 5), (None, 1, None)], key=str)


def test_block_links_match_brute_force():
    rng = np.random.default_rng(3)
    leader = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([leader[rng.random(60) > rng.choice([0.02, 0.2])], rng.integers(100, 140, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
    aparts = [np.setxor1d(leader, s).astype(np.uint64).tobytes() for s in sets]
    found = jaccard.block_links(list(range(40)), list(range(40)), [len(s) for s in sets], aparts, 4, 5)
    links = [(i, j) for i, j in itertools.combinations(range(40), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]

    def groups(pairs):
        parent = list(range(40))

        def root(i):
            return i if parent[i] == i else root(parent[i])

        for i, j in pairs:
            parent[max(root(i), root(j))] = min(root(i), root(j))
        return [root(i) for i in range(40)]

    assert set(found) <= set(links) and groups(found) == groups(links)


def test_decontamination(spark, none):
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, "a b c d e f g")], "item_id long, text string")
    noise = lambda k: " ".join(f"n{rng.randrange(10**6)}" for _ in range(k))
    moved = " ".join(item[20:]) + " " + noise(9) + " " + " ".join(item[:20])
    rows = [(10, noise(30) + " " + " ".join(item).upper() + ", " + noise(5)), (11, moved), (12, noise(80)), (13, " ".join(item[:10])), (14, None), (15, " ".join(item[:24])), (15, " ".join(item[:24]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["covered"]) for r in decontaminate.leaks(d, bench).collect()}
    assert got == {10: (1, 40), 11: (1, 40), 15: (1, 24)}
    assert decontaminate.leaks(d, bench).count() == 4
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(d, bench.limit(0)).count() == 0
    assert decontaminate.tiles([(0, 0), (1, 1), (2, 2), (9, 1)], 5) == [(0, 0, 7)]


def test_mixing(docs, none):
    got = mixing.mix(docs, max_repeats=1.5).collect()
    tokens = {}
    for r in docs.collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + len((r["text"] or "").encode().split())
    a = mixing.exponent_for(tokens, target_entropy=None, max_repeats=1.5, budget=None)
    w = mixing.weights(tokens, a)
    total = mixing.budget_for(tokens, w, None)
    assert mixing.repeats(tokens, w, None) <= 1.5 + 1e-9
    longest = max(len((r["text"] or "").split()) for r in docs.collect())
    for s, x in w.items():
        read = sum(r["n_tokens"] for r in got if r["source"] == s)
        assert 0 <= round(x * total) - read <= longest
    assert abs(mixing.entropy(mixing.weights(tokens, mixing.exponent_for(tokens, target_entropy=1.0, max_repeats=None, budget=None))) - 1.0) < 1e-6
    assert mixing.mix(none).count() == 0
    half = sum(tokens.values()) // 2
    assert sum(r["n_tokens"] for r in mixing.mix(docs, max_repeats=None, budget=half).collect()) <= half + len(tokens)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(5, 16))
    v = (centers[rng.integers(0, 5, 400)] + 0.3 * rng.normal(size=(400, 16))).astype(np.float32)
    v[100] = v[7]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(400)] + [(900, None, 0), (950, [1.0, None], 0), (1000, [float("nan")] * 16, 0), (1050, [1.0, 2.0], 0), (1100, [], 0), (None, [1.0] * 16, 0), (1150, [3e9, 1.0], 0), (1200, [1e18, 1e18], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    ints = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * min(max(b, -(2**62)), 2**62) for a, b in zip(ints[q], ints[c], strict=True)))), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s[:5])]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "bot", "> How are you?\nFine!\n> > nested nothing\n> hello THERE"), (1, 2, "user", "> Fine!\n>> how are you\nGood"), (2, 0, "user", "x"), (2, 1, "user", ">Good\nyes"), (3, 0, None, None), (None, 1, "user", "> x"), (4, 5, "user", "> later\nself")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth__", F.lit(0))).collect()}
    reply = {k: (r["reply_conv"], r["reply_turn"], r["thread_conv"], r["thread_turn"], r["depth"]) for k, r in got.items()}
    assert reply[1, 1] == (1, 0, 1, 0, 1) and reply[1, 2] == (1, 1, 1, 0, 2) and reply[2, 1] == (1, 2, 1, 0, 3)
    assert reply[4, 5] == (None, None, 4, 5, 0) and got[1, 1]["text"] == "Fine!" and got[1, 1]["quote_level"] == 2 and got[3, 0]["text"] == ""
    assert len(got) == len(rows)
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy now, really, now.</div>
    <article><h1>A &amp; B</h1><p>First, a  long\n sentence here; with marks.<p><b>Second <i>one</b></i>, also long enough to count.<br>Same block.</p>
    <div class="notice">Cookies!</div><aside>Side, note.</aside><ul><li>item one, and more text.</li></ul></article>
    <section id=comments><p>A reader says, hm, what a long comment, indeed.</p></section><footer>&copy; x</footer></body></html>"""
    assert html.extract(page).split("\n") == ["A & B", "First, a long sentence here; with marks.", "Second one, also long enough to count. Same block.", "item one, and more text."]
    assert html.extract(None) == html.extract("") == html.extract("<p></p><br>") == ""
    assert html.extract("plain text, no tags") == "plain text, no tags"
    assert html.extract("<p>" * 3000 + "deep, text.") == "deep, text."
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (1, "u", page)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["n_chars"]) for r in html.extract_pages(df, keep=["page_id", "url"]).collect())
    assert got[0] == got[1] and got[2] == (2, 0)


def test_lm(spark, docs, none):
    rest = remainder(F.col("doc_id"), 5)
    learn = F.coalesce(rest != 1, F.lit(False))
    got = lm.score(docs, learn, rest == 1).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    count, total = {}, 0
    for r in rows:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            for w in tok(r["text"]):
                count[w], total = count.get(w, 0) + 1, total + 1
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        w = tok(text[r["doc_id"]])
        base = sum(math.log10((count.get(x, 0) + 0.5) / (total + 0.5 * (len(count) + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] < 0
    assert lm.score(none, learn, rest == 1).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    stages = {}
    docs = spark.read.parquet(f"{src}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, src)
        out.write.parquet(str(tmp_path / name))
        was, docs = docs, spark.read.parquet(str(tmp_path / name))
        stages[name] = (was, docs)
    for name, (was, now) in list(stages.items())[:-1]:
        assert now.columns == was.columns
        assert {r[0] for r in now.select("doc_id").collect()} <= {r[0] for r in was.select("doc_id").collect()}
    was, now = stages["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in was.collect()]
    assert {r["doc_id"] for r in now.collect()} == {c for _, _, c in brute_classes(rows, 5, 4, 5)}
    assert sorted(tuple(r)[0] for r in corpus_pipeline.run(spark, src).select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
