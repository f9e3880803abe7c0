"""Each operator against a plain version of itself, over odd rows: nulls, empty and very long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwright.llm import ball_tree, bestfit_pack, chat_windows, gam_quality, host_paths, kernel, label_shards, lang_svm, pivotal_mix, probminhash, weak_rules
from meshwright.llm.textstats import stats

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, u string, row string, nid string, size string, shard string, g string, _own string"


def _rows():
    rnd = random.Random(5)
    v = ["lo", "mer", "tin", "sa", "ke", "vor", "den", "ul", "pra", "os"]
    word = lambda: "".join(rnd.choice(v) for _ in range(rnd.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    long_text = text(9000)
    same = text(60)
    texts = [None, "", "  \n\t ", "a", "a b c", text(4), text(5), same, same, same, same + " " + text(2), long_text, long_text + " x", "é ß 漢字 😀 " * 30, "the | and ** && !!\n" * 40, "12345 678"]
    texts += [text(rnd.randint(5, 400)) for _ in range(60)]
    rows = [(i, t, ["en", "fr", "de", None][i % 4], ["b", "a", None, "é"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(7, same, "en", "a", 1), (7, same, "en", "a", 1), (None, "null id " * 20, "en", "a", 1), (None, None, None, None, None), (-5, text(30), "fr", "b", 1)]
    return [r + tuple("xxxxxxxx") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _shingles(t):
    w = _words(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_kernel_words_and_shingles():
    texts = ["a b  c\n", "", " a b c d e f g", "x", "a b c d e f g", "\u00a0 b\x0cc", "é\té"]
    w = kernel.words(pa.array(texts))
    assert w.counts().tolist() == [len(_words(t)) for t in texts]
    doc, s, times = kernel.shingles(w)
    assert [int(times[doc == i].sum()) for i in range(len(texts))] == [sum(_shingles(t).values()) for t in texts]
    assert set(s[doc == 2].tolist()) == set(s[doc == 4].tolist())
    assert [len(a) for _, a in kernel.pieces(pa.array(["x" * 10] * 7 + ["y" * 99, None]), 25)] == [2, 2, 2, 1, 1, 1] or sum(len(a) for _, a in kernel.pieces(pa.array(["x"] * 9), 2)) == 9


def _plain_counts(t):
    t = t or ""
    w = _words(t)
    lines = [x for x in t.split("\n") if _words(x)]
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


def test_text_counts():
    texts = [r[1] for r in _rows()] + ["a a a a a a a a a", "x\nx\n\nx y\nx", "l1\nl1", "a b c d e f g h\n" * 3, " x\nx"]
    got = stats(kernel.text_array(pa.array(texts)))
    for i, t in enumerate(texts):
        assert {k: int(got[k][i]) for k in _plain_counts(t)} == _plain_counts(t), t


def test_op10(spark, docs, none):
    got = weak_rules.judge(docs).collect()
    assert len(got) == len(_rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = weak_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert weak_rules.judge(none).count() == 0 and weak_rules.keep_good(none).count() == 0


def test_op10_em_finds_the_bad_class():
    rnd = np.random.default_rng(1)
    bad = rnd.random(4000) < 0.15
    votes = np.ones((4000, 6), int)
    for j in range(6):
        votes[bad & (rnd.random(4000) < 0.7), j] = 0
        votes[~bad & (rnd.random(4000) < 0.6), j] = 2
    p, n = np.unique(votes, axis=0, return_counts=True)
    prior, ratio = weak_rules.fit(p, n.astype(float))
    odds = prior + ratio[np.arange(6), votes].sum(1)
    assert ((odds < 0) == bad).mean() > 0.97
    clean = weak_rules.fit(np.array([[2, 1, 2], [1, 1, 1], [2, 2, 2]]), np.array([50.0, 10, 40]))
    assert clean[0] + clean[1][:, 1].sum() > 0  # a corpus without bad texts keeps texts on which all rules abstain


def test_op10_on_labels(spark):
    d, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    x = weak_rules.judge(d).where("not base_failed").join(labels, "doc_id").toPandas()
    assert x[x.quality == 1].kept.mean() > 0.98 and x[x.quality == 0].kept.mean() < 0.2


def test_op6(spark, docs, none):
    labels = spark.createDataFrame([(i, [0, 1, None][i % 3], 0, 9) for i in range(-5, 60)] + [(999, 1, 0, 9), (None, 1, 0, 9), (8, 1, 0, 9), (8, 0, 0, 9)], "doc_id long, quality int, toxic int, n_words int")
    got = gam_quality.classify(docs, labels).collect()
    assert len(got) == len(_rows())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert gam_quality.classify(none, labels).count() == 0
    assert {r["score"] for r in gam_quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_op6_held_out(spark):
    d, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    x = gam_quality.classify(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (x.predicted == x.quality).mean() > 0.95


def test_op9(spark, docs, none):
    got = lang_svm.identify(docs).collect()
    assert len(got) == len(_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == by[15]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert lang_svm.identify(none).count() == 0
    assert {r["lang_pred"] for r in lang_svm.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in lang_svm.identify(docs.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}
    assert lang_svm.keep_known(docs).columns == docs.columns


def test_op9_held_out(spark):
    d = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    x = lang_svm.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (x.lang_pred == x.lang).mean() > 0.97


def _page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_op1(spark):
    chrome = '<nav><ul><li><a href="/x">menu</a></li></ul></nav><header><h2>site</h2></header><aside>side bar words</aside><div class="ad">buy now</div><div id="cookie-notice">we use cookies</div><form><p>sign up</p></form>'
    tail = '<section class="comments"><article class="comment"><p>nice read, a long reader comment that goes on and on</p></article></section><footer>&copy; all</footer>'
    art = "<article><h1>Head &amp; more</h1><p>One\n two&nbsp;three<br>four<p>Open <b>bold <script>bad('</p>')</script>end<div class='promo'>ad</div><ul><li>x<li>y</ul></article>"
    want = "Head & more\nOne two three four\nOpen bold end\nx\ny"
    rows = [(i, f"https://h{i % 2}.example.com/{i}", _page(chrome + art + tail)) for i in range(6)]
    rows += [(90, None, None), (91, "http://h0.example.com/", ""), (92, "odd", "no markup at all"), (93, "http://H0.example.com:80/a", chrome + "<main><p>other layout</p></main>"), (94, "http://u@h1.example.com", "<article><p>cut off &am")]
    rows += [(0, "https://h0.example.com/0", _page(chrome + art + tail)), (None, "http://z/", "<div><p>" + "long " * 200_000 + "</p></div>")]
    rows = [r + ("t", 1, "k") for r in rows]
    got = host_paths.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, _key string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    for i in range(6):
        assert by[i]["text"] == want
    assert by[90]["text"] == by[91]["text"] == "" and by[92]["text"] == "no markup at all" and by[93]["text"] == "other layout" and by[94]["text"] == "cut off &am"
    assert by[None]["n_chars"] == 200_000 * 5 - 1
    assert host_paths.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op1_consensus(spark):
    """The host's path leaves out what no class or tag marks, even on a page where that is longer than the article."""
    def page(i, extra):
        return _page(f'<div class="k7">{extra}</div><div class="story s{i}"><h1>Title {i}</h1><p>{"words of the story " * 20}</p></div><div class="k9"><p>{extra}</p></div>')

    rows = [(i, f"https://h.example.com/{i}", page(i, "plain matter")) for i in range(8)] + [(8, "https://h.example.com/8", page(8, "plain matter " * 100))]
    rows += [(9, "https://h.example.com/9", _page("<section><p>another layout here</p></section>"))]
    by = {r["page_id"]: r["text"] for r in host_paths.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert by[i] == f"Title {i}\n" + ("words of the story " * 20).strip()
    assert by[9] == "another layout here"
    assert host_paths.vote(page(1, "plain matter")) == "/div.s#.story" and host_paths.vote("") is None


def test_op1_on_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in host_paths.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def _plain_classes(rows, least=0.8):
    keys = [None if r[1] is None or not _words(r[1]) else frozenset(_shingles(r[1])) for r in rows]
    sets = [probminhash._sets(pa.array([r[1] or ""]))[0] for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if keys[i] and keys[j] and (rows[i][1] == rows[j][1] or probminhash.similarity(sets[i], sets[j]) >= least):
                up[find(i)] = find(j)
    group = collections.defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(i)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[k][0] for k in group[find(i)] if rows[k][0] is not None]
        out.append((r[0], min(ids) if ids and keys[i] else r[0]))
    return collections.Counter(out), len(group), sum(k is None for k in keys)


def _near_rows():
    rnd = random.Random(3)
    v = [f"w{i}" for i in range(3000)]
    doc = lambda n: [rnd.choice(v) for _ in range(n)]
    texts = []
    for g in range(6):
        base = doc(rnd.choice([60, 150]))
        base = base[:40] * 3 + base if g % 3 == 0 else base
        texts.append(base)
        for _ in range(20):
            x = list(base)
            for _ in range(rnd.randint(0, 9)):
                x[rnd.randrange(len(x))] = rnd.choice(v)
            texts.append(x)
    common = doc(80)
    texts += [doc(30) + common + doc(25) for _ in range(30)] + [doc(rnd.randint(0, 7)) for _ in range(15)]
    texts = [" ".join(t) for t in texts] + ["a b", "a b", "", " ", None]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1024, 6])
def test_op2(spark, block):
    rows = _near_rows()
    got = probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), block).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == _plain_classes(rows)[0]


def test_op2_odd_rows(spark, docs, none):
    rows = _rows()
    got = probminhash.classes(docs).collect()
    want, groups, bare = _plain_classes(rows)
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == want
    kept = probminhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert probminhash.classes(none).count() == 0 and probminhash.keep_one(none).count() == 0


def test_op2_bands_shared_by_chance():
    """A pair whose registers agree by a byte in a band that they don't share is still compared in the first band that they do."""
    sets = [(np.arange(10, dtype=np.uint64), np.ones(10))] * 2
    marks = np.arange(2 * probminhash.BANDS, dtype=np.uint32).reshape(2, -1)
    marks[1, 3] = marks[0, 3]
    two = np.array([1, 2])
    linked = lambda band: probminhash._linked(two, two, np.array([10, 10]), np.zeros(2), np.zeros((2, probminhash.REGISTERS), np.uint8), marks, np.zeros(2, int), (band, -1), 0, 0, sets, 0.8)
    assert linked(3) == [(1, 2)] and linked(0) == linked(5) == []


def test_op2_probability_jaccard():
    def plain(a, b):
        a, b = ({k: 1 + np.log(n) for k, n in _shingles(t).items()} for t in (a, b))
        p = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a.keys() & b.keys())
        return max(p, len(a.keys() & b.keys()) / len(a.keys() | b.keys()))

    texts = [r[1] for r in _near_rows() if _words(r[1])][:25] + ["x y z v w " * 9 + "q", "x y z v w " * 5 + "q r"]
    sets = probminhash._sets(pa.array(texts))
    for i in range(len(texts)):
        for j in range(i):
            assert abs(plain(texts[i], texts[j]) - probminhash.similarity(sets[i], sets[j])) < 1e-9
    doc, s, times = kernel.shingles(kernel.words(pa.array(texts)))
    won = probminhash.registers(doc, s, 1 + np.log(times), len(texts), 2048)
    assert (won != 0).all()
    worst = max(abs((won[i] == won[j]).mean() - probminhash.similarity(sets[i], sets[j])) for i in range(10) for j in range(i))
    assert worst < 0.08


def test_op3(spark):
    rows = [(1, 0, "system", "S <s> x"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "[\\INST] \\[/OUT] </s> [\\\\INST]"), (1, 2, "assistant", "same turn"), (2, 0, "assistant", None), (2, None, None, "["), (2, 5, "tool ]", "r [/ROLE]"), (None, 0, "user", "null id"),
            (3, 0, "user", "dup"), (3, 0, "user", "dup"), (4, 0, "system", "rule " * 30)] + [(4, i, ("user", "assistant")[(i - 1) % 2], f"w{i} " * (150 if i != 6 else 5000)) for i in range(1, 14)]
    df = spark.createDataFrame([r + ("x", 2) for r in rows], "conv_id long, turn long, role string, text string, t string, window int")
    win = chat_windows.format_windows(df, 600, 100)
    got = {r["conv_id"]: r for r in chat_windows.read_back(win).collect()}
    assert len(got) == len({r[0] for r in rows})
    for k, r in got.items():
        own = sorted(((-1 if t is None else t, o or "", x or "") for c, t, o, x in rows if c == k))
        said = "".join(f"{o}\n{x}\n" for _, o, x in own)
        loss = "".join(x for _, o, x in own if o == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = win.where("conv_id = 4").orderBy("window").collect()
    assert len(w) > 3 and all(x["formatted"].startswith("<s>[SYS]rule") for x in w)
    assert [x["over"] for x in w].count(True) == 1 and all(x["n_tokens"] <= 600 for x in w if not x["over"])
    assert sum(len(x["spans"]) for x in w) == 6 and w[0]["n_repeated"] == 0 and all(x["n_repeated"] >= 1 for x in w[1:])
    assert chat_windows.read_back(chat_windows.format_windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_op3_windows_of_split_conversations(spark, block):
    """Spans, repeated turns and budgets against a plain reading, for a conversation in one block and in many."""
    rnd = random.Random(8)
    rows = []
    for c, n in ((1, 60), (2, 45), (None, 30), (3, 1), (4, 7)):
        at = 0
        for i in range(n):
            at += rnd.choice([1, 1, 1, 9])
            system = i == 0 and c in (1, 3, None)
            rows.append((c, None if i == 0 and c == 2 else at, "system" if system else ("user", "assistant")[i % 2], " ".join(f"c{i}x{k}" for k in range(rnd.choice([3, 10, 18, 70])))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    budget, history = 120, 30
    win = chat_windows.format_windows(df, budget, history, block=block)
    got = collections.defaultdict(list)
    for r in win.orderBy("window").collect():
        got[r["conv_id"]].append(r)
    tokens = lambda x: len(x.split()) + 2
    for c in {r[0] for r in rows}:
        turns = [r[3] for r in rows if r[0] == c]
        system = c in (1, 3, None)
        done = 0
        assert block == 1 or len(got[c]) < len(turns) or len(turns) == 1
        for k, w in enumerate(got[c]):
            shown = [x.strip() for x in re.split(r"<s>|\[/?(?:SYS|INST|OUT)\]|</s>", w["formatted"]) if x.strip()]
            again, new = shown[: w["n_repeated"]], shown[w["n_repeated"] :]
            assert new and new == turns[done : done + len(new)]
            want = []
            for x in reversed(turns[1 if system else 0 : done]):
                if sum(map(tokens, [*want, x])) > history:
                    break
                want.insert(0, x)
            assert again == (turns[:1] if system and k else []) + want
            total = sum(map(tokens, shown))
            assert w["n_tokens"] == total and w["over"] == (total > budget) and (total <= budget or len(new) == 1)
            done += len(new)
        assert done == len(turns)
    digest = lambda w: sorted(map(repr, chat_windows.read_back(w).drop("formatted_chars").collect()))
    assert digest(win) == digest(chat_windows.format_windows(df, budget, history))


@pytest.mark.parametrize("shard", [8192, 70])
def test_op4(spark, shard):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=6).round(1)], 1) for i in range(300)]
    rows += [(i, [0.5] * 6, 1) for i in range(300, 340)] + [(350, None, 1), (400, [1.0, None] * 3, 1), (450, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 1), (None, [0.1] * 6, 1), (100, [9.0] * 6, 1), (550, [1.0, 2.0], 1), (551, [1.0, 1.0], 1), (600, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in ball_tree.top_k(df, shard=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for i, v in ok:
        if i % 50 == 0:
            hits = sorted((-int(v @ x), j) for j, x in ok if j != i and len(x) == len(v))
            want[i] += [(j, -s) for s, j in hits[:5]]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert ball_tree.top_k(df.limit(0)).count() == 0


def test_op5(spark, docs, none):
    rows = _rows() + [(1000 + i, "a hot text", "en", "a", 1) + tuple("xxxxxxxx") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = label_shards.assign(df).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    n = got.groupby("shard").size()
    assert len(n) == 16 and n.max() - n.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = collections.Counter((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter(zip(got["size"], got.text_crc32)) == want
    hot = got[got.text_crc32 == zlib.crc32(b"a hot text")].shard.nunique()
    assert hot <= 11 and label_shards.assign(none).count() == 0


@pytest.mark.parametrize("chunk", [128, 4])
def test_op8(spark, docs, none, chunk):
    rows = _rows()
    a, b = (pivotal_mix.mix(docs, chunk=chunk).orderBy("doc_id", "size", "taken").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == len(rows)
    size = collections.defaultdict(int)
    for r in rows:
        size[r[3]] += len(_words(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    assert sorted(a.target.round(6).unique()) == sorted({round(t, 6) for t in target.values()})
    assert (a.taken <= 2 * a["size"]).all() and (a.taken[a["size"] > 0] % a["size"][a["size"] > 0] == 0).all()
    for s in names:
        own = a[np.isclose(a.target, target[s])]
        assert abs(own.taken.sum() - target[s]) <= own["size"].max()
    copies = pivotal_mix.repeat(docs)
    assert copies.columns == docs.columns and sum(len(_words(r["text"])) for r in copies.collect()) == pivotal_mix.mix(docs).agg(F.sum("taken")).first()[0]
    assert pivotal_mix.mix(none).count() == 0 and pivotal_mix.repeat(none).count() == 0


def test_op8_keeps_expectations(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    got = pivotal_mix.mix(df, chunk=16).toPandas()
    for (t, _), g in got.groupby(["target", "source_size"]):
        assert abs(g.taken.sum() - t) <= 40
    assert got.copies.nunique() >= 2


def _best(lengths, c):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b + x <= c]
        if fit:
            m = max(fit)
            bins[bins.index(m)] = m + x
        else:
            bins.append(x)
    return len(bins)


def test_op7_best_fit_and_bounds():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        x = rnd.integers(1, 100, rnd.integers(1, 80))
        k, at = bestfit_pack.best_fit(x, 100)
        assert k.max() + 1 == _best(x.tolist(), 100) >= bestfit_pack.lower_bound(x, 100)
        for b in range(k.max() + 1):
            own = sorted(zip(at[k == b], x[k == b]))
            assert own[0][0] == 0 and all(p + n == q for (p, n), (q, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 100
    assert bestfit_pack.lower_bound(np.array([51] * 7), 100) == 7 and bestfit_pack.lower_bound(np.array([34] * 6 + [60]), 100) >= 3


def test_op7(spark, docs, none):
    from tokenizers import Tokenizer

    rows = _rows() + [(5000, "it's <|endoftext|> x", "en", "a", 1) + tuple("xxxxxxxx"), (5001, "İstanbul ΑΣ ﬁ e\u0301 a\u0085b ½", "en", "a", 1) + tuple("xxxxxxxx")]
    tok = Tokenizer.from_file(bestfit_pack.default_tokenizer())
    want = collections.Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            want[r[0], p, s, len(part), zlib.crc32(part.tobytes())] += 1
    got = bestfit_pack.pack(spark.createDataFrame(rows, SCHEMA), group=30).toPandas()
    assert collections.Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None).itertuples(index=False, name=None))) == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= bestfit_pack.lower_bound(got.length.to_numpy()) + 3
    assert bestfit_pack.pack(none).count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "mixing", "packing"]
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, pipeline.cut(stage(spark, kept, DATA))
        assert kept.columns == docs.columns
        assert kept.exceptAll(before).isEmpty() if name != "mixing" else kept.distinct().exceptAll(before).isEmpty()
        if name == "quality_rules":
            good = weak_rules.judge(docs).where("kept").select("doc_id")
            assert sorted(r[0] for r in good.collect()) == sorted(r[0] for r in kept.select("doc_id").collect())
    done = pipeline.run(spark, DATA).toPandas()
    assert sorted(done.doc_id.unique()) == sorted(r[0] for r in kept.select("doc_id").distinct().collect())
    assert done.groupby("sequence_id").length.sum().max() <= 2048
