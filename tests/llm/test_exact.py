"""What must not rest on hashes, caps or the shape of the input: look-alike words, equal rows, outlying numbers, deep pages, located shards."""

import collections
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwright.llm import ball_tree, bestfit_pack, chat_windows, gam_quality, host_paths, kernel, lang_svm, pivotal_mix, probminhash, weak_rules
from meshwright.llm.textstats import stats


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def _other(t):
    return t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_look_alike_words(n):
    a = _thue_morse(n)
    b = _other(a)
    w = kernel.words(pa.array([f"{a} {b} {a}"]))
    assert w.ids()[0].tolist() == [0, 1, 0] and len(set(w.hashes().tolist())) == 2
    seven = " x1 x2 x3 x4 x5 x6 x7 "
    texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", f"{a}{seven}{b}{seven}", f"{a}{seven}{a}{seven}"]
    got = stats(pa.array(texts))
    assert got["n_dup_lines"].tolist() == [0, 1, 0, 0] and got["n_distinct"].tolist() == [2, 2, 9, 8]
    assert got["n_repeat_words"].tolist() == [0, 0, 0, 16] and got["n_same_next"].tolist() == [0, 0, 0, 0]
    coder = bestfit_pack.Coder(bestfit_pack.default_tokenizer())
    ids, bound = coder.encode(pa.array([a, b, f"{b} {a}"]))
    for k, t in enumerate((a, b, f"{b} {a}")):
        assert ids[bound[k] : bound[k + 1]].tolist() == [*coder.tok.encode(t, add_special_tokens=False).ids, 0]


def test_window_sums_that_agree(monkeypatch):
    """Windows whose sums agree by chance are told apart by their words."""
    monkeypatch.setattr(kernel, "mix", lambda x: x * kernel.U(0) + kernel.U(1))
    words = [f"v{i}" for i in range(8)]
    twice = " ".join([*words, "z", *words])
    assert stats(pa.array([" ".join([*words, *reversed(words)]), twice]))["n_repeat_words"].tolist() == [0, 16]


def test_other_tokenizers_go_by_whole_texts():
    from public_tokenizers import path

    coder = bestfit_pack.Coder(path("byte_bpe_50k.json"))
    assert not coder.by_word
    texts = ["It's  two\n\nlines, <|endoftext|> x", "", "é 漢字"]
    ids, bound = coder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bound[k] : bound[k + 1]].tolist() == [*coder.tok.encode(t, add_special_tokens=False).ids, 0]


def test_words_that_the_cache_forgets(monkeypatch):
    monkeypatch.setattr(bestfit_pack, "CACHE", 40)
    coder, rnd = bestfit_pack.Coder(bestfit_pack.default_tokenizer()), random.Random(3)
    for _ in range(60):
        texts = [" ".join(rnd.choice(["often", "seen", f"rare{rnd.randrange(900)}", f"x{rnd.randrange(30)}"]) for _ in range(12)) for _ in range(3)]
        ids, bound = coder.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[bound[k] : bound[k + 1]].tolist() == [*coder.tok.encode(t, add_special_tokens=False).ids, 0]
    assert len(coder.before) + len(coder.known) < 120


def test_long_text_in_pieces_of_its_own():
    rnd = random.Random(1)
    t = " ".join(rnd.choice(["lo", "mer", "tin", "sa"]) + str(rnd.randrange(5000)) for _ in range(400_000))
    assert len(t) > kernel.PIECE
    got = stats(pa.array([t]))
    words = t.split()
    win = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    assert got["n_words"][0] == len(words) and got["n_distinct"][0] == len(set(words)) and got["n_repeat_words"][0] == sum(v > 1 for v in win.values()) * 0
    x, letter = lang_svm.grams(pa.array([t]))
    assert letter[0] and abs(float((x**2).sum()) - 1) < 1e-4


def test_equal_rows_are_mixed_by_count(spark):
    """100,000 equal rows take about as long as different ones, and keep their source on its target."""
    n, took = 100_000, {}
    for kind in ("different", "equal"):
        own = F.lit(5).cast("long") if kind == "equal" else F.col("id") + 1000
        d = spark.range(n).select(own.alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("hot").alias("source"))
        for k, s in enumerate(("x", "y", None)):
            d = d.unionByName(spark.range(20_000).select((F.col("id") + (k + 1) * 10**7).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.lit(s).cast("string").alias("source")))
        began = time.time()
        got = pivotal_mix.mix(d).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
        took[kind] = time.time() - began
        assert sum(r["n"] for r in got) == n + 60_000 and all(abs(r["taken"] - r["target"] * (3 if r["n"] == 60_000 else 1)) <= 27 and r["most"] <= 2 for r in got)  # three sources are alike
    assert took["equal"] < 2 * took["different"] + 10


def test_equal_rows_are_repeated_evenly(spark):
    rows = [(1, "a b", "s", i // 50) for i in range(200)] + [(2, "c d", "t", 0)] * 7 + [(k, f"e {k}", "t", k) for k in range(3, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    a, b = (collections.Counter(map(tuple, pivotal_mix.repeat(d).collect())) for _ in range(2))
    assert a == b and set(a) <= set(rows)
    copies = [a[1, "a b", "s", e] for e in range(4)]
    taken = pivotal_mix.mix(d).where("doc_id = 1").agg(F.sum("copies")).first()[0]
    assert sum(copies) == taken and all(50 * (taken // 200) <= c <= 50 * (taken // 200 + 1) for c in copies)


def test_pairs_are_rounded_without_bias(spark):
    """The fold against what it must keep: whole copies, mass but for the last document's, and each document's expectation over seeds."""
    share, seeds = 0.37, 300
    d = spark.createDataFrame([(seed, i, 3 + i % 5, 1, 0, share) for seed in range(seeds) for i in range(12)], "source int, doc_id long, size long, rows long, more long, f double")
    unit = F.struct("size", F.xxhash64("doc_id", "source").alias("u"), "doc_id", "rows", "more", "f").cast(pivotal_mix._UNIT).alias("unit")
    ups = collections.Counter()
    for r in pivotal_mix._level(d.select("source", F.lit(0).alias("chunk"), unit)).collect():
        s = r["s"]
        assert {x["f"] for x in s["out"]} <= {0.0, 1.0} and len(s["out"]) == 11 and 0 <= s["c"]["f"] <= 1
        mass = sum(x["size"] * x["f"] for x in s["out"]) + s["c"]["size"] * s["c"]["f"]
        assert abs(mass - share * sum(3 + i % 5 for i in range(12))) < 1e-9
        for x in [*s["out"], s["c"]]:
            ups[x["doc_id"]] += x["f"]
    assert all(abs(v / seeds - share) < 4.5 * math.sqrt(share * (1 - share) / seeds) for v in ups.values())


def test_one_outlying_turn(spark):
    """A conversation's blocks go by places, not by numbers."""
    n = 20_000
    d = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.when(F.col("id") == n - 1, 10**12).otherwise(F.col("id")).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    d = d.unionByName(d.where("turn < 9").withColumn("conv_id", F.lit(None).cast("long")))
    turns = chat_windows._blocks(d.select(F.struct("conv_id").alias("key"), "turn", "role", F.col("text").alias("own")), 4096)
    sizes = [r["count"] for r in turns.where("key.conv_id = 1").groupBy("block").count().orderBy("block").collect()]
    assert sizes == [4096] * 4 + [n - 4 * 4096]
    same = spark.range(9000).select(F.lit(2).cast("long").alias("conv_id"), F.lit(3).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("one text").alias("text"))
    got = chat_windows.read_back(chat_windows.format_windows(d.unionByName(same))).collect()
    assert {r["conv_id"]: r["n_turns"] for r in got} == {1: n, None: 9, 2: 9000}


def test_deep_and_wide_pages():
    deep = "<div class='a'>" * 100_000 + "<p>deep words here</p>"
    began = time.time()
    path = host_paths.vote(deep)
    assert path == "/div.a" * 100_000 and host_paths.extract(deep, path) == "deep words here"
    wide = "<body>" + "<div class='s'><p>some words of a section</p></div>" * 30_000
    assert host_paths.vote(wide) == "/div.s" and host_paths.extract(wide, "/div.s").count("\n") == 29_999
    tangled = "<i><p>x</p>" * 30_000 + "</b>" * 30_000 + "<p>y" * 30_000
    assert host_paths.extract(tangled, None).count("x") == 30_000
    assert time.time() - began < 60


def test_title_beside_the_main_text():
    page = "<body><h1>Site</h1><div id='w'><h1 class='t'>Title</h1><div class='c'><p>" + "text " * 40 + "</p></div><h1>later</h1></div></body>"
    assert host_paths.extract(page, host_paths.vote(page)).split("\n") == ["Site", "Title", ("text " * 40).strip()]
    own = "<body><h1>Site</h1><div class='c'><h1>Own</h1><p>" + "text " * 40 + "</p></div></body>"
    assert host_paths.extract(own, "/div.c").split("\n")[0] == "Own"


def test_clustered_vectors_visit_few_cells(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(16, 8))
    x = centres[rnd.integers(0, 16, 8000)] + rnd.normal(size=(8000, 8)) * 0.02
    x[3000:5600] = x[7]  # a third are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    report = []
    got = collections.defaultdict(list)
    for r in ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=100, report=report).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    v = np.floor(x * 256).astype(np.int64)
    for q in range(0, 8000, 50):
        s = v @ v[q]
        assert got[q] == sorted((-int(s[i]), i) for i in range(8000) if i != q)[:5]
    assert sum(report) < 0.5 * 160 * 80  # pairs of a query and a hundred vectors


def test_components_too_large_for_exact_scores(spark):
    with pytest.raises(Exception, match="too large"):
        ball_tree.top_k(spark.createDataFrame([(0, [1e15]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    got = ball_tree.top_k(spark.createDataFrame([(0, [1e7, 3.0]), (1, [1e7, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["score"] for r in got] == [2_560_000_000**2 + 768 * 256]


def test_texts_that_share_a_hash(spark, monkeypatch):
    """Different texts with one first hash are numbered anew, so none is lost."""
    monkeypatch.setattr(probminhash, "_first", lambda t: F.length(t).cast("long"))
    rnd = random.Random(4)
    text = lambda: " ".join(f"w{rnd.randrange(10, 99)}" for _ in range(12))
    rows = [(i, text()) for i in range(20)] + [(20, "w10 " * 3), (21, None)]
    rows += [(30 + i, rows[i][1]) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in probminhash.classes(d).collect()} == {i: i - 30 if i >= 30 else i for i, _ in rows}
    assert probminhash.keep_one(d).count() == 22


def test_many_alike_texts(spark):
    """Thousands of texts that differ from one another in few words, in time near that of as many different ones."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(3000)}" for _ in range(120)]

    def like(k):
        x = list(base)
        x[rnd.randrange(120)] = f"own{k}"
        return " ".join(x)

    d = spark.createDataFrame([(k, like(k)) for k in range(20_000)], "doc_id long, text string").repartition(8)
    began = time.time()
    got = probminhash.classes(d).groupBy("class_id").count().collect()
    assert [(r["class_id"], r["count"]) for r in got] == [(0, 20_000)] and time.time() - began < 180


def test_recall_by_similarity(spark):
    """Planted copies with more and more changes: of the pairs at 0.8 and more, nearly all are found; of those below 0.75 none."""
    rnd = random.Random(9)
    rows, pairs = [], []
    for g in range(400):
        base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        copy = list(base)
        for _ in range(g % 9):
            copy[rnd.randrange(150)] = f"n{rnd.randrange(10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        pairs.append(probminhash.similarity(*probminhash._sets(pa.array([rows[-2][1], rows[-1][1]]))))
    found = {r["doc_id"]: r["class_id"] for r in probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = np.array([found[2 * g + 1] == 2 * g for g in range(400)])
    at = np.array(pairs)
    assert (at >= 0.8).sum() > 80 and hit[at >= 0.8].mean() >= 0.99 and not hit[at < 0.8].any()


def test_recall_by_plain_similarity(spark):
    """Copies with a passage pasted in many more times: alike by plain Jaccard alone, as the weights of the passage differ."""
    rnd = random.Random(12)
    rows, plain, weighted = [], [], []
    for g in range(600):
        base = [f"w{rnd.randrange(5000)}" for _ in range(104)]
        copy = list(base)
        for _ in range(g % 3):
            copy[rnd.randrange(50, 104)] = f"n{rnd.randrange(10**6)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy[:30] * 60 + copy))]
        a, b = (dict(zip(s.tolist(), w)) for s, w in probminhash._sets(pa.array([rows[-2][1], rows[-1][1]])))
        plain.append(len(a.keys() & b.keys()) / len(a.keys() | b.keys()))
        weighted.append(sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a.keys() & b.keys()))
    found = {r["doc_id"]: r["class_id"] for r in probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, at = np.array([found[2 * g + 1] == 2 * g for g in range(600)]), np.array(plain)
    assert max(weighted) < 0.75 and (at >= 0.8).sum() > 300
    assert hit[at >= 0.8].mean() >= 0.999 and not hit[at < 0.8].any()


def test_most_of_a_corpus_may_be_bad():
    patterns, counts = np.array([[0, 0, 1], [0, 1, 1], [2, 1, 2]]), np.array([500.0, 300, 200])
    prior, ratio = weak_rules.fit(patterns, counts)
    odds = prior + ratio[np.arange(3), patterns].sum(1)
    assert prior < -1 and (odds < 0).tolist() == [True, True, False]
    rnd = np.random.default_rng(2)
    bad = rnd.random(5000) < 0.8
    votes = np.ones((5000, 6), int)
    for j in range(5):
        votes[bad & (rnd.random(5000) < 0.7), j] = 0
        votes[~bad & (rnd.random(5000) < 0.6), j] = 2
    votes[:, 5] = rnd.integers(0, 3, 5000)  # a rule that knows nothing
    p, n = np.unique(votes, axis=0, return_counts=True)
    prior, ratio = weak_rules.fit(p, n.astype(float))
    assert abs(1 / (1 + np.exp(-prior)) - 0.2) < 0.03 and np.abs(ratio[5]).max() < 0.3
    assert (((prior + ratio[np.arange(6), votes].sum(1)) < 0) == bad).mean() > 0.99


def _plain_em(patterns, counts, weight=weak_rules.BELIEF_WEIGHT):
    """The same model, pattern by pattern."""
    k, added = len(patterns[0]), sum(counts) * weight
    both = [any(p[j] == 2 for p in patterns) for j in range(k)]
    good = [1 / (1 + math.exp(-(sum(v == 2 for v in p) - 3 * sum(v == 0 for v in p) + 1))) for p in patterns]
    for _ in range(200):
        share = (sum(g * c for g, c in zip(good, counts)) + added * weak_rules.GOOD_BELIEF) / (sum(counts) + added)
        chance = []
        for cls in (0, 1):
            wt = [(g if cls == 0 else 1 - g) * c for g, c in zip(good, counts)]
            n = [[sum(w for w, p in zip(wt, patterns) if p[j] == v) + added * weak_rules.BELIEF[cls][v] for v in range(3)] for j in range(k)]
            chance.append([[1.0 if both[j] and v == 1 else n[j][v] / (n[j][0] + n[j][2] if both[j] else sum(n[j])) for v in range(3)] for j in range(k)])
        new = []
        for p in patterns:
            a, b = share, 1 - share
            for j, v in enumerate(p):
                a, b = a * chance[0][j][v], b * chance[1][j][v]
            new.append(a / (a + b))
        good = new
    return good


def test_posterior_against_a_plain_one(spark):
    rnd = random.Random(12)
    texts = [" ".join(f"word{rnd.randrange(400)}" + ("." if k % 9 == 8 else "") for k in range(rnd.randint(25, 80))) for _ in range(40)]
    texts += ["| ** && !! " * 3 + " ".join(f"x{i} |" for i in range(rnd.randint(20, 40))) for _ in range(12)] + [" ".join(f"W{i}!" for i in range(30)) for _ in range(5)]
    rows = weak_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("not base_failed").collect()
    names = [r[0] for r in weak_rules.rules()]
    tally = collections.Counter(tuple(r[f"vote_{n}"] for n in names) for r in rows)
    patterns = list(tally)
    want = dict(zip(patterns, _plain_em(patterns, [tally[p] for p in patterns])))
    assert len(rows) > 50 and len(patterns) > 2
    for r in rows:
        assert abs(r["posterior"] - want[tuple(r[f"vote_{n}"] for n in names)]) < 1e-6 and r["kept"] == (r["posterior"] >= 0.5)


def test_scores_are_sums_of_tables():
    """A score against a plain reading of the lookup tables, and tables against a plain boosting of two features."""
    rnd = np.random.default_rng(5)
    x = rnd.random((400, 3)).round(2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = gam_quality.Gam(bins=8, cycles=60, pair_bins=8, pairs=2).fit(x, y)
    for row, got in zip(x[:50], m.score(x[:50])):
        f = m.base
        for j in range(3):
            f += m.tables[j][sum(row[j] >= c for c in m.cuts[j])]
        for (i, j), t in zip(m.pairs, m.pair_tables):
            f += t[sum(row[i] >= c for c in m.pair_cuts[i]) * (len(m.pair_cuts[j]) + 1) + sum(row[j] >= c for c in m.pair_cuts[j])]
        assert abs(got - 1 / (1 + math.exp(-f))) < 1e-12
    assert ((m.score(x) > 0.5) == y).mean() > 0.9  # the two features only tell together


def test_votes_between_languages():
    """The hierarchy against a plain count of its machines' signs."""
    rnd = random.Random(7)
    speak = lambda v: " ".join("".join(rnd.choice(v) for _ in range(5)) for _ in range(10))
    kinds = {"en": "abcdef", "de": "bcdefg", "fr": "lmnopq", "es": "mnopqr", "zz": "tuvwx"}
    texts, langs = zip(*[(speak(v), k) for k, v in kinds.items() for _ in range(40)])
    x, _ = lang_svm.grams(pa.array(texts))
    m = lang_svm.Hierarchy(x, list(langs))
    assert set(m.families) == {"germanic", "romance", "only zz"}
    got, score = m.predict(x)
    one = np.append(x, np.ones((len(x), 1)), 1)
    for k in range(len(x)):
        fam = m.families[int(np.argmax([t @ one[k] for t in m.top]))]
        own = m.members[fam]
        wins = collections.Counter({v: 0 for v in own})
        for (a, b), w in m.pairs.items():
            if a in own:
                wins[a if w @ one[k] >= 0 else b] += 1
        assert wins[got[k]] == max(wins.values()) and 0 <= score[k] <= 1
    assert (got == np.array(langs, object)).mean() > 0.95


def test_grams_against_a_plain_count():
    texts = ["Ab cÉ ab", "x", "", "  yy  "]
    x, letter = lang_svm.grams(pa.array(texts))
    assert letter.tolist() == [True, True, False, True]
    mult = [int(v) for v in lang_svm._MULT]
    for t, row in zip(texts, x):
        d = [c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in t.lower().encode()]
        want = np.zeros(lang_svm.DIM)
        for k in (2, 3, 4):
            for i in range(len(d) - k + 1):
                if d[i] != 32 or d[i + 1] != 32:
                    h = sum(c * m for c, m in zip(d[i : i + k], mult)) % 2**32
                    want[((h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 12) % lang_svm.DIM] += 1
        assert np.allclose(row, np.sqrt(want / max(want.sum(), 1)), atol=1e-6)


def test_every_language_is_learned(spark):
    rows = [(i, f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 6, f"l{i % 60}") for i in range(600)]
    model = lang_svm.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=300)
    assert len(model.langs) == 60


