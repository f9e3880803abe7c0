"""Operators on what a bound or a cut-off would leave out."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from meshwright.llm import host_paths, kernel, label_shards, lang_svm, probminhash, weak_rules
from meshwright.llm.textstats import stats, text_stats


def test_variety_of_any_length(spark):
    rnd = random.Random(3)
    junk = lambda n: " ".join(rnd.choice([f"w{i}" for i in range(20)]) + (". " if rnd.random() < 0.05 else "") for _ in range(n))
    fresh = " ".join(f"v{i}" for i in range(700))
    texts = [junk(n) for n in (400, 550, 1999, 2000, 2001, 9000)] + [fresh, fresh[:20], ""]
    got = stats(kernel.text_array(pa.array(texts)))
    for i, t in enumerate(texts):
        w = t.split()
        parts = [w[j : j + 500] for j in range(0, len(w) - len(w) % 500, 500)] + ([w[-500:]] if len(w) % 500 else [])
        assert (got["n_varied"][i], got["n_variable"][i]) == (sum(len(set(p)) for p in parts), sum(map(len, parts)))
    rows = weak_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    vote = {r["doc_id"]: r["vote_variety"] for r in rows}
    assert [vote[i] for i in range(7)] == [0] * 6 + [2]


def test_small_languages_teach(spark):
    assert lang_svm.shares({"a": 900, "b": 36, "c": 500}, 1000) == {"b": 36, "c": 482, "a": 482}
    assert lang_svm.shares({"a": 900, "b": 36}, 2000) == {"b": 36, "a": 900}
    rnd = random.Random(5)
    speak = lambda v: " ".join("".join(rnd.choice(v) for _ in range(6)) for _ in range(12))
    rows = [(k, speak(v), lang) for lang, v, n in (("de", "abcdefg", 1500), ("fr", "hijklmn", 1500), ("tr", "opqrstu", 1500), ("fi", "vwxyzab", 30)) for k in range(n)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_svm.learn(d, 1500, 80)
    assert "fi" in model.langs
    x, _ = lang_svm.grams(pa.array([speak("vwxyzab") for _ in range(50)]))
    assert (model.predict(x)[0] == "fi").mean() > 0.9


def test_votes_for_what_holds_the_sections():
    head = "<h1>The title</h1><p>lead</p>"
    part = "<div class='section'><p>" + "words of a section " * 30 + "</p></div>"
    page = f"<body><div class='top'>plain</div><div class='content'>{head}{part}<p>between</p>{part}{part}</div></body>"
    path = host_paths.vote(page)
    assert path == "/div.content"
    assert host_paths.extract(page, path).split("\n")[:2] == ["The title", "lead"] and "between" in host_paths.extract(page, path)
    table = "<table><tbody><tr><td>" + "cells of a table " * 30 + "</td></tr></tbody></table>"
    assert host_paths.vote(f"<div class='content'>{head}{table}{table}</div>") == "/div.content"
    assert host_paths.vote(f"<div class='section'><p>{'one ' * 50}</p></div>") == "/div.section"


def test_heavy_shingles_of_texts_of_other_sizes():
    few, many = np.arange(1, 11, dtype=np.uint64), np.arange(1, 26, dtype=np.uint64)
    sets = [(few, np.full(10, 10.0)), (many, np.where(many <= 10, 10.0, 1.0))]
    assert probminhash.similarity(*sets) > 0.8
    ids, marks = np.arange(2), np.ones((2, probminhash.BANDS), np.uint32)
    same = np.zeros((2, probminhash.REGISTERS), np.uint8)
    got = probminhash._linked(ids, ids, np.array([10, 25]), np.zeros(2), same, marks, np.zeros(2, int), (0, -1), 0, 0, sets, 0.8)
    assert got == [(0, 1)]


def _passage_rows():
    """Texts that all hold one passage, too little to be linked by, and pairs of them that have more in common."""
    rnd = random.Random(21)
    common = [f"w{rnd.randrange(5000)}" for _ in range(45)]
    rows = []
    for _ in range(150):
        both = [f"p{rnd.randrange(10**6)}" for _ in range(15)]
        rows += [(len(rows) + k, " ".join(common + both + [f"o{rnd.randrange(10**6)}" for _ in range(40)])) for k in range(2)]
    return rows


def test_split_buckets_lose_no_pair(spark):
    """A pair whose only shared band is that of a bucket which is split is compared as in a bucket that isn't."""
    d = spark.createDataFrame(_passage_rows(), "doc_id long, text string")
    whole, split = ({r["doc_id"]: r["class_id"] for r in probminhash.classes(d, block, 0.33, 0).collect()} for block in (1024, 8))
    assert whole == split and len(set(whole.values())) < 230


def test_pipeline_loses_no_pair_of_split_buckets(spark, monkeypatch):
    """The pipeline's near-duplicates: no row stays because the bucket of its only shared band was split, or because of an estimate."""
    d = spark.createDataFrame(_passage_rows(), "doc_id long, text string")
    classes = probminhash._classes

    def kept(block):
        monkeypatch.setattr(probminhash, "_classes", lambda docs, *_: classes(docs, block, 0.33, 0))
        return {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, "").collect()}

    whole = kept(1024)
    assert kept(8) == whole and len(whole) < 230
    monkeypatch.setattr(probminhash, "_classes", classes)
    assert {r["doc_id"] for r in probminhash.keep_one(d, 8, 0.33, 0).collect()} == whole


def test_rounds_of_shards_deal_bundles_out_once(spark):
    """Sharding runs few tasks beside those of the rows, as a cluster of many partitions pays for each of them in every round."""
    rnd = random.Random(8)
    rows = [(i, f"copy {rnd.randrange(60)}" if i % 2 else f"text {i}") for i in range(2000)] + [(i, "a hot text") for i in range(2000, 2600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sc, ran = spark.sparkContext, 0
    sc.setJobGroup("shards", "")
    try:
        got = label_shards.assign(d).groupBy("shard").count().collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    for job in sc.statusTracker().getJobIdsForGroup("shards"):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            info = sc.statusTracker().getStageInfo(stage)
            ran += bool(info and info.numCompletedTasks)
    assert {r["count"] for r in got} == {162, 163} and ran < 110


def test_workers_give_memory_back(spark):
    """Python workers live on: what a stage's tasks have freed isn't kept beside the memory of the next stage."""

    def kept(batches):
        own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
        for _ in batches:
            pass
        held = own()
        kernel.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([held - own()])], names=["mb"])

    d = spark.range(0, 12_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.hex(F.xxhash64("id", i)))).alias("text")).cache()
    d.count()
    for stage in (lambda: text_stats(d), lambda: probminhash.sketch(d, []), lambda: lang_svm.keep_known(d.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))):
        stage().write.format("noop").mode("overwrite").save()
        most = max(r["mb"] for r in spark.range(0, 4, 1, 4).mapInArrow(kept, "mb double").collect())
        assert most < 20, most
    d.unpersist()
