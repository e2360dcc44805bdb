"""Trained operators on held-out rows, rules and chat formatting against plain code."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bytelode.llm import chat, gbt, langid, quality_model, quality_rules, queries, urlfilter
from tests.duck import connect, same
from tests.llm.data import empty, table, texts

SF = "/root/testdata/sf0.01"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_trees() -> None:
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = gbt.fit(x[:2000], y[:2000])
    assert np.mean((trees.score(x[2000:]) > 0.5) == y[2000:]) > 0.95
    one = trees.score(x[:50])
    for k in range(50):  # the flat walk equals a walk node by node
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(c):
                node = 2 * node + 1 + int(x[k, f[node]] > c[node])
            total += leaf[node - len(c)]
        assert np.isclose(one[k], 1 / (1 + np.exp(-total)))
    assert np.allclose(gbt.fit(np.zeros((0, 1)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert gbt.fit(np.zeros((9, 1)), np.ones(9)).score(np.zeros((1, 1)))[0] > 0.9


def test_quality_on_held_out_rows(spark) -> None:
    out = queries.QUERIES["op2_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = out.where("held_out and quality is not null").collect()
    assert all(held_out(r.doc_id) for r in rows) and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_edges(spark) -> None:
    labels = spark.createDataFrame([(6, 1, 0), (6, None, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality long, toxic long")
    rows = texts()
    trees = quality_model.train(table(spark, rows), labels)
    out = quality_model.score(table(spark, rows), trees).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in out)
    nothing = quality_model.train(empty(spark), labels.limit(0))
    assert quality_model.score(empty(spark), nothing).count() == 0
    assert quality_model.accepted(table(spark, rows), nothing).columns == table(spark, rows).columns


def test_language_on_held_out_rows(spark) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES["op3_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97


def test_language_edges(spark) -> None:
    code = langid.codebook(20)
    assert len({tuple(c) for c in code}) == 20 and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 6
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (None, "the and of to the and in that"), (6, "漢")]
    out = {r.doc_id: r for r in langid.predict(table(spark, rows), model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[3].score == 0 and out[3].ambiguous
    assert out[4].lang_pred != "und" and out[6].lang_pred != "und" and out[None].lang_pred == "en" and not out[None].held_out
    assert langid.predict(empty(spark), langid.train(empty(spark))).count() == 0


def base(text: str | None) -> tuple:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_sample_of_languages(spark) -> None:
    """The least hashes of each language, and little more than these is ever ordered."""
    for languages, n in ((1, 9_000), (3, 9_000), (30, 9_000), (langid.LANGUAGES + 20, 3_000)):
        docs = spark.range(n).select("id", (F.col("id") * F.col("id") % languages).alias("l")).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.format_string("l%04d", "l").alias("lang"))
        names, chosen = langid.sample(docs, 600)
        rows = docs.where(~langid.held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).toPandas()
        assert len(names) == min(rows.lang.nunique(), langid.LANGUAGES)
        each = max(600 // len(names), langid.LEAST)
        wanted = rows[rows.lang.isin(names)].sort_values(["lang", "h"]).groupby("lang").head(each)
        assert {(r.doc_id, r.lang) for r in chosen.collect()} == {*zip(wanted.doc_id, wanted.lang, strict=True)}


def test_rules(spark) -> None:
    rows = texts() + [(800, "a b\nc #$ | <x>\na b\n\na b \n" * 20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality long, toxic long")
    out = quality_rules.judge(table(spark, rows), labels).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert found == sorted(((k, *base(t)) for k, t in rows), key=str)
    assert all(not r.kept for r in out if r.base_failed)
    assert quality_rules.judge(empty(spark), labels).count() == 0


def test_risk_control() -> None:
    assert quality_rules.below(10, 10, 0.3) == 1 and np.isclose(quality_rules.below(10, 0, 0.3), 0.7**10)
    assert np.isclose(quality_rules.below(40, 2, 0.1), sum(math.comb(40, k) * 0.1**k * 0.9 ** (40 - k) for k in range(3)))
    assert np.isclose(quality_rules.below(10**9, 7_142_000, 0.05 / 7), 0.378, atol=0.02) and quality_rules.below(10**9, 10**8, 0.05 / 7) > 1 - 1e-5
    steps = quality_rules.path()
    assert len(steps) == len({*steps}) == sum(len(c) for _, c in quality_rules.RULES.values()) and steps[:2] == [("symbols", 0.9), ("duplicate_lines", 0.9)]
    assert quality_rules.cutoffs_at(0) == {} and quality_rules.cutoffs_at(len(steps)) == {r: c[0] for r, (_, c) in quality_rules.RULES.items()}
    none = len(steps)
    assert quality_rules.choose({0: {none: 89}, 1: {none: 90}, 2: {}}) == {0: 0, 1: none, 2: 0}
    # 3 of 100 are too many to prove less than one in twenty; 4 of 1000 prove it and are few enough to take, 20 only prove it
    assert quality_rules.choose({0: {none: 97, 5: 3}, 1: {none: 956, 7: 4, 30: 40}, 2: {none: 980, 9: 20}}) == {0: 5, 1: 30, 2: 9}


def test_steps_reject_what_their_cutoffs_say(spark) -> None:
    """The step of each document against cutoffs as they stand after each step."""
    docs = table(spark, texts() + [(800 + k, "#$ %&\n" * k + "Word! " * (90 - k)) for k in range(0, 90, 6)])
    stats = quality_rules.measure(docs).withColumn("step", quality_rules.rejected_at()).withColumns({f"r_{r}": quality_rules.ratio(r) for r in quality_rules.RULES}).collect()
    for row in stats:
        fails = [any(row[f"r_{r}"] > cut for r, cut in quality_rules.cutoffs_at(k + 1).items()) for k in range(len(quality_rules.path()))]
        assert row.step == (fails.index(True) if any(fails) else len(fails))
    assert len({r.step for r in stats}) > 5


def test_false_rejections_stay_below_the_bound(spark) -> None:
    out = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    good = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1"), "doc_id").where("not base_failed")
    assert good.where("not kept").count() <= quality_rules.FALSE_REJECTIONS * good.count()


def test_bound_on_rows_not_used(spark) -> None:
    """Steps that half of the labels allow reject few good documents of the other half, and reject something at all."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_rules.measure(docs).cache()
    half = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    steps = quality_rules.limits(stats, half)
    assert max(steps.values()) > 0
    may = F.get(F.array(*(F.lit(steps.get(b, 0)) for b in range(len(quality_rules.STRATA) + 1))), quality_rules.stratum())
    rest = stats.where(~quality_rules.base_failed()).join(labels.where("quality = 1 and crc32(cast(doc_id as string)) % 2 = 1"), "doc_id")
    for r in rest.groupBy(quality_rules.stratum().alias("band")).agg(F.count("*").alias("n"), F.count_if(quality_rules.rejected_at() < may).alias("lost")).collect():
        assert r.lost <= 0.05 * r.n + 3 * math.sqrt(0.05 * r.n)


def test_chat(spark) -> None:
    draw = random.Random(2)
    rows: list[tuple] = []
    logs: list[list[tuple]] = []
    for _ in range(30):
        start = list(draw.choice(logs)) if logs and draw.random() < 0.6 else []
        logs.append(start + [(draw.choice(["user", None, ""]), draw.choice(["hi", "a", None, ""])) for _ in range(draw.randint(1, 4))])
    logs += [logs[3], logs[3], [("user", "x")] * 600, [("user", "x")] * 300]
    for k, log in enumerate(logs):
        rows += [(k, t, r, x, "extra", 1) for t, (r, x) in enumerate(log)]
    rows += [(None, 0, "user", "lost", "extra", 1), (77, None, "user", "no turn", "e", 1), (77, 1, "user", "second", "e", 1), (77, 1, "user", "second", "e", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch string, k long").repartition(3)
    out = chat.collapse(df)
    con = connect(SF)
    con.register("given", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    same(out, con.sql(chat.collapse_sql("given")).df())
    assert chat.collapse(df.limit(0)).count() == 0


def test_chat_sql(spark) -> None:
    same(queries.QUERIES["op5_chat_formatting"](spark, SF), connect(SF).sql(queries.ORACLES["op5_chat_formatting"]).df())


def test_urls(spark) -> None:
    urls = ["http://A.Example.ORG/es/x", "http://example.org/en/12", "https://org/x", "http://example.org", "http://xexample.org/es/", "ftp://b.com/fr/", "http://b.com/de/?q", "http://b.net/a?b=c#d", "no scheme", "", None, "http://b.com?x://y/de/", "http:///path", "x://y://z/p"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(1, urls[1], "h")], "page_id long, url string, rule string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert out[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and out[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[2][2:] == ("org/", "allow") and out[3][:3] == ("example.org", "", None) and out[4][2:] == ("org/", "allow")
    assert out[5][2:] == ("com/fr/", "allow") and out[6] == ("b.com", "/de/", "com/de/", "block") and out[7][:3] == ("b.net", "/a", None)
    assert out[8][:3] == out[9][:3] == out[10][:3] == ("", "", None) and out[11][:2] == ("b.com", "") and out[12][:2] == ("", "/path") and out[13][:2] == ("y:", "//z/p")
    assert all(v in ("allow", "block") for *_, v in out.values())
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_urls_learned(spark) -> None:
    """Trees trained on urls with known verdicts find those of other urls."""
    draw = random.Random(1)
    rows = [(k, f"http://h{draw.randrange(99)}.{'org/a' if k % 2 else 'com/de/' + '9' * 20}{draw.randrange(999)}") for k in range(400)] + [(1000 + k, f"http://h.net/de/{'9' * 20}{k}") for k in range(20)]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert np.mean([r.verdict == "block" for r in out]) > 0.9


def test_pipeline(spark) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "encoding"]
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0.6 * docs.count() and out.where("not round_trip").count() == 0
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id").where(F.length("text") > 300)
    assert {"pipeline", *queries.QUERIES} <= {*entry.queries()} and good.count() > 0


def test_stages_on_odd_tables(spark) -> None:
    """Nulls, empty and long texts, repeated rows and ids, and clashing names, stage by stage."""
    import corpus_pipeline

    rows = texts() + [(6, "another text under a known id " * 9), (900, "word " * 200_000), (901, " " * 300_000)]
    for name, stage in corpus_pipeline.STAGES:
        docs = table(spark, rows)
        out = stage(spark, docs, SF)
        assert out.columns == (["doc_id", "n_tokens", "ids", "round_trip"] if name == "encoding" else docs.columns), name
        n = out.count()
        assert n == len(rows) if name in ("repeated_passages", "encoding") else 0 < n <= len(rows), name
        assert stage(spark, empty(spark), SF).count() == 0, name
