from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from huntframe.llm import collocations as co


def pieces(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", folded)]


def brute(docs, least, top):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            total[lang] += len(p)
            for size in range(1, 6):
                for i in range(len(p) - size + 1):
                    f[lang, tuple(p[i : i + size])] += 1
    candidates = {(lang, w): n for (lang, w), n in f.items() if len(w) > 1 and n >= least}
    dropped = set()
    for (lang, w), n in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i : i + size])
                if 100 * n >= 100 * candidates[part]:
                    dropped.add(part)
    rows = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, n long, w1 string")


@pytest.mark.parametrize("least,top", [(3, 2000), (2, 5)])
def test_equals_brute_force(spark, least, top):
    rng = random.Random(least)
    vocabulary = ["The", "of", "x\x0by", "é", "BIG", "ß", "a\x00b", "dog", "rare"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", "", ", ", ".", "\n"]) for _ in range(n))
    docs = [(text(rng.choice([0, 1, 5, 60])), rng.choice(["en", "de", None, "und", ""])) for _ in range(60)]
    docs += [(None, "en"), ("", None), (" \t.,", "fr"), ("one two three four five six " * 4, "fr"), (docs[3][0], "en"), (docs[3][0], "en")]
    got = co.collocations(made(spark, docs).repartition(4), least, top)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, least, top)


def test_few_slots_change_nothing(spark):
    docs = [(f"a b c d e f g{i % 3} h", "en") for i in range(20)]
    assert sorted(tuple(r) for r in co.collocations(made(spark, docs), 5, slots={1: 8, 2: 16, 3: 8}).collect()) == brute(docs, 5, 2000)


def test_long_text_and_hot_language(spark):
    docs = [("very frequent phrase here " * 40000, "en"), ("tail", None)]
    assert sorted(tuple(r) for r in co.collocations(made(spark, docs)).collect()) == brute(docs, 100, 2000)


def test_rows_handed_on_follow_cores_not_splits(spark):
    docs = [("one two three four, five six seven " * 40, lang) for lang in ("en", "de") for _ in range(64)]
    read = co._read(made(spark, docs).repartition(128), "text", "lang")
    handed = co._task_windows(read, spark.sparkContext.broadcast({}))
    keys = ["lang", *co.WORDS]
    different = handed.select(keys).distinct().count()
    assert handed.count() <= different * co.ROUNDS * spark.sparkContext.defaultParallelism < different * 64
    totals = {r.lang: r.n for r in handed.groupBy("lang").sum("n").toDF("lang", "n").collect()}
    assert totals == {"en": 64 * 280, "de": 64 * 280}


def test_empty_table(spark):
    assert co.collocations(made(spark, [("a", "b")]).limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    rows = [("en", *("a", "b", "", "", ""), 3 * 10**12), ("en", *("b", "", "", "", ""), 10**12), ("en", *("",) * 5, 5 * 10**12)]
    counted = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["lang", *co.WORDS]) + ", n long")
    counts = {tuple(r.words): r.n for r in co.phrase_counts(counted).collect()}
    assert counts == {(): 9 * 10**12, ("a",): 3 * 10**12, ("a", "b"): 3 * 10**12, ("b",): 10**12}
