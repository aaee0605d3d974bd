from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huntframe.llm import subword_classifier as sc
from huntframe.llm.arrow_text import slices

TEXTS = ["", None, " \t\n", "a", "a a a b", "One two, TWO two\x0bthree", "ß é日本 語 語", "x\x00y <z>", "word " * 3000, "　wide blank", "end\r\nof line"]


def plain_tokens(text):
    """Tokens as texts: words, marks of repeated words, n-grams with a zero character at a word's ends."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    found = [("word", w) for w in words] + [("again", "") for a, b in zip(words, words[1:]) if a == b]
    for n in sc.SIZES:
        for w in words:
            marked = [-1, *map(ord, w), -1]
            found += [(n, tuple(marked[i : i + n])) for i in range(len(marked) - n + 1)]
    return Counter(found)


def test_tokens_equal_brute_force():
    """Equal tokens share a bucket, and each row has as many of each as the plain form."""
    seen = {}
    for first, last, data, starts in slices(pa.array(TEXTS)):
        kinds = list(sc.tokens(data, starts))
        for row in range(last - first):
            plain = plain_tokens(TEXTS[first + row])
            got = Counter(np.concatenate([b[s[row] : s[row + 1]] for b, s in kinds]).tolist())
            assert sum(got.values()) == sum(plain.values())
            assert sorted(got.values()) == sorted(plain.values())  # few tokens, so no two share a bucket
            assert got[sc.AGAIN] == plain["again", ""]
            for token, n in plain.items():
                if list(plain.values()).count(n) == 1:
                    bucket = next(b for b, m in got.items() if m == n)
                    assert seen.setdefault(token, bucket) == bucket


def test_one_text_alone_or_among_others():
    alone = [list(sc._weights(pa.array([t])))[0] for t in TEXTS]
    for (a, b), (c, d) in zip(alone, sc._weights(pa.array(TEXTS)), strict=True):
        assert a.tolist() == c.tolist() and np.allclose(b, d)


def test_scores_are_means_of_shares():
    share = np.random.default_rng(1).standard_normal(sc.BUCKETS + 2)
    want = [float((share[used].astype(float) * weight).sum()) for used, weight in sc._weights(pa.array(TEXTS))]
    assert np.allclose(sc._shares(pa.array(TEXTS), share), want, atol=1e-5)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, " ".join(f"{'GOOD' if i % 3 else 'bad'}{(i * j) % 11}x" for j in range(30)), "en") for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "GOOD", "en"), (900, None, None), (901, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 7) for i in range(300)], "doc_id long, quality int, label int")
    return docs, labels


def learned(docs, labels):
    return sc.fit(sc.training_rows(docs, labels))


def test_learns_whatever_the_partitions(spark, tables):
    docs, labels = tables
    share = learned(docs, labels)
    assert np.array_equal(share, learned(docs.repartition(7), labels.repartition(3)))
    rows = {r.key: r.score for r in sc.score(docs, share).collect()}
    assert len(rows) == 303 and all(0 <= v <= 1 for v in rows.values())
    assert all((rows[i] >= 0.5) == (i % 3 > 0) for i in range(300))
    assert rows[900] == rows[901]


def test_odd_labels(spark, tables):
    docs, labels = tables
    share = learned(docs, labels)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 9, 0), (5000, 1, 0)], labels.schema)).unionByName(labels.where("doc_id < 9"))
    assert np.array_equal(share, learned(docs.unionByName(docs.where("doc_id < 9")), more))
    none = learned(docs, labels.limit(0))
    assert {r.score for r in sc.score(docs, none).collect()} == {0.5}
    assert sc.score(docs.limit(0), share).count() == 0


def test_query(spark, sf_dir):
    got = sc.op11_subword_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    folds = {r.doc_id: r.h for r in spark.createDataFrame([(r.doc_id,) for r in got], "doc_id long").select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h")).collect()}
    assert all(r.held_out == folds[r.doc_id] for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == q for _, p, q in held]) >= 0.95
    worst_good, best_bad = min(s for s, _, q in held if q), max(s for s, _, q in held if not q)
    assert worst_good > best_bad - 0.5


def test_held_out_labels_are_never_read(spark, tables, tmp_path):
    docs, labels = tables
    scores = []
    for name, quality in (("a", F.col("quality")), ("b", F.when(sc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.withColumn("quality", quality).write.parquet(str(tmp_path / name / "labels.parquet"))
        scores.append(sorted((r.doc_id or -1, r.score) for r in sc.op11_subword_classifier(spark, str(tmp_path / name)).collect()))
    assert scores[0] == scores[1]
