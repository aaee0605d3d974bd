from __future__ import annotations

import math
from collections import Counter

from huntframe.llm import quality as q

WS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def counts(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if seen[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


PROSE = "The house of the man was in the old town, and that is for the best. "
TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a  b\nc\n\na b c\nc", "x" * 50000, "|#|" * 40, "é ß ü é ß ü é",
    "one two\n" * 30, PROSE * 40, "THE! OF! AND!! " * 60, "w1 w2 w3 w4 w5 w6 w7 " * 2000,
]


def frame(spark):
    rows = [(i, t, lang, "z") for i, t in enumerate(TEXTS) for lang in ("en", None, "xx", "de")]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, n_words string").drop("n_words")


def test_counts_equal_brute_force(spark):
    for r in q.with_metrics(frame(spark)).collect():
        want = counts(r.text or "")
        assert tuple(r[c] for c in q.COUNTS) == want, r.text
        assert sum(r.chars) == len(r.text or "") and sum(r.common) == max(want[0], sum(r.common[:-1]))
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def jsd(x, y):
    a, b = sum(x), sum(y)
    total = 0.0
    for p, r in ((u / a, v / b) for u, v in zip(x, y, strict=True)):
        m = (p + r) / 2
        total += sum(v * math.log2(v / m) for v in (p, r) if v > 0) / 2
    return math.sqrt(max(total, 0))


def test_distance_and_verdict(spark):
    prose = PROSE.split() * 20
    varied = " ".join(f"{w} thing{'abc'[i % 3] * (i // 2)}" if i % 2 else w for i, w in enumerate(prose))
    varied = " ".join(varied.replace("thing", "t").split())
    loud = " ".join(f"RA{i}!! ZO{i * 3}!! " for i in range(200))
    df = spark.createDataFrame([(i, varied, "en") for i in range(20)] + [(90, loud, "en"), (91, varied, None), (92, "few words", "en")], "doc_id long, text string, lang string")
    metrics = q.with_metrics(df).drop("text")
    refs = {r.ref_key: r for r in q.references(metrics).collect()}
    assert set(refs) == {"en", "*"}
    out = {r.doc_id: r for r in q.with_verdict(metrics, q.references(metrics)).collect()}
    assert out[0].kept and out[91].kept and not out[90].kept and out[90].reason == "characters" and out[92].reason == "base"
    assert abs(out[90].char_distance - jsd(out[90].chars, refs["en"].ref_chars)) < 1e-9
    assert abs(out[91].word_distance - jsd(out[91].common, refs["*"].ref_common)) < 1e-9


def test_frames(spark):
    good = " ".join(f"word{'abcdefg'[i % 7] * (i // 7)}" for i in range(100))
    more = spark.createDataFrame([(500, good, "en")], "doc_id long, text string, lang string")
    clash = frame(spark).unionByName(more).withColumnRenamed("doc_id", "Kept").withColumn("_q_text0", q.F.lit(1))
    kept = q.good_documents(clash)
    assert kept.columns == clash.columns and 0 < kept.count() < clash.count()
    assert q.good_documents(clash.limit(0)).count() == 0
    assert q.good_documents(clash.drop("lang")).columns == clash.drop("lang").columns
