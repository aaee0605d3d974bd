"""Each stage on its predecessor's rows against brute force, over the smallest tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline as cp
import pytest
import sentencepiece
from test_decontamination import words
from test_pii import brute as plain_pii
from test_quality import counts

from huntframe.llm import pii
from huntframe.llm.piece_model import default_model_path


def links(texts, n, percent):
    sets = {}
    for key, text in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in text).split()
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    return {k: root(k) for k in keys}


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return dict(out)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    documents = stages["documents"]
    for name, df in list(stages.items())[:-1]:
        assert df.columns == documents.columns, name
    sizes = [df.count() for df in stages.values()]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0


def test_quality_keeps_no_failed_base(stages):
    before, after = rows_of(stages["documents"]), rows_of(stages["quality_rules"])
    for key, row in before.items():
        n, _, _, _, repeated = counts(row.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert key not in after
        elif key in after:
            assert after[key] == row


def test_one_of_each_group_stays(stages):
    before = {k: r.text for k, r in rows_of(stages["quality_rules"]).items()}
    lead = links(before, cp.NEAR_WORDS, cp.NEAR_PERCENT)
    assert set(rows_of(stages["near_duplicates"])) == set(lead.values())


def test_contaminated_go(spark, sf_dir, stages):
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    clean = set()
    for key, row in rows_of(stages["near_duplicates"]).items():
        w = words(row.text)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.add(key)
    assert set(rows_of(stages["benchmark"])) == clean


def test_personal_data_is_gone(stages):
    before, after = rows_of(stages["benchmark"]), rows_of(stages["personal_data"])
    assert set(before) == set(after)
    for key, row in after.items():
        assert not any(plain_pii(row.text)[k] for k in ("email", "ip", "card")) and row.n_chars == len(row.text)
        if not any(s for kinds in pii.find_spans(before[key].text) for s in kinds.values()):
            assert row == before[key]


def test_encoding(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    after = rows_of(stages["piece_encoding"])
    for key, row in rows_of(stages["personal_data"]).items():
        ids = lib.encode(row.text, add_eos=True)
        assert after[key].n_tokens == len(ids)
        assert after[key].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_stages_take_odd_tables(spark, sf_dir):
    good = " ".join(f"word{'abcdefg'[i % 7] * (i // 7)}" for i in range(100))
    rows = [(1, good, "en", "s", 5, "k"), (1, good, "en", "s", 5, "k"), (2, None, None, None, None, None), (3, "", "en", "s", 0, ""), (None, good, "en", "s", 1, "k")]
    rows += [(4, "a b " * 20000, "en", "s", 1, "k"), (5, f"{good} mail a@b.cd", None, "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == docs.columns and out.count() <= table.count(), name
    near = cp.near_duplicates(spark, docs, sf_dir)
    assert sorted((r.doc_id for r in near.collect()), key=repr) == [1, 2, 3, 4]
