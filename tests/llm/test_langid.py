import zlib
from pathlib import Path

import numpy as np
import pytest
from odd import odd_rows
from pyspark.sql import functions as F

from fedframe.llm import langid, queries
from fedframe.llm.common import READ_ROWS
from fedframe.shared import shared_dir

PATH = queries.tokenizer("piece_bpe_32k.model")
VOCABULARY = langid.vocabulary_of(PATH)


def test_held_out_accuracy(spark, sf, docs):
    got = queries.op9_langid(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.text]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def brute(part, chances):
    out = []
    for k in range(chances.shape[1]):
        total = [1.0] + [0.0] * len(part)
        for j in range(1, len(part) + 1):
            for i in range(max(0, j - VOCABULARY.longest), j):
                p = VOCABULARY.numbers.get(part[i:j], -1)
                if p >= 0:
                    total[j] += total[i] * chances[p, k]
                elif j == i + 1:
                    total[j] += total[i] * chances[VOCABULARY.size, k]
        out.append(np.log(total[-1]))
    return out


def test_forward_pass_sums_all_segmentations(texts):
    chances = np.random.default_rng(1).random((VOCABULARY.size + 1, 3)) * 1e-3
    model = langid.Model(["a", "b", "c"], chances)
    words = sorted({w for _, t in texts[:30] for w in t.split()})[:300] + ["漢字かな交じり", "日本語x", "a" * 60, "²."]
    parts = [langid.MARK + w for w in words]
    assert np.allclose(model.score_parts(parts, VOCABULARY), [brute(p, chances) for p in parts], rtol=1e-9)
    known, held = langid._Known(model, VOCABULARY), langid._Known(model, VOCABULARY)
    numbers = [known[w] for w in words]
    known.learn(held)
    assert np.allclose(known.table[numbers], [brute(p, chances) for p in parts], rtol=1e-9)


def test_long_parts_do_not_vanish():
    model = langid.Model(["a", "b"], np.full((VOCABULARY.size + 1, 2), 1e-6))
    assert np.isfinite(model.score_parts(["x" * 5000], VOCABULARY)).all()


def test_fitting_raises_what_is_seen():
    numbers, longest = langid.pieces(PATH)
    found = langid.fit({"the": 5.0, "thing": 2.0}, numbers, longest, rounds=3)
    assert abs(sum(found.values()) - 1) < 1e-6 and found[numbers["▁the"]] > 0.5


def test_odd_rows(odd, empty):
    train = odd.where(F.col("doc_id").isin(1, 9))
    model = langid.train(train, PATH)
    assert model.languages == ["en", "fr"]
    got = langid.identify(odd, model, PATH, keep=("doc_id", "text")).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert langid.identify(empty, model, PATH).count() == 0
    nothing = langid.train(empty, PATH)
    assert nothing.languages == [] and {r.lang_pred for r in langid.identify(odd, nothing, PATH).collect()} == {"und"}


def test_only_the_text_counts(docs):
    model = langid.train(docs, PATH, max_docs=20)
    a = langid.identify(docs, model, PATH).collect()
    b = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(3), model, PATH).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("max_docs", [1, 2, 5, 400])
def test_first_documents_by_hash_are_chosen(odd, max_docs):
    rows = odd.where("text is not null and lang is not null").selectExpr("lang", "text", "xxhash64(cast(doc_id as string)) as hash").collect()
    want = []
    for lang in {r.lang for r in rows}:
        own = sorted(r.hash for r in rows if r.lang == lang)
        last = own[: max_docs][-1]
        want += [(r.lang, r.text) for r in rows if r.lang == lang and r.hash <= last]  # copies of the last one's id too
    assert sorted(map(tuple, langid.choose(odd, "doc_id", "text", "lang", max_docs).collect())) == sorted(want)


def test_training_sorts_and_writes_nothing_and_reads_few_rows_at_once(spark, docs):
    there = lambda: set(Path(shared_dir(spark).removeprefix("file:"), "fedframe").glob("*"))
    before = there()
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    langid.train(docs, PATH, max_docs=5)
    assert there() == before  # the chosen ids were a table of a file for each task, left there
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(READ_ROWS)
    plan = langid.choose(docs, "doc_id", "text", "lang", 5)._jdf.queryExecution().executedPlan().toString()
    assert "collect_top_k" in plan and "Window" not in plan and "Sort" not in plan
