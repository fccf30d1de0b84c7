import hashlib
import re
from collections import Counter

import corpus_pipeline as p
import sentencepiece
from pyspark.sql import functions as F
from test_minhash import brute
from test_mixing import targets
from test_secret_scan import brute as secret_spans

from fedframe.llm import langid, queries, secret_scan


def stage(name, spark, docs, sf):
    return dict(p.STAGES)[name](spark, docs, sf)


def test_stages_are_as_ordered():
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "secrets", "mix", "encode"] and p.ORACLE_SQL is None


def test_language_keeps_clean_documents(spark, sf, docs):
    odd = spark.createDataFrame([(10_001, "12 34", "en", "a", 5), (10_002, None, "en", "a", 0)], docs.schema)
    out = stage("language", spark, docs.union(odd), sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_one_of_each_group_stays(spark, sf, docs, texts):
    out = stage("near_duplicates", spark, docs, sf)
    wanted = {r[0] for r in brute(texts) if r[3]}
    assert sorted(r.doc_id for r in out.collect()) == sorted(wanted) and out.columns == docs.columns


def test_secrets_are_masked_and_the_rest_untouched(spark, sf, docs):
    from test_secret_scan import brute as secrets

    out = {r.doc_id: r for r in stage("secrets", spark, docs, sf).collect()}
    for r in docs.collect():
        if secrets(r.text):
            assert "[SECRET]" in out[r.doc_id].text and not secrets(out[r.doc_id].text) and out[r.doc_id].n_chars == len(out[r.doc_id].text)
        else:
            assert out[r.doc_id] == r


def test_mix_repeats_as_taken(spark, sf, docs):
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in queries.op8_mixing(spark, sf).collect() if r.taken}
    out = stage("mix", spark, docs, sf)
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == taken and out.columns == docs.columns


def test_run_and_odd_tables(spark, sf, odd, empty):
    out = p.run(spark, sf)
    assert out.where(~F.col("decodes")).count() == 0 and out.count() > 100
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (base, base.limit(0)):
        docs = table
        for _, f in p.STAGES:
            docs = f(spark, docs, sf)
        docs.collect()


def masked(text):
    """text with every secret, overlapping ones as one, replaced."""
    spans = [(a, b) for a, _, b in secret_spans(text)] + [m.span() for rule in secret_scan.MORE_RULES for m in re.finditer(rule.pattern, text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def mixed(rows):
    """(id, source, text) as often as the mix takes it."""
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[2])) for r in rows}
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    totals = {s: sum(size[r[0]] for r in members) for s, members in by_source.items()}
    out, want = [], targets(totals)
    for s, members in by_source.items():
        budget, before = int(want[s] + 0.5), 0
        for r in sorted(members, key=lambda r: (hashlib.md5(f"mix|{r[0]}".encode()).hexdigest(), r[0])):
            n = size[r[0]]
            taken = budget // max(totals[s], 1) * n + max(0, min(n, budget % max(totals[s], 1) - before))
            before += n
            out += [r] * (-(-taken // n) if taken else 0)
    return out


def test_the_whole_against_a_pipeline_in_python(spark, sf, docs):
    """All stages by brute force; of the language stage the model's own predictions are taken."""
    vocabulary = queries.tokenizer("piece_bpe_32k.model")
    model = langid.train(docs.where(~langid.held_out()), vocabulary)
    said = {r.doc_id: r for r in langid.identify(docs, model, vocabulary).collect()}
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect() if said[r.doc_id].lang_pred != "und" and said[r.doc_id].score >= p.LEAST_SCORE]
    first = {r[0] for r in brute([(i, t) for i, _, t in rows]) if r[3]}
    rows = mixed([(i, s, masked(t)) for i, s, t in rows if i in first])
    plain = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    wanted = Counter((i, s, said[i].lang_pred, tuple(plain.encode(t)), plain.decode(plain.encode(t)) == t) for i, s, t in rows)
    got = Counter((r.doc_id, r.source, r.lang, tuple(r.ids), r.decodes) for r in p.run(spark, sf).collect())
    assert got == wanted and all(r.n_tokens == len(r.ids) for r in p.run(spark, sf).limit(20).collect())


def test_copies_of_an_id_do_not_outlive(spark, sf):
    from odd import words

    a, b, c = words(80, 21), words(80, 22), words(80, 23)
    rows = [(1, a), (2, b), (2, b), (3, a), (3, c), (None, c + " end"), (None, words(80, 24)), (None, words(80, 24)), (None, a), (4, None), (4, None), (4, ""), (5, None), (6, a + " end"), (7, words(80, 25)), (7, words(80, 25) + " end")]
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in stage("near_duplicates", spark, table, sf).collect()]
    sevens = [x for x in got if x[0] == 7]
    assert len(sevens) == 1 and sevens[0] in rows
    assert sorted((x for x in got if x[0] != 7), key=repr) == sorted([(1, a), (2, b), (3, c), (None, words(80, 24)), (4, None), (4, ""), (5, None)], key=repr)
