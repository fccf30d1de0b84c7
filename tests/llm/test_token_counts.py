import random

import public_tokenizers
from odd import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fedframe.llm import queries
from fedframe.llm import token_counts as C

PATH = queries.tokenizer("byte_bpe_50k.tiktoken")
TOOL = C.tokenizer(PATH, public_tokenizers.PATTERN)


def full(text):
    return len(TOOL.encoding.encode_ordinary(text))


PIECES = st.text(alphabet="ab'st 1!\né漢", max_size=12)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), PIECES), max_size=4))
def test_edits_leave_a_fresh_tree(text, edits):
    tree = C.TokenTree.of(text, TOOL)
    for start, n, put in edits:
        start = min(start, len(text))
        text, _ = tree.edit(text, start, min(len(text), start + n), put, TOOL)
        assert tree.leaves() == C.TokenTree.of(text, TOOL).leaves()
        assert (tree.n_tokens, tree.n_chars) == (full(text), len(text))


def test_long_texts_and_few_characters_encoded(texts):
    r = random.Random(4)
    for _, text in texts[:40]:
        tree, again = C.TokenTree.of(text, TOOL), 0
        for _ in range(4):
            start = r.randrange(len(text) + 1)
            text, n = tree.edit(text, start, min(len(text), start + r.choice([0, 1, 30])), r.choice(["", " x", "word\n", text[:300]]), TOOL)
            again += n
        assert tree.leaves() == C.TokenTree.of(text, TOOL).leaves() and tree.n_tokens == full(text)
        assert len(text) < 5000 or again < 2000


def test_query(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op4_token_counts(spark, sf).collect()}
    for doc_id, text in texts:
        n = len(text)
        assert got[doc_id].n_tokens == full(text)
        for start, stop, put in ((n // 3, n // 3 + 6, f" edit{doc_id}"), (2 * n // 3, 2 * n // 3, "ed.\n new"), (n - 10, n, "")):
            start = min(max(0, start), len(text))
            text = text[:start] + put + text[min(max(start, stop), len(text)) :]
        assert got[doc_id].n_tokens_edited == full(text)


def test_odd_rows(odd, empty):
    counted = C.count(odd, PATH, public_tokenizers.PATTERN, keep=("doc_id", "text"))
    assert sorted(r.n_tokens for r in counted.collect()) == sorted(full(r[1] or "") for r in odd_rows())
    none = counted.withColumn("edits", F.lit(None).cast("array<struct<start:bigint,stop:bigint,put:string>>"))
    same = C.recount(none, PATH, public_tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in same.collect()) == sorted(full(r[1] or "") for r in odd_rows())
    assert same.where("n_encoded > 0").count() == 0
    far = counted.withColumn("edits", F.expr("array(named_struct('start', 10L, 'stop', 1000000L, 'put', 'z'), named_struct('start', -5L, 'stop', 0L, 'put', null), null)"))
    got = sorted(r.n_tokens for r in C.recount(far, PATH, public_tokenizers.PATTERN).collect())
    assert got == sorted(full((r[1] or "")[:10] + "z") for r in odd_rows())
    assert C.count(empty, PATH, public_tokenizers.PATTERN).count() == 0
