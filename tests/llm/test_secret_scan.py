import hashlib
import re

from odd import odd_rows
from pyspark.sql import functions as F

from fedframe.llm import queries, secret_scan

A = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spelled(found):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def test_query_equals_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op1_secrets(spark, sf).collect()}
    for doc_id, text in texts:
        wanted, r = brute(text), got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in wanted) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(spelled(wanted).encode()).hexdigest()


def test_odd_rows(odd, empty):
    got = sorted(((r.doc_id or 0), r.s) for r in secret_scan.scan(odd, rules=secret_scan.BASE_RULES).select("doc_id", secret_scan.span_text(F.col("spans")).alias("s")).collect())
    assert got == sorted((r[0] or 0, spelled(brute(r[1]))) for r in odd_rows())
    assert secret_scan.scan(empty).count() == 0


def test_failed_matches_consume(spark):
    texts = ["secret:token:abcdefgh", "token=secret=abcdef", "PassWord = 'a+b/c_d.e=f-'", "password:x password:longenough", "AKIAAKIA" + "A" * 13, "api-key=abcdefg apikey=abcdefg", "token token:\x20\x20abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in secret_scan.scan(df).select("doc_id", secret_scan.span_text(F.col("spans")).alias("s")).collect()}
    assert got == {i: spelled(brute(t)) for i, t in enumerate(texts)}


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secret_scan.BlobLedger(spark, f"{tmp_path}/ledger")
    one = spark.createDataFrame([(1, "password=abcdefgh"), (2, "clean")], "doc_id long, text string")
    base = secret_scan.BASE_RULES
    assert ledger.scan(one, rules=base).where("size(spans) > 0").count() == 1
    pairs = ledger.scanned().count()
    assert pairs == 2 * len(base)
    again = spark.createDataFrame([(7, "password=abcdefgh"), (8, "clean"), (9, "-----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    assert [r.doc_id for r in ledger.scan(again, rules=base).where("size(spans) > 0").collect()] == [7]
    assert ledger.scanned().count() == pairs + len(base)  # one new blob
    got = {r.doc_id: [x.kind for x in r.spans] for r in ledger.scan(again).collect()}
    assert got == {7: ["assign"], 8: [], 9: ["private_key"]}
    assert ledger.scanned().count() == 3 * len(secret_scan.RULES)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=0123456789abcdef0123456789 b AKIA" + "Z" * 16 + " c"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = secret_scan.scan(df).join(df, "doc_id")
    got = {r.doc_id: r.t for r in found.select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "a [SECRET] b [SECRET] c", 2: "clean", 3: None}


def test_repeated_rows_have_the_spans_of_one(spark, tmp_path):
    text = "xx password=abcdefgh yy"
    rows = [(1, text)] * 2 + [(None, "z " + text)] * 3 + [(None, "both " + text), (4, "both " + text), (4, "both " + text)]
    ledger = secret_scan.BlobLedger(spark, f"{tmp_path}/ledger")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ledger.scan(df).select("doc_id", secret_scan.span_text(F.col("spans")).alias("s")).collect()
    assert sorted(((r.doc_id or 0), r.s) for r in got) == sorted(((i or 0), spelled(brute(t))) for i, t in rows)
    assert ledger.findings().count() == 3
