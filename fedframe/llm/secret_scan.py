"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a text is a blob, named by its SHA-256. The ledger, two folders
of Parquet files, holds which rule versions have scanned which blob, and the
findings. A scan looks for the pairs of blob and rule version that the ledger
lacks, scans one copy of each such blob with those rules alone (rows that share
their id too are looked at together and count once), appends findings and then pairs, and joins the findings of all blobs back to all paths. Findings
whose pair was never recorded, as after a crash, are not read; repeats are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose
    group is shorter than least are dropped. guards: a text (in lower case if
    any_case) without any of them can't match; without guards, the pattern
    `probe` decides."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    guards: tuple[str, ...] = ()
    any_case: bool = False
    probe: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


BASE_RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, ("password", "passwd", "secret", "token", "api_key", "apikey"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, probe=r"[0-9a-f]{24}"),
)
#: Further kinds that a scan reports besides the base ones.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", guards=("PRIVATE KEY-----",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", guards=("eyJ",)),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", guards=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + MORE_RULES


def _may_match(rule: Rule, text: Column, lower: Column) -> Column:
    if rule.probe:
        return text.rlike(rule.probe)
    where = lower if rule.any_case else text
    found = F.lit(False)
    for guard in rule.guards:
        found = found | F.contains(where, F.lit(guard))
    return found & text.rlike(rule.pattern)


def matches(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, rules (names to apply) to blob, rule, start, end; code points, end exclusive.

    The parts between a rule's matches and the matches themselves alternate, so a
    running sum of their lengths gives every match its place. Rows that repeat a
    blob have equal pieces, of which one stays.
    """
    text = F.col("text")

    def pieces(rule: Rule) -> Column:
        extracted = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)).alias(name) for name, g in (("hit", 0), ("value", rule.group))]
        zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), *extracted)
        piece = lambda x, i: F.struct(F.lit(rule.name).alias("rule"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["value"]) >= rule.least).alias("kept"))
        return F.when(F.array_contains("rules", rule.name) & _may_match(rule, text, F.col("lower")), F.transform(zipped, piece))

    parts = [pieces(rule) for rule in rules]
    lowered = blobs.select("blob", "rules", "text", F.lower("text").alias("lower"))
    found = lowered.select("blob", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("m")).select("blob", "m.*").dropDuplicates(["blob", "rule", "i"])
    so_far = W.partitionBy("blob", "rule").orderBy("i")
    found = found.withColumn("end", F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(so_far))
    return found.where("kept").select("blob", "rule", (F.col("end") - F.col("hit")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


class BlobLedger:
    """The ledger at a path that driver and executors share; one writer at a time."""

    SCANNED, FINDINGS = "blob string, rule string", "blob string, rule string, start long, end long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS).distinct().join(self.scanned().distinct(), ["blob", "rule"], "left_semi")

    def scan(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what the ledger lacks and report every row of versions.

        Returns one row per input row: id_col, blob (SHA-256 of the text) and
        spans, an array of struct(kind, start, end, position of the rule) by start
        and then rule, empty where nothing is found. Null texts are empty ones.
        Rows with equal texts share one scan; rows that repeat an id are rows of
        their own; an empty table adds nothing.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = versions.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = rows.select("id", "blob")
        due = paths.groupBy("blob").agg(F.min("id").alias("first"))
        names = F.array(*[F.lit(r.name) for r in rules])
        done = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("done"))  # at most one for each rule version
        due = due.join(done, "blob", "left").select("blob", "first", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("rules"))
        due = due.where(F.size("rules") > 0).withColumnRenamed("blob", "due")
        one = rows.join(due.hint("shuffle_hash"), (F.col("blob") == F.col("due")) & F.col("id").eqNullSafe(F.col("first")))
        found = matches(one.select("blob", "text", "rules"), rules)
        found.write.mode("append").parquet(f"{self.path}/findings")
        due.select(F.col("due").alias("blob"), F.explode("rules").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")

        order = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))]), F.col("rule"))
        kind = F.split("rule", "/")[0]
        span = F.struct("start", order.alias("order"), "end", kind.alias("kind"))
        by_blob = self.findings().where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("found"))  # those of one text
        out = paths.join(by_blob, "blob", "left")
        spans = F.transform(F.col("found"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["order"].alias("order")))
        empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,order:int>>")
        return out.select(F.col("id").alias(id_col), "blob", F.coalesce(spans, empty).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Scan with the ledger at a path, or with a new one in the shared folder."""
    ledger = BlobLedger(docs.sparkSession, ledger_path or scratch_path(docs.sparkSession, "ledger"))
    return ledger.scan(docs, id_col, text_col, rules)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by mark; null stays null."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(more.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _kind_sql(order: int, rule: Rule) -> str:
    """DuckDB SQL for one rule's matches, with letters of either case spelled out as its folding is Unicode's."""
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", either).replace("'", "''")
    return f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS h,
        regexp_extract_all(t, '{pattern}', {rule.group}) AS v, regexp_split_to_array(t, '{pattern}') AS s FROM d"""


def secrets_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest query in DuckDB SQL."""
    counts = ", ".join(f"count(f.kind) FILTER (f.kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(rules))}),
u AS (SELECT doc_id, ord, kind, least, h, v, s, unnest(range(1, len(h) + 1)) AS i FROM m),
p AS (SELECT doc_id, ord, kind, h[i] AS hit, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM u WHERE length(v[i]) >= least),
f AS (SELECT *, kind || ':' || a || ':' || (a + length(hit)) AS span FROM p)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY a, ord) FILTER (ord < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, ord), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""
