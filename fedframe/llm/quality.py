"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

The base rule and the features come from each whole text in one pass, without a
shuffle of texts. Cutoffs are then selected on a labelled holdout. A chain is a
fixed sequence of rules from lax to strict: one for each feature alone, and one
that moves all features together. A rule is certified in a stratum if the exact
binomial upper bound of the share of good documents that it rejects there is
within the risk. Along a chain the rejected only grow, so its rules are tested in
sequence until one fails, and the error allowed is divided among chains and strata
alone, not among the rules of a chain. All certified rules hold together; of those
that reject LEAST_GAIN more of the bad documents than of the good, a stratum uses
the one of the largest gain, among equals that of fewer features and then the
laxest; without one, only the base rule rejects there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, count_words, let, materialise, split_words, trimmed

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Features, of which more is worse, and their cutoffs from strict to lax.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "mean_word_length": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
#: Of the good documents of a stratum, at most this share may be rejected by the rule that is used there.
RISK = 0.02
#: The share of bad documents that a cutoff rejects is to be above that of good ones by so much.
LEAST_GAIN = 0.05
#: With at least this chance all selected cutoffs keep that promise.
CONFIDENCE = 0.95


def repeat_words(words: Column, n_words: Column) -> Column:
    """Words that stand in a three-word window found at least twice in the text.

    Windows are sorted by 64-bit hashes less the bits that hold their position, and
    equal neighbours name the positions that may repeat: all that do are among them.
    Those alone are then sorted by their words, so that the count is exact.
    """

    def covered(ordered: Column) -> Column:
        k = F.size(ordered) - 1
        same = lambda a, b: F.when((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))
        starts = F.array_distinct(F.flatten(F.zip_with(F.slice(ordered, F.lit(1), k), F.slice(ordered, F.lit(2), k), same)))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def exact(pairs: Column) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(pairs, lambda x: F.array(F.shiftright(x, 31).cast("int"), x.bitwiseAND(F.lit(2**31 - 1)).cast("int")))))
        window = lambda p: F.struct(F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p"))
        return F.when(F.size(pairs) == 0, F.lit(0)).otherwise(let(F.sort_array(F.transform(starts, window)), covered))

    def in_order(ordered: Column, m: Column, low: Column) -> Column:
        high = F.bitwise_not(low)
        same = lambda a, b: a.bitwiseXOR(b).bitwiseAND(high) == 0
        packed = F.zip_with(
            F.slice(ordered, F.lit(1), m - 1),
            F.slice(ordered, F.lit(2), m - 1),
            lambda a, b: F.when(same(a, b), F.shiftleft(a.bitwiseAND(low), 31).bitwiseOR(b.bitwiseAND(low))).otherwise(F.lit(-1).cast("long")),
        )
        return let(F.filter(packed, lambda x: x >= 0), exact)

    def windows(hashes: Column, m: Column) -> Column:
        pairs = F.zip_with(F.slice(hashes, F.lit(1), m), F.slice(hashes, F.lit(2), m), lambda a, b: F.xxhash64(a, b))
        threes = F.zip_with(pairs, F.slice(hashes, F.lit(3), m), lambda a, b: F.xxhash64(a, b))
        bits = F.ceil(F.log2(m + F.lit(1))).cast("int")
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1)
        return let(low, lambda lo: let(F.sort_array(F.transform(threes, lambda x, i: x.bitwiseAND(F.bitwise_not(lo)).bitwiseOR(i.cast("long")))), lambda o: in_order(o, m, lo)))

    m = (n_words - 2).cast("int")
    return F.when(n_words < 4, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(h, m))).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """id, stratum, the base rule's counts and base_failed, and n_lines, of each whole text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stratum = F.lit(None).cast("string") if stratum_col is None else F.col(stratum_col)
    rows = docs.select(F.col(id_col).alias("id"), stratum.cast("string").alias("stratum"), F.col(text_col).alias("text"))
    rows = rows.select("*", F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(split_words(text)).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "").alias("lines"))
    # Referred to more than once above this projection, so that Spark does not put it into lambdas.
    counted = rows.select(
        "id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, WHITESPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.size("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _value(name: str) -> Column:
    over = {
        "symbol_share": ("n_symbols", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "mean_word_length": ("word_chars", "n_words"),
    }[name]
    return F.col(over[0]) / F.greatest(F.col(over[1]), F.lit(1))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of at least 1, by Stirling's series eight steps up."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    steps = F.ln(x * (x + 1) * (x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return series - steps


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k), summed from k down until the terms no longer count."""
    n, k = n.cast("double"), k.cast("long")
    term = lambda i: F.exp(log_gamma(n + 1) - log_gamma(i + 1) - log_gamma(n - i + 1) + i * F.ln(p) + (n - i) * F.ln(1 - p))
    low = F.greatest(F.lit(0), k - F.lit(200) - F.floor(40 * F.sqrt(k))).cast("long")
    total = F.aggregate(F.sequence(low, k), F.lit(0.0), lambda acc, i: acc + term(i.cast("double")))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def chains(cutoffs: dict[str, tuple[float, ...]]) -> list[list[dict[str, float]]]:
    """Sequences of rules (feature to cutoff) from strict to lax: each feature's, and all features' together."""
    alone = [[{name: cut} for cut in cuts] for name, cuts in cutoffs.items()]
    together = [dict(zip(cutoffs, level, strict=True)) for level in zip(*(cuts[-min(map(len, cutoffs.values())) :] for cuts in cutoffs.values()), strict=True)]
    return [*alone, together] if len(cutoffs) > 1 else alone


def _rejects(rule: dict[str, float]) -> Column:
    over = F.lit(False)
    for name, cut in rule.items():
        over = over | (_value(name) > cut)
    return over


def select_cutoffs(held_out: DataFrame, cutoffs: dict[str, tuple[float, ...]], risk: float, confidence: float, least_gain: float = LEAST_GAIN) -> DataFrame:
    """The certified cutoffs of each stratum.

    held_out: rows of features() of labelled documents that the base rule keeps,
    and good (boolean). Returns stratum and one column cut_<feature> (null: not in
    the rule used). The upper bound of the exact (Clopper-Pearson) interval is within
    the risk just where the binomial tail at that risk is within the error allowed.
    """
    good, known = F.col("good"), chains(cutoffs)
    rules = [(rule, lax - 1000 * c) for c, chain in enumerate(known) for lax, rule in enumerate(chain)]  # and its rank among equal gains
    sums = [F.count_if(good).alias("n"), F.count_if(~good).alias("n_bad")]
    for i, (rule, _) in enumerate(rules):
        sums += [F.count_if(good & _rejects(rule)).alias(f"k_{i}"), F.count_if(~good & _rejects(rule)).alias(f"b_{i}")]
    by_stratum = held_out.groupBy("stratum").agg(*sums)
    strata = by_stratum.agg(F.count("*").alias("strata"))
    by_stratum = by_stratum.join(F.broadcast(strata))  # one row
    allowed = (1 - confidence) / (len(known) * F.col("strata"))
    passed = []
    for i, (rule, rank) in enumerate(rules):
        gain = F.col(f"b_{i}") / F.greatest("n_bad", F.lit(1)) - F.col(f"k_{i}") / F.greatest("n", F.lit(1))
        safe = binomial_tail(F.col(f"k_{i}"), F.col("n"), F.lit(risk)) <= allowed
        cuts = [F.lit(rule.get(name)).cast("double").alias(f"cut_{name}") for name in cutoffs]
        passed.append(F.when(safe & (gain >= least_gain), F.struct(gain.alias("gain"), F.lit(rank).alias("rank"), *cuts)))
    used = by_stratum.select("stratum", F.array_max(F.array(*passed)).alias("used"))
    return used.select("stratum", *[F.col(f"used.cut_{name}") for name in cutoffs])


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str | None = "lang",
    quality_col: str = "quality",
    cutoffs: dict[str, tuple[float, ...]] | None = None,
    risk: float = RISK,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    Returns one row per input row: id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept. A null or empty text has no
    words and fails the base rule. kept is false if base_failed, or if a feature
    is above its cutoff in the rule of the row's stratum. Null strata are one. Strata
    with too few labelled good documents, or no bad ones, have no rule. Labels
    are good (quality 1) or bad (any other); null ones don't count, and a document
    labelled in several rows counts once a row. Empty labels certify nothing.
    """
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    rows = materialise(features(docs, id_col, text_col, stratum_col), "features")
    known = labels.where(F.col(quality_col).isNotNull()).select(F.col(id_col).alias("known_id"), (F.col(quality_col) == 1).alias("good"))
    held_out = rows.where(~F.col("base_failed")).join(known, F.col("id") == F.col("known_id"))
    cuts = select_cutoffs(held_out, cutoffs, risk, confidence).withColumnRenamed("stratum", "cut_stratum")
    out = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    bad = F.lit(False)
    for name in cutoffs:
        bad = bad | F.coalesce(_value(name) > F.col(f"cut_{name}"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def quality_sql(cutoffs: dict[str, tuple[float, ...]] | None = None, risk: float = RISK, confidence: float = CONFIDENCE) -> str:
    """judge() over documents and labels in DuckDB SQL."""
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    shares = {"symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word_length": "word_chars / greatest(n_words, 1)"}
    known = chains(cutoffs)
    grid = ", ".join(f"({lax - 1000 * c}, {', '.join(f'CAST({rule.get(name, 'NULL')} AS DOUBLE)' for name in cutoffs)})" for c, chain in enumerate(known) for lax, rule in enumerate(chain))
    over = lambda t: "(" + " OR ".join(f"coalesce({shares[name]} > {t}.cut_{name}, false)" for name in cutoffs) + ")"
    names = ", ".join(f"cut_{name}" for name in cutoffs)
    return f"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, pos, ws[pos] || chr(1) || ws[pos + 1] || chr(1) || ws[pos + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS pos FROM w)),
twice AS (SELECT doc_id, pos FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS spot FROM twice) GROUP BY doc_id),
f0 AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f0),
known AS (SELECT f.*, l.quality = 1 AS good FROM f JOIN labels l ON l.doc_id = f.doc_id WHERE l.quality IS NOT NULL AND NOT base_failed),
tested AS (SELECT stratum, rank, {names}, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND {over("c")}) AS k,
  count(*) FILTER (NOT good AND {over("c")}) AS b FROM known, (VALUES {grid}) c(rank, {names}) GROUP BY stratum, rank, {names}),
bounds AS (SELECT *, b / greatest(n_bad, 1) - k / greatest(n, 1) AS gain, CASE WHEN k >= n * {risk!r} THEN 1.0 ELSE list_sum(list_transform(range(CAST(greatest(0, k - 200 - floor(40 * sqrt(k))) AS BIGINT), k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) END AS tail,
  {1 - confidence!r} / ({len(known)} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM known))) AS allowed FROM tested),
used AS (SELECT * FROM bounds WHERE tail <= allowed AND gain >= {LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rank DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT {over("u")} AS kept
FROM f LEFT JOIN used u ON u.stratum IS NOT DISTINCT FROM f.stratum
"""
