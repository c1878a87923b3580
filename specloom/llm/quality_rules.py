"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base features are counted per text. Rules compare a ratio of them with a cutoff. Which cutoff a rule may use in a
stratum (language) is decided on labelled holdout documents. A cutoff's p-value is the exact binomial tail
P(X <= rejected good documents | good documents, alpha / rules): if it is at most some level, the exact
(Clopper-Pearson) upper bound of that confidence on the false rejection rate stays within the rule's share of alpha, and
the rules' shares add up to alpha per stratum.

The cutoffs of a rule are nested, so they are tested in a fixed sequence from the loosest on and testing stops at the
first that fails; such a chain needs no correction inside. Over the chains (every rule in every stratum) the level delta
is spent once, by Holm's step-down: each of m chains has delta / m, and a chain that passes to its end hands its level
to those still open, so with k passed chains the others have delta / (m - k). All chosen cutoffs hold together with
probability 1 - delta at least. Of the cutoffs passed the one that rejects most bad holdouts is taken (the loosest of
equals); a rule that passes none, or rejects no bad holdout, is off in that stratum.

Defined results: null text is an empty one (base_failed); a null language is a stratum of its own; labels without a
quality or without a document say nothing; repeated labels count as often as they occur; without labels every rule is
off; a stratum without labels has all rules off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The white space of the word pattern [^\x20\x09-\x0D]+ and the counted symbols (fixed values).
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Of a stratum's good documents at most this share may be rejected, with this risk that some cutoff breaks it.
ALPHA, DELTA = 0.02, 0.1
#: Rule: ratio of base features, and the cutoffs above which a text would be rejected.
RULES = {
    "symbols": (("n_symbols", "n_words"), (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    "word_length": (("word_chars", "n_words"), (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0)),
    "dup_lines": (("n_dup_lines", "n_lines"), (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)),
    "repeats": (("n_repeat_words", "n_words"), (0.15, 0.2, 0.25, 0.3, 0.4)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts under COUNTS (which must be free names). Every step is linear or n log n in the text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.translate(t, SPACE, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    out = docs.withColumns({
        "_q_words": F.filter(F.split(t, "[\\x20\\x09-\\x0D]+", -1), lambda x: x != ""),
        "_q_lines": lines,
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
    })
    out = out.withColumn("n_words", F.size("_q_words").cast("long"))
    out = out.withColumn("n_lines", F.size("_q_lines").cast("long"))
    out = out.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_q_lines")))
    m = F.greatest(F.size("_q_words") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("_q_words", 1, m), F.slice("_q_words", 2, m), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_q_keys", F.zip_with(pairs, F.slice("_q_words", 3, m), lambda h, c: F.xxhash64(h, c)))
    #: Only a text with a repeated window is sorted; equal windows stand side by side in (hash, position) order.
    repeated = F.size(F.array_distinct("_q_keys")) < F.size("_q_keys")
    keyed = F.transform("_q_keys", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.drop("_q_words", "_q_lines").withColumn("_q_sorted", F.when(repeated, F.array_sort(keyed)).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>")))
    k = F.greatest(F.size("_q_sorted") - 1, F.lit(0))
    same = F.zip_with(F.slice("_q_sorted", 1, k), F.slice("_q_sorted", 2, k), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.drop("_q_keys").withColumn("_q_at", F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    p = F.greatest(F.size("_q_at") - 1, F.lit(0))
    covered = F.zip_with(F.slice("_q_at", 1, p), F.slice("_q_at", 2, p), lambda a, b: F.least(b - a, F.lit(3)))
    total = F.aggregate(covered, F.lit(0), lambda acc, x: acc + x) + F.lit(3)
    out = out.drop("_q_sorted").withColumn("n_repeat_words", F.when(F.size("_q_at") > 0, total).otherwise(F.lit(0)).cast("long"))
    return out.drop("_q_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule][0]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed term by term in logarithms."""
    start = n.cast("double") * F.log(F.lit(1.0 - p))
    zero = F.struct(start.alias("term"), F.exp(start).alias("sum"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.log(F.lit(p / (1.0 - p)))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, zero, step)["sum"]


def thresholds(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, symbols, word_length, ...): the chosen cutoff of each rule, null where the rule is off."""
    held = labels.select(F.col("doc_id").alias("_l_id"), F.col("quality").alias("_l_quality")).where("_l_quality is not null")
    rows = features.where(~base_failed()).join(held, F.col("doc_id") == F.col("_l_id"))
    good = F.col("_l_quality") == 1
    counts = [F.count_if(good).alias("good")]
    for rule, (_, cutoffs) in RULES.items():
        for i, c in enumerate(cutoffs):
            counts += [F.count_if(good & (_ratio(rule) > c)).alias(f"{rule}_{i}_good"), F.count_if(~good & (_ratio(rule) > c)).alias(f"{rule}_{i}_bad")]
    found = common.cut(rows.groupBy("stratum").agg(*counts))  # one row per stratum
    chains = None
    for rule, (_, cutoffs) in RULES.items():
        loosest_first = sorted(enumerate(cutoffs), key=lambda x: -x[1])
        tests = [F.struct(_tail(F.col(f"{rule}_{i}_good"), F.col("good"), alpha / len(RULES)).alias("p"), F.col(f"{rule}_{i}_bad").alias("bad"), F.lit(float(c)).alias("cut")) for i, c in loosest_first]
        chain = found.select("stratum", F.lit(rule).alias("rule"), F.array(*tests).alias("tests"))
        chains = chain if chains is None else chains.unionByName(chain)
    chosen = holm(chains, delta)
    cuts = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut"))
    return cuts.select("stratum", *RULES)


def _tail(k: Column, n: Column, p: float) -> Column:
    """The p-value of "the rate is above p" for k of n; 1 where no exact bound can hold (k at the mean or above)."""
    return F.when((n > 0) & (k < n * p), F.least(F.lit(1.0), binomial_cdf(k, n, p))).otherwise(F.lit(1.0))


def holm(chains: DataFrame, delta: float) -> DataFrame:
    """(stratum, rule, cut) per chain of tests (array of p, bad, cut; loosest first). One row per stratum and rule."""
    total, order = Window.partitionBy(), Window.partitionBy().orderBy("_worst", "rule", F.col("stratum").asc_nulls_first())
    m = F.count(F.lit(1)).over(total)
    ranked = chains.withColumn("_worst", F.array_max(F.transform("tests", lambda x: x["p"]))).withColumns({"_m": m, "_rank": F.row_number().over(order)})
    ranked = ranked.withColumn("_ok", F.min((F.col("_worst") <= delta / (F.col("_m") - F.col("_rank") + 1)).cast("int")).over(order))
    ranked = ranked.withColumn("_level", delta / F.greatest(F.lit(1), F.col("_m") - F.sum("_ok").over(total)))
    fails = F.array_position(F.transform("tests", lambda x: (x["p"] > F.col("_level")) & (F.col("_ok") == 0)), True)
    passed = F.slice("tests", 1, F.when(fails > 0, fails - 1).otherwise(F.size("tests")).cast("int"))
    options = F.transform(F.filter(passed, lambda x: x["bad"] > 0), lambda x: F.struct(x["bad"].alias("bad"), x["cut"].alias("cut")))
    return ranked.select("stratum", "rule", F.array_max(options)["cut"].alias("cut"))


def judge(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """features (doc_id, stratum, COUNTS, anything else) with base_failed and kept."""
    chosen = thresholds(features, labels, alpha, delta)
    chosen = chosen.select(F.col("stratum").alias("_t_stratum"), *[F.col(r).alias(f"_t_{r}") for r in RULES])
    joined = features.join(chosen, F.col("stratum").eqNullSafe(F.col("_t_stratum")), "left")
    rejected = [F.coalesce(_ratio(r) > F.col(f"_t_{r}"), F.lit(False)) for r in RULES]
    verdict = ~base_failed()
    for x in rejected:
        verdict &= ~x
    return joined.withColumns({"base_failed": base_failed(), "kept": verdict}).drop("_t_stratum", *[f"_t_{r}" for r in RULES])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("stratum"), "text")
    features = common.cut(with_features(docs).drop("text"))
    out = judge(features, common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The counts, the tests of all cutoffs and the verdict in DuckDB SQL."""
    ratios = {rule: f"{top}::DOUBLE / greatest({bottom}, 1)" for rule, ((top, bottom), _) in RULES.items()}
    tests = " UNION ALL ".join(f"SELECT '{rule}' AS rule, {-c!r} AS o, {c!r} AS cut, doc_id, {ratio} > {c!r} AS hit FROM b" for rule, (_, cutoffs) in RULES.items() for ratio in [ratios[rule]] for c in map(float, cutoffs))
    share = ALPHA / len(RULES)
    rejected = " OR ".join(f"coalesce({ratios[rule]} > (SELECT any_value(cut) FROM chosen WHERE rule = '{rule}' AND stratum IS NOT DISTINCT FROM b.stratum), false)" for rule in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT r, i, w[i:i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, k HAVING count(*) > 1), (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
b AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM d JOIN l USING (r) LEFT JOIN c USING (r)),
held AS (SELECT b.doc_id, stratum, quality = 1 AS good FROM b JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT base_failed),
tests AS ({tests}),
counts AS (SELECT stratum, rule, o, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS bad FROM held JOIN (SELECT DISTINCT * FROM tests) USING (doc_id) GROUP BY ALL),
p AS (SELECT *, CASE WHEN n > 0 AND k < n * {share!r} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) ELSE 1.0 END AS p FROM counts),
worst AS (SELECT stratum, rule, max(p) AS worst, count(*) OVER () AS m, row_number() OVER (ORDER BY max(p), rule, stratum NULLS FIRST) AS rank FROM p GROUP BY stratum, rule),
ok AS (SELECT *, bool_and(worst <= {DELTA!r} / (m - rank + 1)) OVER (ORDER BY rank) AS ok FROM worst),
level AS (SELECT *, {DELTA!r} / greatest(1, m - count(*) FILTER (ok) OVER ()) AS level FROM ok),
passed AS (SELECT p.*, bool_and(ok OR p <= level) OVER (PARTITION BY p.stratum, p.rule ORDER BY o) AS passed FROM p JOIN level ON p.rule = level.rule AND p.stratum IS NOT DISTINCT FROM level.stratum),
chosen AS (SELECT stratum, rule, arg_max(cut, struct_pack(bad := bad, cut := cut)) AS cut FROM passed WHERE passed AND bad > 0 GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept FROM b"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {"op9_quality_rules": _sql()}
