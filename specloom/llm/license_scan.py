"""License scans: Dice coefficient over word bigrams against license templates, in DataFrame functions only.

Texts and templates are normalised (lower case, runs of other characters than letters and digits are one space).
Candidates are the whole text, every line, every sentence of a line, and, from the beginning of each of these, as many
words as a template of LONG words or more has (in steps of about a seventh), so that a license is found wherever in a
text it begins and however its lines are broken. 2 |A and B| / (|A| + |B|) can reach t only if t / (2 - t) <=
|A| / |B| <= (2 - t) / t, so a template is compared only with candidates whose number of bigrams lies within these
bounds; sets of bigrams meet inside the row, so nothing is shuffled.

Of the candidates that begin at one word of a line the one with the highest score is reported (of equals the longest);
the whole text is reported as line 0.

Defined results: null and empty texts hold no license; a candidate of one word is compared as its only "bigram"; of
templates with equal scores the first in name order is taken; the same license at two places is reported once for each;
without templates nothing is found; repeated rows are rows of their own; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .licenses import templates

THRESHOLD, LONG = 0.8, 20
#: Words that tell nothing about a text (fixed values).
FREQUENT = frozenset("a an and any by for in is it of on or that the this to with you".split())
#: Where a line's sentences part (fixed pattern; what is matched ends the sentence).
_ENDS = r"([.!?;:])[ \t\x0B\f\r]+"


def words_of(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    """The distinct word bigrams, as the scan forms them."""
    return sorted(set([" ".join(p) for p in zip(words, words[1:])] or words))


def spans(known: list[tuple[str, str]]) -> list[int]:
    """The numbers of words of the windows: for every long template one that differs by a seventh at most."""
    out: list[int] = []
    for n in sorted({len(words_of(t)) for _, t in known}):
        if n >= LONG and (not out or n > out[-1] * 8 / 7):
            out.append(n)
    return out


def marks(bigrams: list[list[str]], threshold: float, spare: int = 0) -> list[str]:
    """Words (and, where these are too few, bigrams) of which every text that matches one of bigrams holds more than spare.

    A match shares t / (2 - t) of a template's bigrams at least. So parts of words are chosen, of longer words and those
    that many bigrams have first, until even without the spare best of them the bigrams that hold none are too few.
    """
    often, chosen = Counter(b for own in bigrams for b in own), []
    holds = lambda b, ms: any(b == m if " " in m else any(m in w for w in b.split()) for m in ms)
    for own in bigrams:
        need = threshold / (2 - threshold) * len(own)
        while True:
            left = list(chosen)
            for _ in range(min(spare, len(left))):
                left.remove(max(left, key=lambda m: sum(holds(b, [m]) for b in own)))
            free = [b for b in own if not holds(b, left)]
            if len(free) < need or not free:
                break
            rare = lambda w: len(w) > 5 or (any(c.isdigit() for c in w) and any(c.isalpha() for c in w))
            words = Counter(w for b in own for w in set(b.split()) if rare(w) and not holds(w, chosen))
            some = [b for b in own if b not in chosen and " " in b]
            if words:
                chosen.append(max(words, key=lambda w: (words[w] if spare else 0, len(w), w)))
            elif some:
                chosen.append(max(some, key=lambda b: (not set(b.split()) <= FREQUENT, often[b], b)))
            else:
                chosen.append(max(free, key=len))
                if spare:
                    return []  # too short to spare any
    return chosen


def _marked(vocabulary: set[str], some: list[str]) -> list[str]:
    """The words, one of which (or of a pair's) stands for each mark in normalised texts."""
    return sorted({v for v in vocabulary if any(m in v for m in some if " " not in m)} | {max(m.split(), key=lambda w: (w not in FREQUENT, len(w))) for m in some if " " in m} or vocabulary)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+", -1), lambda w: w != "")


def _grams(w: Column) -> Column:
    m = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.when(F.size(w) == 1, w).otherwise(F.zip_with(F.slice(w, 1, m), F.slice(w, 2, m), lambda a, b: F.concat_ws(" ", a, b))))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 1; 0 for the whole text), word (its first word's place in the text, from 0), n_words, license,
    score (Dice, 6 digits) per place that matches. known: (license, text), the usual ones by default."""
    known = templates() if known is None else known
    sizes = spans(known)
    table = sorted({(n, tuple(bigrams_of(words_of(t)))) for n, t in known if words_of(t)})
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    if not table:
        return rows.where("false").select("doc_id", *[F.lit(None).cast(k).alias(c) for c, k in (("line", "int"), ("word", "int"), ("n_words", "int"), ("license", "string"), ("score", "double"))])
    several = 3  # a text that matches a long template holds so many marks at least
    vocabulary = {w for _, b in table for x in b for w in x.split()}
    short, long = [list(b) for _, b in table if len(b) < LONG * low], [list(b) for _, b in table if len(b) >= LONG * low]
    spared = marks(long, threshold, several - 1)
    several = several if spared else 1
    words = lambda x: F.lit(x) if x else F.array().cast("array<string>")
    any_of, some_of = words(_marked(vocabulary, marks(short, threshold)) if short else []), words(_marked(vocabulary, spared) if long else [])
    # Cheap and lossless: texts that hold too few marks match nothing. The array of one makes each text be split once.
    seen = F.array(F.array_intersect(F.array_union(any_of, some_of), F.split(F.lower("_t"), "[^0-9a-z]+", -1)))
    many = lambda held: F.size(F.array_intersect(some_of, held)) >= several
    rows = rows.where(F.exists(seen, lambda held: F.arrays_overlap(any_of, held) | many(held))).withColumn("_long", F.exists(seen, many))
    # Each line as its sentences' words; places count words of the text.
    sentence = lambda x: F.filter(F.transform(F.split(F.regexp_replace(x, _ENDS, "$1\n"), "\n", -1), _words), lambda w: F.size(w) > 0)
    rows = rows.withColumn("_p", F.transform(F.split("_t", "\n", -1), sentence)).withColumn("_w", F.flatten(F.flatten("_p")))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    lines = F.transform("_p", lambda x, i: F.struct((i + 1).cast("int").alias("line"), F.transform(x, lambda w: F.size(w)).alias("sizes")))
    none = F.expr("struct(0 as at, cast(array() as array<struct<line:int,at:int,ns:array<int>>>) as found)")

    def step(acc, x):
        own = F.transform(x["sizes"], lambda n, i: F.struct(x["line"].alias("line"), (acc["at"] + total(F.slice(x["sizes"], 1, i))).cast("int").alias("at"), F.when(i == 0, F.array(n, total(x["sizes"]))).otherwise(F.array(n)).alias("ns")))
        return F.struct((acc["at"] + total(x["sizes"])).alias("at"), F.concat(acc["found"], own).alias("found"))

    here = F.aggregate(lines, none, step)["found"]
    whole = F.array(F.struct(F.lit(0).alias("line"), F.lit(0).alias("at"), F.array(F.size("_w")).alias("ns")))
    rows = rows.withColumn("_x", F.explode(F.concat(whole, here))).select("doc_id", "_long", "_x.line", F.col("_x.at").alias("word"), F.col("_x.ns").alias("_ns"), "_w")
    windows = F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")
    fits = F.when(F.col("_long") & (F.col("line") > 0), F.filter(windows, lambda n: F.col("word") + n <= F.size("_w"))).otherwise(F.array().cast("array<int>"))
    smallest, largest = min(len(b) for _, b in table) * low, max(len(b) for _, b in table) * high
    # n words have n - 1 bigrams at most, and a long text may have few distinct ones: only the lower bound holds for n.

    def worth(n):
        own = F.slice("_w", F.col("word") + 1, n)
        return (F.greatest(n - 1, F.lit(1)) >= smallest) & (F.arrays_overlap(own, any_of) | (F.col("_long") & many(own)))

    wanted = F.filter(F.array_distinct(F.concat("_ns", fits)), worth)
    rows = rows.withColumn("_ns", wanted).where(F.size("_ns") > 0)
    rows = rows.withColumn("_g", F.transform("_ns", lambda n: F.struct(n.alias("n"), _grams(F.slice("_w", F.col("word") + 1, n)).alias("b")))).drop("_w", "_ns")
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    against = F.expr("array(" + ", ".join(f"named_struct('license', {text(n)}, 'b', array({', '.join(map(text, b))}), 'o', {-i})" for i, (n, b) in enumerate(table)) + ")")

    def scores(g):
        near = F.filter(against, lambda k: F.size(g["b"]).between(F.size(k["b"]) * low, F.size(k["b"]) * high) & F.arrays_overlap(g["b"], k["b"]))
        return F.transform(near, lambda k: F.struct((F.lit(2.0) * F.size(F.array_intersect(g["b"], k["b"])) / (F.size(g["b"]) + F.size(k["b"]))).alias("score"), g["n"].alias("n"), k["o"].alias("o"), k["license"].alias("license")))

    # A match shares t / (2 - t) of its own bigrams too, hence with all templates together.
    shared = words(sorted({x for _, b in table for x in b}))
    fitting = F.filter("_g", lambda g: F.size(g["b"]).between(smallest, largest) & (F.size(F.array_intersect(shared, g["b"])) >= F.size(g["b"]) * low))
    rows = rows.withColumn("_best", F.array_max(F.flatten(F.transform(fitting, scores)))).where(F.col("_best.score") >= threshold)
    return rows.select("doc_id", "line", "word", F.col("_best.n").alias("n_words"), "_best.license", F.round("_best.score", 6).alias("score"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same scan in DuckDB SQL, without its filters: all candidates, joined to the templates by bigram."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = templates()
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in known)
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    words = lambda x: f"list_filter(string_split_regex(lower({x}), '[^0-9a-z]+'), lambda w: w <> '')"
    grams = lambda w: f"list_distinct(CASE WHEN len({w}) = 1 THEN {w} ELSE list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) END)"
    return f"""
WITH t AS (SELECT DISTINCT license, list_sort({grams('w')}) AS b FROM (SELECT n AS license, {words('x')} AS w FROM (VALUES {values}) a(n, x)) WHERE len(w) > 0),
known AS (SELECT row_number() OVER (ORDER BY license, b) AS o, license, len(b) AS m, unnest(b) AS g FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS x FROM d),
s AS (SELECT r, doc_id, line, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS w FROM (SELECT r, doc_id, line, list_filter(list_transform(string_split(regexp_replace(x, '([.!?;:])[ \t\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)), lambda y: {words('y')}), lambda y: len(y) > 0) AS p FROM l)),
pl AS (SELECT *, len(w) AS n, sum(len(w)) OVER (PARTITION BY r ORDER BY line, k) - len(w) AS word, sum(len(w)) OVER (PARTITION BY r, line) AS nl, row_number() OVER (PARTITION BY r, line ORDER BY k) AS first FROM s),
full_ AS (SELECT r, flatten(list(w ORDER BY line, k)) AS w FROM s GROUP BY r),
c AS (SELECT r, doc_id, line, word, n FROM pl UNION SELECT r, doc_id, line, word, nl FROM pl WHERE first = 1 UNION SELECT DISTINCT r, doc_id, 0, 0, len(full_.w) FROM pl JOIN full_ USING (r)
  UNION SELECT r, doc_id, line, word, z FROM pl JOIN full_ USING (r), (SELECT unnest({spans(known)!r}) AS z) WHERE word + z <= len(full_.w)),
g AS (SELECT r, doc_id, line, word, n, {grams('x')} AS b FROM (SELECT c.*, w[(word + 1)::BIGINT:(word + n)::BIGINT] AS x FROM c JOIN full_ USING (r))),
m AS (SELECT r, doc_id, line, word, n, len(b) AS nb, unnest(b) AS g FROM g),
h AS (SELECT r, doc_id, line, word, n, o, license, 2.0 * count(*) / (any_value(nb) + any_value(m)) AS score FROM m JOIN known USING (g) WHERE nb BETWEEN m * {low!r} AND m * {high!r} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r, line, word ORDER BY score DESC, n DESC, o) AS k FROM h WHERE score >= {THRESHOLD})
SELECT doc_id, line, word::INT AS word, n::INT AS n_words, license, round(score, 6) AS score FROM k WHERE k = 1"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {"op1_license_scan": _sql()}
