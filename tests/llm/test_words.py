"""Substring dedup, SimHash and quality rules against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from specloom.llm import common, components, quality_rules, simhash_dedup, substring_dedup

KIND = "doc_id long, text string, lang string, n_words int, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], KIND)


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 40))
    passages = [[word() for _ in range(r.randint(45, 90))] for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n\t ")]
    for i in range(3, 60):
        w = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(w))
            w[k:k] = r.choice(passages)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    return rows + [(70, rows[20][1]), (71, rows[20][1]), (71, rows[20][1]), (72, rows[9][1] + " x")]


def test_substring_dedup(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    seen = {}
    for i, t in rows:
        w = (t or "").split()
        covered = [False] * len(w)
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), i) < i:
                covered[j : j + 50] = [True] * 50
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        assert got[i] == (len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest()), i
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_cover():
    p = substring_dedup.PERIOD
    assert {(a - b) % p for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(p))


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    r = random.Random(3)
    rows = corpus()
    for k in range(40):  # near copies
        w = rows[10][1].split()
        w[r.randrange(len(w))] = "É" + str(k)
        rows.append((100 + k, " ".join(w)))
    got = {x.doc_id: (x.fp % (1 << 64), x.component_id) for x in simhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    ids = [i for i, _ in rows]
    fp = [brute_print(t) for _, t in rows]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    for k, i in enumerate(ids):
        assert got[i] == (fp[k], min(ids[m] for m in range(len(ids)) if find(m) == find(k)))
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_blocks_and_sections():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 64, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (40, 4), dtype=np.uint64), axis=1)
    both = np.concatenate([base, base ^ flips])
    found = {(int(i), int(j)) for x, y in simhash_dedup.links(both, None) for i, j in zip(x, y)}
    assert found == {(i, j) for i in range(80) for j in range(i + 1, 80) if int(both[i] ^ both[j]).bit_count() <= 4}
    for n in (10, 1 << 23, 1 << 40):
        masks = np.array(simhash_dedup.sections(n), dtype=np.uint64)
        assert ((flips[:, None] & masks[None, :]) == 0).any(1).all()


def test_features(spark):
    rows = [*corpus(), (200, "a b c a b c x\n\nx y\nx y\n \n#$ <b>"), (201, "w " * 400), (202, "one two"), (None, "x")]
    docs = frame(spark, rows).drop("n_words")
    for got in quality_rules.with_features(docs).collect():
        t = next(t for i, t in rows if i == got.doc_id) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def test_risk_control(spark):
    from math import comb

    f = spark.range(1).selectExpr("3L AS k", "40L AS n")
    got = f.select(quality_rules.binomial_cdf(f.k, f.n, 0.2).alias("p")).first().p
    assert abs(got - sum(comb(40, i) * 0.2**i * 0.8 ** (40 - i) for i in range(4))) < 1e-9
    r = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 3 == 0
        rows.append((i, " ".join(("%%%" if bad else "") + r.choice("abcdefgh") * r.randint(1, 5) + str(r.randint(0, 999)) for _ in range(60))))
        labels.append((i, 0 if bad else 1))
    docs = frame(spark, rows).drop("n_words").withColumnRenamed("lang", "stratum")
    kept = {x.doc_id: x.kept for x in quality_rules.judge(quality_rules.with_features(docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum(kept[i] for i, q in labels if q == 0) == 0
    assert sum(not kept[i] for i, q in labels if q == 1) <= 0.01 * 4000
    few = {x.doc_id: x.kept for x in quality_rules.judge(quality_rules.with_features(docs), spark.createDataFrame(labels[:30], "doc_id long, quality int")).collect()}
    assert all(few.values())  # too few labels for a bound: every rule is off


def test_equal_words_not_equal_hashes(spark):
    """Words that collide under any polynomial modulo 2 ** 64 are different words."""
    thue = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))
    same = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*same, thue])), (2, " ".join([*same, other])), (3, " ".join([*same, thue])), (None, " ".join([*same, thue])), (4, "x " * 30_000), (5, "x " * 60)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (50, 0), 2: (50, 0), 3: (50, 50), None: (50, 0), 4: (30_000, 0), 5: (60, 60)}


def test_keys_are_settled_alike_in_any_split(spark, monkeypatch):

    parts = [substring_dedup._settle_later, substring_dedup._settle_shared]
    r = np.random.default_rng(2)
    for settle, read in zip(parts, (substring_dedup._later, substring_dedup._shared)):
        h, doc, pos = r.integers(0, 40, 400), r.integers(0, 12, 400), np.arange(400)
        out = []
        for cut in range(0, 400, 57):
            at = slice(cut, cut + 57)
            out += [dict(zip(b.schema.names, c)) for b in settle(h[at], h[at] * 0, doc[at], pos[at]) for c in zip(*(x.to_pylist() for x in b.columns))]
        out.sort(key=lambda x: (x["done"], x["h1"], x["h2"], x["doc"]))
        import pyarrow as pa

        kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("done", pa.bool_()), ("doc", pa.int64()), ("pos", pa.int32())])
        batches = [pa.RecordBatch.from_pylist(out[i : i + 31], schema=kind) for i in range(0, len(out), 31)]
        got = sorted((d, p) for b in read(iter(batches)) for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        docs = {k: set(doc[h == k].tolist()) for k in set(h.tolist())}
        want = [(int(d), int(p)) for k, d, p in zip(h, doc, pos) if (d > min(docs[int(k)]) if settle is parts[0] else len(docs[int(k)]) > 1)]
        assert got == sorted(want)


def test_null_ids_and_repeated_rows_of_simhash(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "lone words of no one else"), (3, None), (9, "")]
    got = sorted(((x.doc_id, x.component_id) for x in simhash_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (3, 3), (9, 3)], key=str)


def test_holm_is_the_step_down(spark):
    r = random.Random(6)
    chains = [(f"s{i // 3}", f"r{i % 3}", [(r.choice([0.0001, 0.003, 0.02, 0.5]), r.randint(0, 9), 1.0 - j / 10) for j in range(4)]) for i in range(12)]
    kind = "stratum string, rule string, tests array<struct<p:double,bad:long,cut:double>>"
    got = {(x.stratum, x.rule): x.cut for x in quality_rules.holm(spark.createDataFrame(chains, kind), 0.1).collect()}
    order = sorted(chains, key=lambda c: (max(t[0] for t in c[2]), c[1], c[0]))
    done = 0
    while done < 12 and max(t[0] for t in order[done][2]) <= 0.1 / (12 - done):
        done += 1
    for k, (s, rule, tests) in enumerate(order):
        passed = []
        for t in tests:
            if k >= done and t[0] > 0.1 / max(1, 12 - done):
                break
            passed.append(t)
        good = [t for t in passed if t[1] > 0]
        assert got[s, rule] == (max((t[1], t[2]) for t in good)[1] if good else None)


def test_risk_is_kept_in_simulation():
    """A chain at a rate just above its share passes about as often as the level allows, not more."""
    from math import comb

    r, n, share, level = np.random.default_rng(4), 500, 0.02, 0.05
    tail = [sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) for k in range(30)]
    k = r.binomial(n, share * 1.0001, 20_000)
    assert np.mean([x < 30 and tail[x] <= level for x in k]) <= level


def test_cutoffs_are_chosen_on_the_given_tables(spark):
    import os

    import pytest

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("stratum"), "text").repartition(16)
    cuts = {x.stratum: x for x in quality_rules.thresholds(common.cut(quality_rules.with_features(docs).drop("text")), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert cuts["en"].symbols is not None and cuts["en"].word_length is not None


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(-60, 0)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(220)] + [(5000, k) for k in range(5001, 5050)] + [(7, 7), (-(1 << 63), (1 << 63) - 1)]
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want = {}
    for a in sorted(around):
        reach, open_ = {a}, [a]
        while open_:
            new = around[open_.pop()] - reach
            reach |= new
            open_ += new
        if min(reach) < a:
            want[a] = min(reach)
    table = spark.createDataFrame(edges + edges[:9], "a long, b long")
    spark.sparkContext.setJobGroup("one-task", "")
    one = components.roots(table).collect()
    spark.sparkContext.setJobGroup("rounds", "")
    rounds = components.roots(table, block=0).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(x) for x in one) == sorted(tuple(x) for x in rounds) == sorted(want.items())
    # few links cost the driver few jobs
    jobs = {g: len(spark.sparkContext.statusTracker().getJobIdsForGroup(g)) for g in ("one-task", "rounds")}
    assert jobs["one-task"] <= 8 < jobs["rounds"]
    assert components.roots(table.limit(0)).count() == 0
