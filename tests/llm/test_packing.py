import random
from collections import Counter

import numpy as np
import pytest

from specloom.llm import packing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def ids(text):
    t = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encode_is_the_library():
    r = random.Random(1)
    t = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    parts = [" ", " ", " ", "\n", "\t", "a", "bc", "Zoë", "1", "é", "'s", "!", ",", " ", "　", "\x1c", "<|endoftext|>", ".", "\0", " \n", "word", "ǆ", "***", "_", "\u0301", "½"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        assert packing.encode(x, packing.tokenizer_path()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_plan_holds_all_pieces():
    r = random.Random(2)
    for _ in range(60):
        counts = dict(Counter(min(100, int(r.expovariate(1 / 20)) + 1) for _ in range(r.randint(0, 300))))
        bins = packing.plan(counts, 100)
        got = sum((Counter({k: n * t for k, n in Counter(b).items()}) for b, t in bins), Counter())
        assert got == Counter(counts) and all(sum(b) <= 100 for b, _ in bins)
        total = sum(k * v for k, v in counts.items())
        assert sum(t for _, t in bins) <= max(1, -(-total // 100)) * 1.25 + 1


def test_fill_beats_best_fit():
    assert sum(packing.fill(10, [3, 4, 5, 6], {3: 2, 4: 1, 5: 2, 6: 1})) == 10


def test_pack(spark):
    rows = [(0, "a b c " * 900), (1, ""), (2, None), (3, "short text"), (3, "short text"), (None, "no id")]
    docs = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, length string")
    out = packing.pack(docs, packing.tokenizer_path()).collect()
    assert sum(r["length"] for r in out) == sum(len(ids(t or "")) // 4 + 1 for _, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(docs.limit(0), packing.tokenizer_path()).count() == 0


def size(bins):
    return sum(t for _, t in bins)


def test_plan_branches_on_fillings():
    bins = packing.plan({676: 51, 539: 14, 372: 44, 238: 22, 198: 54}, 1024)
    assert size(bins) <= 82  # the fullest bins first, used as often as the counts allow, give 86
    assert sum((Counter({k: n * t for k, n in Counter(b).items()}) for b, t in bins), Counter()) == {676: 51, 539: 14, 372: 44, 238: 22, 198: 54}


def test_plan_is_optimal_on_small_tables():
    def least(pieces, bins=()):  # brute force
        if not pieces:
            return len(bins)
        x, rest = pieces[0], pieces[1:]
        fits = {b for b in bins if b + x <= 20}
        swap = lambda b: tuple(sorted([*bins[: bins.index(b)], *bins[bins.index(b) + 1 :], b + x]))
        return min([least(rest, swap(b)) for b in fits] + [least(rest, (*bins, x))])

    r = random.Random(9)
    for _ in range(60):
        pieces = sorted((r.randint(2, 14) for _ in range(r.randint(1, 7))), reverse=True)
        bins = packing.plan(dict(Counter(pieces)), 20)
        assert size(bins) == least(pieces) >= packing.least_bins(Counter(pieces), 20)


def test_fill_is_exact():
    r = random.Random(10)
    for _ in range(200):
        counts = {r.randint(3, 60): r.randint(1, 4) for _ in range(6)}
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = packing.fill(100, sorted(counts), counts)
        assert sum(got) == max(s for s in sums if s <= 100) and not Counter(got) - Counter(counts)
