"""Best-fit packing of token sequences by bin completion.

All that packing depends on is how many pieces there are of each length, a table with at most ``capacity`` rows whatever
the input. Two packings of that table are incumbents: best fit decreasing, and bins filled with the least waste around
the largest piece left (an exact sum over lengths). A branch and bound betters them: it branches over the undominated
fillings around the largest piece left and how often each is used, and cuts what wastes more than a packing of fewer
bins could. It ends at a lower bound of the bins, when no better packing exists, or after a set number of steps without
one; bin packing is NP-hard, so a large table may end that way, with the best packing found. Equal bins are handled at
once, so the work grows with the number of lengths, not with the number of pieces.

Pieces get their places without ranking a whole length in one task: ranks are counted per (length, bucket of doc_id),
and the buckets' starts are summed over a table of bounded size.

Defined results: null text is an empty one; every document ends with the end id, so none is without a piece; a row
without doc_id is packed like any other; repeated rows are packed once each.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY, END = 1024, 2
#: Entries a worker's memo of encoded chunks may hold before it is started anew.
MEMO = 1_000_000
_memos: dict[str, _Memo] = {}
#: A word and marks after it; a mark is no letter, digit or white space, and the first one no apostrophe.
_MARKED = re.compile(r"([^\W\d_]+)([^\w\s'][^\w\s]*)\Z")
#: A run of white space that holds a space with white space on both sides: there, cutting at spaces is not exact.
_RUN = re.compile(r"\s \s")


class _Memo(dict):
    """Chunk (without the space before it) -> its ids as little-endian unsigned 32-bit bytes, encoded when first met."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids whose first letter stands for a space
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def learn(self, chunks: set[str]) -> None:
        """Encode the unknown words among chunks in one go; each begins at an id that begins with a space."""
        words = dict.fromkeys(m[1] if (m := _MARKED.match(c)) else c for c in chunks)
        words = [w for w in words if w.isalpha() and w not in self]
        if len(words) < 2:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.begins[ids]).tolist()
        if len(at) == len(words):
            b = ids.tobytes()
            for w, i, j in zip(words, at, [*at[1:], len(ids)]):
                self[w] = b[4 * i : 4 * j]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        m = _MARKED.match(chunk)
        head, line, tail = chunk.partition("\n")
        if m and m[1].isalpha():  # a word and the marks after it are tokens of their own
            out = self[m[1]] + self.mark(m[2])
        elif line and head and tail and not head[-1].isspace() and not tail[0].isspace():  # so is a lone line feed
            m = _MARKED.match(tail)
            out = self[head] + self.mark("\n") + (self.mark(m[1]) + self.mark(m[2]) if m and m[1].isalpha() else self.mark(tail))
        else:
            out = self.whole(" " + chunk)
        self[chunk] = out
        return out

    def mark(self, c: str) -> bytes:
        """The ids of what stands without a space before it."""
        key = "\0" + c  # no chunk of a text with NUL is looked up here
        found = self.get(key)
        if found is None:
            found = self[key] = self.whole(c)
        return found


def encode(text: str, path: str) -> bytes:
    """The ids of a whole text, little-endian unsigned 32-bit, as the tokenizers library gives them.

    The byte-level pattern never lets a token run over the border before a single space, so the text is cut there and
    each distinct chunk is encoded once per worker. Texts where that does not hold are encoded in one go.
    """
    memo = _memos.get(path)
    if memo is None or len(memo) > MEMO:
        memo = _memos[path] = _Memo(path)
    if "<|" in text or "\0" in text or _RUN.search(text):
        return memo.whole(text)
    head, *rest = text.split(" ")
    new = {c for c in set(rest) if c not in memo}
    if len(new) > 1:
        memo.learn(new)
    return memo.whole(head) + b"".join(map(memo.__getitem__, rest))


def cut_sizes(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and before them what is over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode(text or "", path) + tail
                for k, (s, n) in enumerate(cut_sizes(len(tokens) // 4, capacity)):
                    rows.append((i, k, s, n, zlib.crc32(tokens[4 * s : 4 * (s + n)])))
            at, k, s, n, c = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.record_batch([ids.take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(s), pa.array(n), pa.array(c)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _reach(space: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Per i, the sums up to space that the first i of lengths (at most counts of each) can make, as bits."""
    full, out = (1 << (space + 1)) - 1, [1]
    for x in lengths:
        bits, n, k = out[-1], min(counts[x], space // x), 1
        while n > 0:  # counts as powers of two and a rest
            k = min(k, n)
            bits |= bits << k * x & full
            n, k = n - k, 2 * k
        out.append(bits)
    return out


def fill(space: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The filling of space from ascending lengths (at most counts of each) that wastes least; of these, the one of larger pieces."""
    reach, best = _reach(space, lengths, counts), []
    want = reach[-1].bit_length() - 1
    for i in range(len(lengths) - 1, -1, -1):
        x = lengths[i]
        k = min(counts[x], want // x)
        while not reach[i] >> (want - k * x) & 1:
            k -= 1
        best += [x] * k
        want -= k * x
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The best-fit-decreasing packing, for all bins of equal contents at once."""
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n > 0:
            room = min((r for r in rooms if r >= x), default=capacity)
            held, times = rooms[room].pop() if room in rooms else ([], n)
            if room in rooms and not rooms[room]:
                del rooms[room]
            k = min(room // x, n)
            used = min(times, n // k)
            if held and times > used:
                rooms.setdefault(room, []).append((held, times - used))
            rooms.setdefault(room - k * x, []).append(([*held, *[x] * k], used))
            n -= k * used
    return [b for r in sorted(rooms) for b in rooms[r]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the number of bins: the space of the pieces, with the space that no small piece can share."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in {0, *(x for x in counts if 2 * x <= capacity)}:
        large = sum(n for x, n in counts.items() if x > capacity - k)
        middle = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - k]
        bins = sum(n for _, n in middle)
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        over = small - (bins * capacity - sum(x * n for x, n in middle))
        best = max(best, large + bins + max(0, -(-over // capacity)))
    return best


def fillings(space: int, left: dict[int, int], slack: int, steps: list[int]):
    """All undominated fillings of space that waste at most slack, those of larger pieces first; steps[0] counts down.

    A filling is dominated if a piece left over fits in what it wastes, or in that and the place of a smaller piece of it.
    """
    lengths = sorted(x for x, n in left.items() if n > 0 and x <= space)
    reach = _reach(space, lengths, left)
    stack = [(space, len(lengths), [])]
    while stack and steps[0] > 0:
        room, i, chosen = stack.pop()
        steps[0] -= 1
        if room <= slack and not any(c < y <= c + room and left[y] > chosen.count(y) for c in {0, *chosen} for y in lengths):
            yield chosen, room
        for j in range(i):  # the stack turns the order
            x = lengths[j]
            for k in range(1, min(left[x], room // x) + 1):
                r = room - k * x
                if reach[j] >> max(0, r - slack) & ((1 << (min(r, slack) + 1)) - 1):
                    stack.append((r, j, [*chosen, *[x] * k]))


def complete(counts: dict[int, int], capacity: int, most: int, nodes: int) -> list[tuple[list[int], int]] | None:
    """A packing in at most most bins, or None if there is none or it is not found within nodes steps.

    Branches over the undominated fillings around the largest piece left and how often each is used; the waste of all
    bins together can be most * capacity less the pieces, and what would waste more is cut.
    """
    steps, seen = [nodes], {}

    def choices(left, slack):
        top = max(left)
        rest = left | {top: left[top] - 1}
        for f, w in fillings(capacity - top, rest, slack, steps):
            bin_ = sorted([top, *f], reverse=True)
            times = min(left[x] // bin_.count(x) for x in set(bin_))
            for t in range(min(times, slack // w) if w else times, 0, -1):
                yield bin_, t, w * t

    slack = most * capacity - sum(x * n for x, n in counts.items())
    if slack < 0:
        return None
    path, states, open_ = [], [(counts, slack)], [choices(counts, slack)]
    while open_ and steps[0] > 0:
        steps[0] -= 1
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            states.pop()
            if path:
                path.pop()
            continue
        bin_, t, w = step
        left, slack = states[-1]
        left = {x: n - t * bin_.count(x) for x, n in left.items() if n > t * bin_.count(x)}
        slack -= w
        if not left:
            return [*path, (bin_, t)]
        key = tuple(sorted(left.items()))
        if seen.get(key, -1) >= slack:
            continue
        seen[key] = slack
        path.append((bin_, t))
        states.append((left, slack))
        open_.append(choices(left, slack))
    return None


def plan(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins) that hold all pieces. counts: pieces per length.

    The better of best fit and of the fullest bins first, bettered by branch and bound until the lower bound is met, no
    better packing exists, or nodes steps were taken without one (then it is not proven that none exists).
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    size = lambda bins: sum(t for _, t in bins)
    best = min(fullest(counts, capacity), best_fit(counts, capacity), key=size)
    bound = least_bins(counts, capacity)
    while size(best) > bound:
        better = complete(counts, capacity, size(best) - 1, nodes)
        if better is None:
            break
        best = better
    return best


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """A packing that fills the bin of the largest piece left with the least waste, as often as the counts allow."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths, out = sorted(left), []
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        rest = fill(capacity - top, [x for x in lengths if x <= capacity - top and left[x] > 0], left)
        left[top] += 1
        bin_ = [top, *sorted(rest, reverse=True)]
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(left[x] // n for x, n in need.items())
        out.append((bin_, times))
        for x, n in need.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x] > 0]
    return out


def _slots(bins: list[tuple[list[int], int]]):
    """Per length, the ranges of ranks: (first rank, pieces per bin, first bin, offset of the first piece in a bin)."""
    slots: dict[int, list] = {}
    used: dict[int, int] = {}
    bin_ = 0
    for lengths, times in bins:
        offset = 0
        for x in dict.fromkeys(lengths):
            n = lengths.count(x)
            slots.setdefault(x, []).append((used.get(x, 0), n, bin_, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
        bin_ += times
    return {x: np.array(v, dtype=np.int64) for x, v in slots.items()}


def _place(slots):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                m = length == x
                s = slots[int(x)]
                at = s[np.searchsorted(s[:, 0], rank[m], side="right") - 1]
                inside = rank[m] - at[:, 0]
                seq[m] = at[:, 2] + inside // at[:, 1]
                off[m] = at[:, 3] + inside % at[:, 1] * x
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, buckets: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece. docs: doc_id, text.

    buckets: into how many groups the ranking of one length is dealt; raise it with the input (the driver reads a table
    of capacity rows, executors sum one of capacity x buckets).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = common.cut(rows.mapInArrow(_pieces(tokenizer, capacity, end), kind))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(counts, capacity))
    from pyspark.sql import Window

    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = pieces.withColumn("row", F.row_number().over(order)).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") - 1 + F.col("base")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(slots), kind + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
