"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree are the ranks of its adjacent pairs, an inner node is the least of its children, and the
root so yields the lowest rank; walking down to the left first finds the leftmost pair that has it. A merge changes
three leaves, each a logarithmic update, until the root says that no pair can be merged. Words recur, so each worker
keeps what it has encoded, in a memo of bounded size.

The vocabulary file is a parameter (tokenizers JSON of a word-end BPE: NFC, white space to one space, lower case, split
by pattern, bytes as letters, ``</w>`` on a word's last letter).

Defined results: null text is an empty one (no ids, empty decoding); strings of special tokens in a text are those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MEMO = 600_000
INF = 1 << 60
#: Separators that Python counts as white space and the pattern does not (fixed values).
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


def merge_all(symbols: list[int], ranks: dict) -> list[int]:
    """Apply merges, lowest rank first and leftmost of equals, until none is left. ranks: (a, b) -> (rank, merged)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    merged = [get((a, b)) for a, b in zip(symbols, symbols[1:])]
    tree = [INF] * size + [m[0] if m else INF for m in merged] + [INF] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = i + size
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while tree[1] < INF:
        k, least = 1, tree[1]
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = nxt[i]
        symbols[i], symbols[j] = merged[i][1], -1
        after = nxt[i] = nxt[j]
        if j < n - 1:
            put(j, INF)
        if after < n:
            prv[after] = i
            m = merged[i] = get((symbols[i], symbols[after]))
            put(i, m[0] if m else INF)
        else:
            put(i, INF)
        p = prv[i]
        if p >= 0:
            m = merged[p] = get((symbols[p], symbols[i]))
            put(p, m[0] if m else INF)
    return [s for s in symbols if s >= 0]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        self.ranks = {(v[a], v[b]): (r, v[a + b]) for r, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.first = {b: v.get(c) for b, c in letters.items()}
        self.last = {b: v.get(c + self.end) for b, c in letters.items()}
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.by_word, self.by_chunk, self.back = {}, _Chunks(self), _Back(self)

    def word(self, word: str) -> list[int]:
        found = self.by_word.get(word)
        if found is None:
            b = word.encode("utf-8")
            symbols = [self.first[x] for x in b[:-1]] + [self.last[b[-1]]]
            found = self.by_word[word] = merge_all([s for s in symbols if s is not None], self.ranks)
        return found

    def chunks(self, text: str) -> list[str]:
        """The normalised text between white space."""
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # every sigma alike: lower case is by character, not by word
        return [x for x in _SPACES.split(text) if x] if _CONTROL.search(text) else text.split()

    def parts(self, text: str) -> list[str]:
        """Chunks, and special tokens as they are."""
        if not self.cut or "<|" not in text:
            return self.chunks(text)
        return [c for k, x in enumerate(self.cut.split(text)) for c in ([x] if k % 2 else self.chunks(x))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.parts(text) for i in self.by_chunk[c].split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file the tokens are joined by a space."""
        return " ".join(self.tokens[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as decimals joined by a space, their decoding)."""
        parts = self.parts(text)
        if not parts:
            return 0, "", ""
        ids, back = " ".join(map(self.by_chunk.__getitem__, parts)), " ".join(map(self.back.__getitem__, parts))
        if len(self.by_chunk) > MEMO:
            self.by_word, self.by_chunk, self.back = {}, _Chunks(self), _Back(self)
        return ids.count(" ") + 1, ids, back


class _Chunks(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, chunk: str) -> str:
        c = self.codec
        ids = [c.special[chunk]] if chunk in c.special else [i for w in c.words.findall(chunk) for i in c.word(w)]
        out = self[chunk] = " ".join(map(str, ids))
        return out


class _Back(_Chunks):
    def __missing__(self, chunk: str) -> str:
        out = self[chunk] = self.codec.decode([int(i) for i in self.codec.by_chunk[chunk].split()])
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _run(path: str, full: bool):
    def run(batches):
        c = codec(path)
        for batch in batches:
            n, ids, back, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                count, i, b = c.digest(text or "")
                n.append(count)
                if full:
                    lists.append(list(map(int, i.split())))
                    back.append(b)
                else:
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    back.append(hashlib.sha256(b.encode()).hexdigest())
            if full:
                yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])
            else:
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded. docs: doc_id, text."""
    return _rows(docs).mapInArrow(_run(path, True), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode gives."""
    return _rows(docs).mapInArrow(_run(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
