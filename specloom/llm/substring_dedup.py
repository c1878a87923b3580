"""Substring dedup with difference-cover anchors.

Two equal runs of ``width`` words start at some i and j. A difference cover D modulo T holds, for every residue r, a
pair of members that differ by r; hence some shift below T brings both i and j onto positions whose residue is in D.
So it is enough to hash anchor windows of ``width - T + 1`` words at cover positions only: any long match shares one
aligned anchor. Texts that share an anchor extend around it: the full windows that contain it are compared over all
such texts. Anchor hashes only choose candidates, so what collides there costs a look and no more; which windows (and
whole texts) are equal is decided by 128 bits of BLAKE2b over their words' bytes, which no two different runs of words
are known to share.

No pair of documents is ever formed and nothing is joined by hash. A task first settles what it can alone: of a key
that it sees in several documents, all but the least are done, and one row goes on. Each step then deals its rows out
once by key and reads them in order of (key, document): the first document of a key is its least one. So a passage
that a third of all documents hold costs one row per task, not one per document.

Defined results: null text is an empty one; rows of one doc_id count as one source, never as each other's copies;
a row without doc_id takes no part and keeps its text;
texts shorter than the window are never touched; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import Words, slices

#: A perfect difference set modulo 31: every non-zero residue is the difference of exactly one pair (fixed values).
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
#: Keys that a task holds before it settles them and passes the rest on.
HELD = 1 << 20
EVERYWHERE = -1
_ROWS = "h1 long, h2 long, done boolean, doc long, pos int"
_NAMES = ["h1", "h2", "done", "doc", "pos"]


def _groups(h1, h2, doc, pos):
    """The rows in order of (h1, h2, doc), and the number of each one's group of equal keys."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1, h2, doc, pos, np.flatnonzero(new), np.cumsum(new) - 1


def _batch(h1, h2, done, doc, pos):
    return pa.record_batch([pa.array(h1), pa.array(h2), pa.array(np.full(len(h1), done)), pa.array(doc), pa.array(pos.astype(np.int32))], names=_NAMES)


def _settle_later(h1, h2, doc, pos):
    """What a task knows alone of "a smaller document has this key": rows that are done, and one row per key."""
    h1, h2, doc, pos, first, group = _groups(h1, h2, doc, pos)
    later = doc > doc[first][group]
    if later.any():
        d, p = doc[later], pos[later]
        yield _batch(d, p.astype(np.int64), True, d, p)
    least = ~later
    yield _batch(h1[least], h2[least], False, doc[least], pos[least])


def _settle_shared(h1, h2, doc, pos):
    """What a task knows alone of "another document has this key": rows that are done with two to speak for the key."""
    h1, h2, doc, pos, first, group = _groups(h1, h2, doc, pos)
    last = np.append(first[1:], len(h1)) - 1
    shared = doc[first] != doc[last]
    known = shared[group]
    if known.any():
        d, p = doc[known], pos[known]
        yield _batch(d, p.astype(np.int64), True, d, p)
        two = np.concatenate([first[shared], last[shared]])
        yield _batch(h1[two], h2[two], False, doc[two], np.full(len(two), -1))
    yield _batch(h1[~known], h2[~known], False, doc[~known], pos[~known])


def _held(parts, settle):
    """Settle the rows (h1, h2, doc, pos) that parts gives, about HELD at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield from settle(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield from settle(*map(np.concatenate, zip(*held)))


def _columns(batch):
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _found(rows):
    doc, pos = rows
    return pa.record_batch([pa.array(doc), pa.array(pos.astype(np.int32))], names=["doc", "pos"])


def _later(batches):
    """Rows in order of (done, h1, h2, doc): those that are done, and those after the first document of their key."""
    key, least = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, done, doc, pos = _columns(batch)
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (done[1:] != done[:-1])
        new[0] = key != (h1[0], h2[0], done[0])
        start = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        first = np.where(start >= 0, doc[start], least)
        out = done | (doc > first)
        key, least = (h1[-1], h2[-1], done[-1]), first[-1]
        yield _found((doc[out], pos[out]))


def _shared(batches):
    """Rows in order of (done, h1, h2, doc): those that are done, and those whose key has several documents.

    Held back are only rows of one document, until another of their key comes.
    """
    key, several, wait = None, False, []
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, done, doc, pos = _columns(batch)
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (done[1:] != done[:-1])
        new[0] = key != (h1[0], h2[0], done[0])
        starts = np.flatnonzero(new)
        if not new[0]:  # the key of the last batch goes on
            end = int(starts[0]) if len(starts) else len(h1)
            before = several
            several = bool(several or doc[end - 1] != wait[0][0][0])
            if several and not before:
                for d, p in wait:
                    yield _found((d[p >= 0], p[p >= 0]))
                wait = []
            if several:
                keep = pos[:end] >= 0
                yield _found((doc[:end][keep], pos[:end][keep]))
            else:
                wait.append((doc[:end], pos[:end]))
            if not len(starts):
                continue
        ends = np.append(starts[1:], len(h1))
        many = done[starts] | (doc[starts] != doc[ends - 1])
        out = np.repeat(many, ends - starts) & (pos[starts[0] :] >= 0)
        yield _found((doc[starts[0] :][out], pos[starts[0] :][out]))
        s = int(starts[-1])
        key, several = (h1[-1], h2[-1], done[-1]), bool(many[-1])
        wait = [] if several else [(doc[s:], pos[s:])]


def _dealt(rows: DataFrame, read) -> DataFrame:
    """(doc, pos): what read makes of rows that are dealt out by key and put in order; done ones spread by themselves."""
    return rows.repartition("h1", "h2").sortWithinPartitions("done", "h1", "h2", "doc").mapInArrow(read, "doc long, pos int")


def _joined(text: bytes | None):
    """(words joined by one space, each word's start, each word's end)."""
    words = (text or b"").split()
    if not words:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate(([0], ends[:-1] + 1)), ends


def _strong(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _keys(digests: list[bytes]):
    h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return h[:, 0], h[:, 1]


def _wholes(width: int):
    """One row per text of width words or more: its whole sequence of words."""

    def parts(batches):
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            ids, digests, rows = batch.column(0), [], []
            for k, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()
                if len(words) >= width:
                    digests.append(_strong(b" ".join(words)))
                    rows.append(k)
            if rows:
                yield *_keys(digests), ids.take(pa.array(rows)).to_numpy(zero_copy_only=False), np.full(len(rows), EVERYWHERE)

    return lambda batches: _held(parts(batches), _settle_later)


def _anchors(width: int, cover: tuple, period: int):
    anchor = width - period + 1
    residues = np.isin(np.arange(period), cover)

    def parts(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, bounds in slices(batch.column(1)):
                w = Words(data, bounds)
                sizes = np.diff(w.offsets)
                local = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], sizes)
                room = np.repeat(sizes, sizes)
                at = np.flatnonzero(residues[local % period] & (local + anchor <= room) & (room >= width))
                if len(at):
                    owner = np.repeat(np.arange(row, row + len(sizes)), sizes)[at]
                    yield w.windows(anchor, at).view(np.int64), np.zeros(len(at), np.int64), docs[owner], local[at]

    return lambda batches: _held(parts(batches), _settle_shared)


def _windows(width: int, period: int):
    """Texts with the positions of their shared anchors: the windows around these."""
    reach = period - 1

    def parts(batches):
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            docs, shared = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for k, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                data, start, end = _joined(text)
                n = len(start)
                if n < width:
                    continue
                p = np.asarray(shared[k].values)
                p = p[p < n]  # positions of another row of this doc_id
                mark = np.zeros(n + 2, dtype=np.int32)
                np.add.at(mark, np.maximum(p - reach, 0), 1)
                np.add.at(mark, p + 1, -1)
                at = np.flatnonzero(np.cumsum(mark[: n - width + 1]) > 0)
                for i in range(0, len(at), HELD):  # a very long text comes in parts
                    here = at[i : i + HELD]
                    digests = [_strong(data[a:b]) for a, b in zip(start[here].tolist(), end[here + width - 1].tolist())]
                    yield *_keys(digests), np.full(len(here), docs[k]), here

    return lambda batches: _held(parts(batches), _settle_later)


def _removal(width: int):
    def run(batches):
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts, marked = batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2)
            n, cut, digest = [], [], []
            for i, text in enumerate(texts):
                found = (text or b"").split()
                starts = marked[i].values
                gone = 0
                if starts is not None and len(starts):
                    keep = ~_covered(np.asarray(starts), len(found), width)
                    gone = len(found) - int(keep.sum())
                    left = [w for w, k in zip(found, keep.tolist()) if k]
                else:
                    left = found
                n.append(len(found))
                cut.append(gone)
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words the windows at starts cover; EVERYWHERE among them stands for all windows."""
    p = np.arange(max(0, n - width + 1)) if starts.min() < 0 else starts[starts <= n - width]
    mark = np.zeros(n + width + 1, dtype=np.int32)
    np.add.at(mark, p, 1)
    np.add.at(mark, p + width, -1)
    return np.cumsum(mark[:n]) > 0


def _copies(docs: DataFrame, width: int) -> DataFrame:
    """(doc): texts whose words are all those of a text with a smaller doc_id; all their windows begin there too."""
    return common.cut(_dealt(docs.mapInArrow(_wholes(width), _ROWS), _later).select("doc").distinct())


def _around(docs: DataFrame, width: int, cover: tuple, period: int) -> DataFrame:
    """(doc, pos): the positions of anchors that several documents share."""
    return common.cut(_dealt(docs.mapInArrow(_anchors(width, cover, period), _ROWS), _shared).groupBy("doc").agg(F.collect_list("pos").alias("pos")))


def _repeated(docs: DataFrame, around: DataFrame, width: int, period: int) -> DataFrame:
    """(doc, starts) of the windows around shared anchors that begin in a text with a smaller doc_id too."""
    texts = docs.join(around, docs.doc_id == around.doc).select("doc_id", "text", "pos")
    return common.cut(_dealt(texts.mapInArrow(_windows(width, period), _ROWS), _later).groupBy("doc").agg(F.collect_set("pos").alias("starts")))


def shared_windows(docs: DataFrame, width: int = 50, cover: tuple = COVER, period: int = PERIOD) -> DataFrame:
    """(doc, starts): where windows begin that also begin in a text with a smaller doc_id; [-1] stands for everywhere.

    docs: doc_id, text. Copies of whole texts need no further look: the first of these texts stands for them. Each step
    is written before the next begins, so its shuffle files can go; texts are read and hashed anew by each, as the rows
    of hashes would take more room than the texts.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    copies = _copies(docs, width)
    firsts = docs.join(copies, docs.doc_id == copies.doc, "left_anti")
    around = _around(firsts, width, cover, period)
    found = _repeated(firsts, around, width, period)
    common.drop(around)
    everywhere = copies.select("doc", F.array(F.lit(EVERYWHERE)).alias("starts"))
    return found.unionByName(everywhere)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = shared_windows(docs, width)
    rows = docs.join(found, docs.doc_id == found.doc, "left").select("doc_id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    return rows.mapInArrow(_removal(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_passages(docs: DataFrame, text: str, starts: str, width: int = 50) -> DataFrame:
    """docs with the words under the given windows taken out of the text column; all other characters but the white
    space after a removed word stay as they are."""
    names = [f.name for f in docs.schema.fields]
    t, s = names.index(text), names.index(starts)

    def run(batches):
        for batch in batches:
            texts, marked, out = batch.column(t).cast(pa.large_binary()).to_pylist(), batch.column(s).to_pylist(), []
            for value, p in zip(texts, marked):
                value = value or b""
                w = Words(np.frombuffer(value, dtype=np.uint8), np.array([0, len(value)]))
                n = len(w.start)
                keep = ~_covered(np.array(p, dtype=np.int64), n, width)
                after = np.append(w.start[1:], len(value))
                first = value[: w.start[0]] if n and keep[0] else b""
                out.append((first + b"".join(value[a:b] for a, b, k in zip(w.start.tolist(), after.tolist(), keep.tolist()) if k)).strip(b" ").decode("utf-8") if n else "")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == t else batch.column(i) for i in range(len(names))], schema=pa.schema([batch.schema.field(i) if i != t else pa.field(text, pa.string()) for i in range(len(names))]))

    return docs.mapInArrow(run, docs.schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}


def _sql() -> str:
    """The windows themselves, as lists of words, in DuckDB SQL: of each text's windows, those that an earlier doc_id has."""
    return """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, doc_id, i, w[i:i + 49] AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
c AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i FROM s JOIN f USING (k) WHERE doc_id > first), (SELECT unnest(range(0, 50)) AS j)),
g AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
o AS (SELECT d.*, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM o"""


ORACLES: dict[str, str] = {"op8_substring_dedup": _sql()}
