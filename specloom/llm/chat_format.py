"""Chat formatting by prefix-target expansion.

Every turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` with control strings inside roles and texts escaped.
Every assistant turn becomes an example of its own: all preceding turns are its context and only its reply (without the
closing mark) is trainable. Turns after the last reply form a last example without a target.

An example row holds its whole context as text (all preceding turns and the head of its own turn), how long that is, and
its target, so it stands for itself: contexts of one conversation grow with the square of its length, which is what the
expansion is. Turns are dealt out by conversation, put in order and read as a stream, and examples go out in batches of
bounded size, so a conversation needs no more memory than a few of its examples. A context is one value, which Spark
limits to 2 GB; a longer one fails the job.

Escaping: in roles and texts each "\\" becomes "\\\\", and the bar of each "<|" becomes "\\|", so that "<|" occurs in a
rendering only where the template puts it; in roles a line feed becomes "\\n". Reading back reverses this exactly.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then role, text; repeated rows
are turns of their own; turns without conv_id form one conversation without id; other columns are ignored; an empty
table gives no examples.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, STOP = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(STOP) + r"\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)
EXAMPLES = "conv_id long, example long, turns_before long, context_chars long, context string, target string"
#: Characters of examples in one batch.
HELD = 1 << 22


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def head(role: str) -> str:
    """What opens a turn."""
    return START + escape(role).replace("\n", "\\n") + "\n"


def read(rendering: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendering."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(rendering)]


def expand(turns, trainable: str = "assistant"):
    """(conv_id, example, turns before it, characters of its context, what its context adds to the rendering of the example
    before, target, context) of (conv_id, role, text) in order."""
    now, begun, prefix, whole = None, False, [], ""
    example = before = 0

    def row(target):
        new = "".join(prefix)
        return now, example, before, len(whole) + len(new), new, target, whole + new

    for conv, role, text in turns:
        if not begun or conv != now:
            if prefix:
                yield row(None)
            now, begun, prefix, whole = conv, True, [], ""
            example = before = 0
        opening, body = head(role), escape(text)
        if role == trainable:
            prefix.append(opening)
            out = row(body)
            yield out
            example, prefix, whole = example + 1, [], closed(out[6], body)
        else:
            prefix.append(opening + body + STOP + "\n")
        before += 1
    if prefix:
        yield row(None)


def closed(prefix: str, target: str | None) -> str:
    """What an example renders: its context (or what is new in it), its target and the mark that closes it."""
    return prefix if target is None else prefix + target + STOP + "\n"


def _expand(batches):
    def turns():
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns[:3])):
                yield conv, role, text

    held, size = [], 0
    for row in expand(turns()):
        held.append((*row[:4], row[6], row[5]))
        size += len(row[6]) + len(row[5] or "")
        if size > HELD or len(held) >= 10_000:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(held: list[tuple]):
    conv, example, before, chars, context, target = zip(*held)
    return pa.record_batch([*(pa.array(x, pa.int64()) for x in (conv, example, before, chars)), pa.array(context, pa.string()), pa.array(target, pa.string())], names=["conv_id", "example", "turns_before", "context_chars", "context", "target"])


def examples(turns: DataFrame) -> DataFrame:
    """One row per example, each conversation's in order within one partition: conv_id, example (from 0), turns_before,
    context_chars, context (all that precedes the target), target (null without one). turns: conv_id, turn, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), text("role"), text("text"), F.col("turn").cast("long").alias("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLES)


def materialise(expanded: DataFrame) -> DataFrame:
    """conv_id, example, context, target: what is trained on."""
    return expanded.select("conv_id", "example", "context", "target")


def _digest(batches):
    """Turns and loss of each conversation, read back from its examples as they pass.

    A context must begin with all that the example before it renders, so only what follows that is read for new turns.
    """
    now, state, out, seen = None, None, [], ""

    def done():
        n, turns, chars, loss = state
        return (now, n, turns.hexdigest(), chars, loss.hexdigest(), len(seen))

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("conv_id", "turns_before", "context_chars", "context", "target")]
        for c, b, k, x, t in zip(*columns):
            if state is None or c != now:
                if state:
                    out.append(done())
                now, state, seen = c, [0, hashlib.sha256(), 0, hashlib.sha256()], ""
            if len(x) != k or not x.startswith(seen):
                raise ValueError(f"an example of conversation {c} does not hold its whole context")
            for role, text in read(closed(x[len(seen) :], t)):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if t is not None:
                reply = unescape(t)
                state[2] += len(reply)
                state[3].update(reply.encode())
            if state[0] != b + (t is not None):
                raise ValueError(f"an example of conversation {c} does not hold its whole context")
            seen = closed(x, t)
        if out:
            yield _digests(out)
            out = []
    if state:
        yield _digests([done()])


def _digests(rows: list[tuple]):
    conv, n, turns, chars, loss, size = zip(*rows)
    return pa.record_batch([pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(expanded: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    expanded: examples(), whose rows stand in order; the digests go along with them, so nothing is dealt out again.
    """
    return expanded.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """The digests of all conversations and of conversation -1, which joins turns that the table has under that id."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    return digests(examples(turns.unionByName(extra)))


def _sql() -> str:
    """The digests straight from the turns; escapes only add one character each."""
    escaped = lambda c: f"replace(replace({c}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(STOP) + 2} + length(replace({escaped('role')}, chr(10), chr(92) || 'n')) + length({escaped('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES: dict[str, str] = {"op4_chat_format": _sql()}
