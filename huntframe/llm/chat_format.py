"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, one rule per turn:

    turn      := user | assistant | system | other
    user      := "[INST] " text " [/INST]" newline
    assistant := "<s> " text " </s>" newline
    system    := "<<SYS>> " text " <</SYS>>" newline
    other     := "[ROLE] " name " [/ROLE] " text " [END]" newline

A control string counts as such unless a backslash stands before it. Each turn is rendered as it is, reparsed by the deterministic
parser and compared to its source; if role or text differ, every control string in it gets one more backslash and the turn is rendered and
compared again. The parser takes one backslash away from a control string that has some, so the escape is reversible for any text.

A formatted table has one row per turn, in the order of ``turn`` (null first), role and text, as a conversation may hold any
number of turns. The loss mask is the span of an assistant's text in the rendered turn, in code points.

Null texts and roles count as empty ones. A null conversation id is a conversation of its own. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from huntframe.llm.arrow_text import keyed, map_rows
from huntframe.llm.storage import written

FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
CONTROLS = [c for pair in FRAMES.values() for c in pair] + list(OTHER)
_ANY = "|".join(map(re.escape, CONTROLS))
_CONTROL = re.compile(_ANY)
_REAL = re.compile(rf"(?<!\\)(?:{_ANY})")
_ESCAPED = re.compile(rf"\\(?=\\*(?:{_ANY}))")
ROLES = {frame[0]: role for role, frame in FRAMES.items()}


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Takes one backslash from each run of them that ends at a control string."""
    out, at = [], 0
    for m in _CONTROL.finditer(text):
        if m.start() > at and text[m.start() - 1] == "\\":
            out.append(text[at : m.start() - 1])
            at = m.start()
    return "".join(out) + text[at:] if out else text


def _render(role: str, text: str) -> tuple[str, int]:
    """The turn and where its text starts."""
    if role in FRAMES:
        head, tail = f"{FRAMES[role][0]} ", FRAMES[role][1]
    else:
        head, tail = f"{OTHER[0]} {role} {OTHER[1]} ", OTHER[2]
    return f"{head}{text} {tail}\n", len(head)


def _part(rendered: str, at: int, closer: str) -> tuple[str, int]:
    """The escaped text from ``at`` up to the next control string, which must be the closer, and where that ends."""
    m = _REAL.search(rendered, at)
    if not m or m[0] != closer or m.start() == at or rendered[m.start() - 1] != " ":
        raise ParseError(f"no {closer}")
    return rendered[at : m.start() - 1], m.end()


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int]:
    """Role, text and end of the turn that starts at ``at``."""
    m = _REAL.match(rendered, at)
    if not m or rendered[m.end() : m.end() + 1] != " ":
        raise ParseError("no turn")
    if m[0] in ROLES:
        role = ROLES[m[0]]
        text, end = _part(rendered, m.end() + 1, FRAMES[role][1])
    elif m[0] == OTHER[0]:
        role, end = _part(rendered, m.end() + 1, OTHER[1])
        if rendered[end : end + 1] != " ":
            raise ParseError("no text")
        role = unescape(role)
        text, end = _part(rendered, end + 1, OTHER[2])
    else:
        raise ParseError("no turn")
    if rendered[end : end + 1] != "\n":
        raise ParseError("no end of turn")
    return role, unescape(text), end + 1


def parse_conversation(rendered: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(rendered):
        role, text, at = parse_turn(rendered, at)
        turns.append((role, text))
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its text, which reparse to role and text."""
    for name, body in ((role, text), (escape(role), escape(text))):
        rendered, start = _render(name, body)
        try:
            if parse_turn(rendered) == (role, text, len(rendered)):
                return rendered, start, start + len(body)
        except ParseError:
            pass
    raise AssertionError("an escaped turn must reparse")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, rendered, mask_start, mask_end`` of ``conv_id, turn, role, text`` rows; the mask is null without a loss."""

    def rows(conv_id, turn, role, text):
        for c, n, r, t in zip(conv_id, turn, role, text, strict=True):
            rendered, start, end = format_turn(r or "", t or "")
            yield (c, n, rendered, start, end) if r == "assistant" else (c, n, rendered, None, None)

    columns = {c: c for c in ("conv_id", "turn", "role", "text")}
    whole, text = T.IntegerType(), T.StringType()
    return map_rows(turns, columns, keyed(turns, "conv_id", turn=T.LongType(), rendered=text, mask_start=whole, mask_end=whole), rows)


def parse_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, masked, chars``: turns read back from formatted rows; ``masked`` is the unescaped text under the mask."""

    def rows(conv_id, turn, rendered, mask_start, mask_end):
        for c, n, r, start, end in zip(conv_id, turn, rendered, mask_start, mask_end, strict=True):
            role, text, _ = parse_turn(r)
            yield c, n, role, text, None if start is None else unescape(r[start:end]), len(r)

    columns = {c: c for c in ("conv_id", "turn", "rendered", "mask_start", "mask_end")}
    text = T.StringType()
    return map_rows(formatted, columns, keyed(formatted, "conv_id", turn=T.LongType(), role=text, text=text, masked=text, chars=T.LongType()), rows)


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation. A task streams the turns in order and keeps two running digests, whatever a conversation's length."""
    number, digest = T.LongType(), T.StringType()
    made = keyed(parsed, "conv_id", n_turns=number, turns_sha256=digest, loss_chars=number, loss_sha256=digest, formatted_chars=number)
    schema = to_arrow_schema(made)

    def run(batches):
        now, state = object(), None

        def batch_of(done):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema=schema)

        def closed():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        done.append(closed())
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{row['role']}\n{row['text']}\n".encode())
                if row["masked"] is not None:
                    state[2] += len(row["masked"])
                    state[3].update(row["masked"].encode())
                state[4] += row["chars"]
            yield batch_of(done)
        if state is not None:
            yield batch_of([closed()])

    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, made)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Formats all conversations, writes them, and reads them back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    formatted = written(format_turns(turns.unionByName(added)), "chat")
    return conversation_digests(parse_turns(formatted))


#: As the operator renders: six frames' lengths, one more character for each control string in a text.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + 1
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 24 + length(role) END
    + len(regexp_extract_all(role || chr(10) || text, '\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[END\]')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
