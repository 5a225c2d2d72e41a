"""Chat formatting with a grammar that is parsed back.

::

    conversation = turn*
    turn         = "### " role ": " text "</turn>\\n"
    role         = "System" | "User" | "Assistant" | "~" (null) | "=" JSON string

The control strings are ``###`` and ``</turn>``. In a text one that is
preceded by an odd run of backslashes is literal: (run - 1) / 2 backslashes,
then the string. After an even run it is a real control string. A text is
rendered as it is, reparsed, and escaped further until it comes back
unchanged: first with a backslash before each control string, then with the
runs before control strings and before the text's end doubled as well.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import arrow_map

OPEN, CLOSE = "###", "</turn>"
CONTROL = re.compile(r"(?<!\\)(\\*)(###|</turn>)")
AT_END = re.compile(r"(?<!\\)\\+\Z")
HEADER = re.compile(r'### (System|User|Assistant|~|="(?:[^"\\]|\\.)*"): ')
NAMED = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMED.items()}


class GrammarError(ValueError):
    pass


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}", text)
    text = CONTROL.sub(lambda m: f"{m[1]}{m[1]}\\{m[2]}", text)
    return AT_END.sub(lambda m: m[0] * 2, text)


def unescape(text: str) -> str:
    """The text that a turn's rendered text stands for (without the closing control string)."""
    text = AT_END.sub(lambda m: m[0][: len(m[0]) // 2], text)
    return CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def _role(role: str | None) -> str:
    if role is None:
        return "~"
    return NAMED.get(role) or "=" + re.sub("[#<:]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(role))


def _named(said: str) -> str | None:
    return None if said == "~" else json.loads(said[1:]) if said[0] == "=" else ROLES[said]


def parse(formatted: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of each turn; the span holds the rendered text."""
    out, at = [], 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        start = at = head.end()
        while True:
            m = CONTROL.search(formatted, at)
            if not m:
                raise GrammarError(f"the turn at {start} does not end")
            at = m.end()
            if len(m[1]) % 2:
                continue
            if m[2] != CLOSE:
                raise GrammarError(f"a turn begins inside another at {m.start(2)}")
            break
        end = m.start(2)
        if formatted[at : at + 1] != "\n":
            raise GrammarError(f"no line ends at {at}")
        at += 1
        out.append((_named(head[1]), unescape(formatted[start:end]), start, end))
    return out


def render_turn(role: str | None, text: str) -> str:
    """The turn at the least level of escaping from which the parser recovers it."""
    for level in (0, 1, 2):
        said = f"### {_role(role)}: {escape(text, level)}{CLOSE}\n"
        try:
            back = parse(said)
        except GrammarError:
            continue
        if len(back) == 1 and back[0][:2] == (role, text):
            return said
    raise GrammarError("the turn does not come back")


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask (assistant texts), after a
    round trip of the whole."""
    said = "".join(render_turn(r, t) for r, t in turns)
    back = parse(said)
    if [b[:2] for b in back] != turns:
        raise GrammarError("the conversation does not come back")
    return said, [(a, b) for role, _, a, b in back if role == "assistant"]


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation.

    Turns are ordered by turn (null first), then role and text, so ties have
    one order; repeated rows are repeated turns. Null texts count as empty, a
    null role is a role of its own, rows with a null conv_id are one
    conversation. Other columns are not read; an empty table stays empty.
    A task holds one conversation at a time: its row is its output.
    """
    kind = rows.schema[conv_col].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(SPAN))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    sorted_rows = (
        rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
        .repartition("c")
        .sortWithinPartitions("c", "t", "r", "x")
        .select("c", "r", "x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, turns = None, []

        def close():
            if turns:
                said, spans = render(turns)
                done.append((now, said, [{"start": a, "end": b} for a, b in spans]))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            for c, r, x in zip(*(col.to_pylist() for col in batch.columns)):
                if turns and c != now:
                    close()
                    turns = []
                now = c
                turns.append((r, x))
            if len(done) >= 64:
                yield out()
        close()
        if done:
            yield out()

    return sorted_rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and digests, all taken from the formatted text and its loss spans.

    Rows are answered one by one, repeated ones and those with a null conv_id too; a null role counts as empty in
    the digest; formatted and loss_spans are never null where format_conversations made them; an empty table stays
    empty.
    """
    names = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([formatted.schema["conv_id"], *(T.StructField(n, t) for n, t in names)])

    def rows():
        def one(said, spans):
            turns = parse(said)
            whole, loss, n = hashlib.sha256(), hashlib.sha256(), 0
            for role, text, _, _ in turns:
                whole.update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            for s in spans:
                text = unescape(said[s["start"] : s["end"]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                n += len(text)
            return len(turns), whole.hexdigest(), n, loss.hexdigest(), len(said)

        def step(cols):
            return [cols[0], *([list(x) for x in zip(*map(one, cols[1], cols[2]))] or [[]] * 5)]

        return step

    return arrow_map(formatted.select("conv_id", "formatted", "loss_spans"), schema, rows)
