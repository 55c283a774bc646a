"""Chat formatting checked by a grammar round trip.

A turn is written ``<s>[TAG] text [/TAG]</s>``, TAG being INST for user, OUT
for assistant, SYS for system and ``ROLE=name`` (percent-encoded) otherwise.
Text that reads like a control string gets a backslash after its first
character; a control string that already has backslashes gets one more, so
taking one away restores the text.

Grammar:  conversation := turn* ;  turn := open ' ' text ' ' close
          open := '<s>[' tag ']' ;  close := '[/' tag ']</s>'
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import prepare, shuffle_parts

# Role tags of the template.
TAGS = {"user": "INST", "assistant": "OUT", "system": "SYS"}
ROLES = {tag: role for role, tag in TAGS.items()}

_TAG = r"(?:INST|OUT|SYS|ROLE=[A-Za-z0-9_.~%-]*)"
#: A control string's first character, its backslashes and the rest.
_CONTROL = re.compile(rf"([<\[])(\\*)(/?s>|/?{_TAG}\])")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(/?s>|/?{_TAG}\])")
_OPEN = re.compile(rf"<s>\[({_TAG})\] ")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def tag_of(role: str) -> str:
    return TAGS.get(role) or "ROLE=" + quote(role, safe="", encoding="utf-8", errors="surrogatepass")


def role_of(tag: str) -> str:
    return ROLES.get(tag) or unquote(tag.removeprefix("ROLE="), encoding="utf-8", errors="surrogatepass")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Deterministic parser: (role, unescaped text, start, end) of each turn's text in ``formatted``.

    Raises ``ValueError`` where the grammar does not fit.
    """
    out, at = [], 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        close = f" [/{m[1]}]</s>"
        end = formatted.find(close, m.end())
        if end < 0:
            raise ValueError(f"turn at {at} does not end")
        body = formatted[m.end():end]
        if any(not c[2] for c in _CONTROL.finditer(body)):
            raise ValueError(f"control string inside the turn at {at}")
        out.append((role_of(m[1]), unescape(body), m.end(), end))
        at = end + len(close)
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn and the span of its text, rewritten until its parse equals the source."""
    tag = tag_of(role)
    body = text
    while True:
        piece = f"<s>[{tag}] {body} [/{tag}]</s>"
        try:
            if [x[:2] for x in parse(piece)] == [(role, text)]:
                return piece, len(tag) + 6, len(tag) + 6 + len(body)
        except ValueError:
            pass
        if body != text:
            raise ValueError("the escaped turn does not read back")
        body = escape(text)


def format_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, text, piece, text_start, text_end``: each row as a formatted turn.

    A conversation's output is its pieces joined in order; ``text_start`` and
    ``text_end`` are code points inside the piece.  Null role and null text
    are empty strings; other columns are ignored.
    """
    prepare(conversations.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], pa.int64())],
                names=[*b.schema.names, "piece", "text_start", "text_end"])

    source = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(rows, "conv_id long, turn long, role string, text string, piece string, text_start long, text_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, read from the formatted pieces alone.

    ``formatted`` has ``conv_id, turn, role, text, piece`` (see ``format_turns``);
    role and text only order rows that share a turn number.  A conversation is
    never held whole: pieces arrive in order and go through running digests.
    A null ``conv_id`` is one conversation of its own.
    """
    prepare(formatted.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def closed(rows: list) -> pa.RecordBatch:
            cols = list(zip(*[(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in rows]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            done = []
            for conv, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(piece)
                for role, text, _, _ in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[3] += len(text)
                        state[4].update(text.encode())
            if done:
                yield closed(done)
        if state is not None:
            yield closed([state])

    placed = (formatted.select("conv_id", "turn", "role", "text", "piece")
              .repartition(shuffle_parts(formatted.sparkSession), "conv_id")
              .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "piece"))
    return placed.mapInArrow(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
