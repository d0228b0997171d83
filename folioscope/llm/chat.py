"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (all marks are literal):

    conversation := turn*
    turn         := "### " role flag ": " body " </turn>\\n"
    flag         := "" (body as it is) | "~" (body escaped)
    role         := one or more characters other than "~", ":", "\\n" and "%", or "%XX" escapes of these

A body ends at the first " </turn>\\n"; no body holds "</turn>" or "### ", the control strings. Every text is
first rendered as it is; the rendering is parsed again and each turn that does not come back
identical is escaped, until the parse equals the source. Escaped bodies hold neither "<" nor "#".
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
_ESCAPE = {"\\": "\\\\", "<": "\\l", "#": "\\h"}
_BACK = {"\\\\": "\\", "\\l": "<", "\\h": "#"}


def escape(text: str) -> str:
    return re.sub(r"[\\<#]", lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lh]", lambda m: _BACK[m[0]], text)


def _role(role: str) -> str:
    return re.sub(r"[~:%\n#<\\]|^$", lambda m: "%%%02X" % ord(m[0]) if m[0] else "%00", role)


def _unrole(role: str) -> str:
    return "" if role == "%00" else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the span of each turn's body in it."""
    out, spans, at = [], [], 0
    for (role, text), e in zip(turns, escaped, strict=True):
        head, body = f"{OPEN}{_role(role)}{'~' * e}: ", escape(text) if e else text
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


_TURN = re.compile(r"### ([^~:\n]+)(~?): ")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn by the grammar; ValueError where it doesn't hold."""
    at, out = 0, []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        end = formatted.find(CLOSE, m.end())
        if end < 0:
            raise ValueError("unclosed turn")
        body = formatted[m.end() : end]
        if "</turn>" in body or OPEN in body:
            raise ValueError(f"control string in the body at {m.end()}")
        out.append((_unrole(m[1]), unescape(body) if m[2] else body, m.end(), end))
        at = end + len(CLOSE)
    return out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Render, reparse, and escape what conflicts until the parse equals the source."""
    escaped = [False] * len(turns)
    while True:
        text, spans = render(turns, escaped)
        try:
            got = parse(text)
        except ValueError:
            got = []
        if [g[:2] for g in got] == turns:
            return text, spans
        odd = [i for i, t in enumerate(turns) if "</turn>" in t[1] or OPEN in t[1]]
        odd = [i for i in odd if not escaped[i]] or [i for i, e in enumerate(escaped) if not e]
        if not odd:
            raise AssertionError("escaped turns did not come back")
        for i in odd:
            escaped[i] = True


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss array<struct<start,end>>) of each conversation.

    Rows are ordered by turn, ties by role and text; null texts and roles are empty. loss spans
    cover the bodies of assistant turns. Repeated rows stay. A null id is a conversation of its
    own. A conversation is the unit of work: it is one value of the result.
    """

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(1).to_pylist():
                t = [(x["role"], x["text"]) for x in turns]
                text, at = format_turns(t)
                texts.append(text)
                spans.append([{"start": a, "end": b} for (a, b), (role, _) in zip(at, t, strict=True) if role == "assistant"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [id_col, "formatted", "loss"])

    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    whole = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.mapInArrow(run, f"`{id_col}` {kind}, formatted string, loss array<struct<start:long,end:long>>")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader gets back from formatted text and mask: counts and SHA-256 of turns and loss text."""

    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                flag = {a: text[a - 3] == "~" for _, _, a, _ in turns}
                spoken = "".join(unescape(text[s["start"] : s["end"]]) if flag[s["start"]] else text[s["start"] : s["end"]] for s in loss)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(turns), whole, len(spoken), hashlib.sha256(spoken.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema[id_col].dataType.simpleString()
    return formatted.select(id_col, "formatted", "loss").mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
