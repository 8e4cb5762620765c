"""Chat formatting into budgeted, turn-aligned training windows.

A window holds the system turn (if the conversation opens with one), a limited run of turns repeated from
before, and as many new turns as the budget allows by prefix sums of turn tokens. A turn is never cut; one
that alone exceeds the budget gets a window of its own. Repeated and system turns are outside the loss mask,
so each assistant text is a target exactly once. `<|` inside a text gains a backslash, which reading removes.

Rows are partitioned by conversation, sorted and streamed: a worker holds one window, however long the
conversation is. Defined cases: null text, role or turn count as empty text, empty role and first turn; rows
that repeat a turn stay, ordered by role and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 1024, 256
WINDOW_SCHEMA = "conv_id long, window long, n_new long, tokens long, formatted string, turn_spans array<struct<start:long,end:long,fresh:boolean>>, loss_spans array<struct<start:long,end:long>>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_tokens(role: str, text: str) -> int:
    """Words of a turn and four for its marks."""
    return 4 + len(_WORD.findall(text))


def _window(conv: int | None, number: int, system: list, history: list, fresh: list, system_is_fresh: bool) -> dict:
    parts, spans, loss, at, tokens = [], [], [], 0, 0
    for turns, new in ((system, system_is_fresh), (history, False), (fresh, True)):
        for role, text, n in turns:
            head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
            parts += (head, body, CLOSE)
            start = at + len(head)
            spans.append({"start": at, "end": start + len(body) + len(CLOSE), "fresh": new})
            if new and role == "assistant":
                loss.append({"start": start, "end": start + len(body)})
            at, tokens = spans[-1]["end"], tokens + n
    return {"conv_id": conv, "window": number, "n_new": len(fresh) + len(system) * system_is_fresh, "tokens": tokens, "formatted": "".join(parts), "turn_spans": spans, "loss_spans": loss}


def windows_of(turns: Iterator[tuple[str, str]], conv: int | None, budget: int, history_budget: int) -> Iterator[dict]:
    """Windows of one conversation from its (role, text) turns in order."""
    system: list = []
    history: list = []
    fresh: list = []
    number = used = 0
    for i, (role, text) in enumerate(turns):
        turn = (role, text, turn_tokens(role, text))
        if i == 0 and role == "system":
            system, used = [turn], turn[2]
            continue
        if fresh and used + turn[2] > budget:
            yield _window(conv, number, system, history, fresh, number == 0)
            number += 1
            room = min(history_budget, max(0, budget - turn[2] - sum(t[2] for t in system)))
            kept: list = []
            for old in reversed((history + fresh)[-16:]):
                if old[2] > room:
                    break
                room -= old[2]
                kept.insert(0, old)
            history, fresh = kept, []
            used = sum(t[2] for t in system + history)
        fresh.append(turn)
        used += turn[2]
    if fresh or system:
        yield _window(conv, number, system, history, fresh, number == 0)


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of equal conv_id over sorted batches, streamed."""
    import itertools

    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    for conv, run in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, run


def _to_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_WINDOW_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_new", pa.int64()), ("tokens", pa.int64()), ("formatted", pa.string()), ("turn_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("fresh", pa.bool_())]))), ("loss_spans", pa.list_(_SPAN))])
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window, a conversation's windows together and in order within a partition."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = (w for conv, turns in _groups(batches, ["conv_id", "role", "text"]) for w in windows_of(((r, t) for _, r, t in turns), conv, budget, history))
        yield from _to_batches(out, _WINDOW_ARROW)

    return rows.select("conv_id", "role", "text").mapInArrow(run, WINDOW_SCHEMA)


def read_turns(formatted: str, spans: list[dict]) -> Iterator[tuple[str, str]]:
    """(role, text) of the fresh turns of a window, from its marks."""
    for s in spans:
        if s["fresh"]:
            role, _, body = formatted[s["start"] + len(OPEN) : s["end"] - len(CLOSE)].partition("\n")
            yield unescape_role(role), unescape(body)


def window_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what reading the windows back gives. windows: as format_windows leaves them."""

    def digest(conv: int | None, run: Iterator[tuple]) -> dict:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = loss_chars = count = 0
        for _, formatted, spans, losses in run:
            for role, text in read_turns(formatted, spans):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for s in losses:
                text = unescape(formatted[s["start"] : s["end"]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                loss_chars += len(text)
            chars += len(formatted)
            count += 1
        return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_windows": count}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _to_batches((digest(c, r) for c, r in _groups(batches, ["conv_id", "formatted", "turn_spans", "loss_spans"])), _DIGEST_ARROW)

    return windows.mapInArrow(run, DIGEST_SCHEMA)
