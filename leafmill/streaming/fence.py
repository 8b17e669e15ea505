"""Streams of text pieces: parsing event lines, and taking a code fence off while the pieces pass."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Characters held back at the end, and characters after which an opening fence is no longer expected (fixed values).
HELD, OPENING = 8, 20
OPEN = re.compile(r"^```(?:markdown)?\n")


class FenceStripper:
    """State of one document: the text not given out yet and whether its beginning is settled."""

    def __init__(self, text: str = "", begun: bool = False):
        self.text, self.begun = text, begun

    def feed(self, piece: str) -> str:
        """What may be given out after a piece."""
        self.text += piece
        if not self.begun:
            if "\n" not in self.text and len(self.text) < OPENING:
                return ""
            self.begun, self.text = True, OPEN.sub("", self.text)
        ready, self.text = (self.text[:-HELD], self.text[-HELD:]) if len(self.text) > HELD else ("", self.text)
        return ready

    def finish(self) -> str:
        """The rest, without a closing fence and white space at the end."""
        rest = self.text.rstrip()
        return rest[:-3].rstrip() if rest.endswith("```") else rest


def strip_stream(pieces: Iterable[str]) -> Iterator[str]:
    state = FenceStripper()
    for piece in pieces:
        if ready := state.feed(piece):
            yield ready
    if rest := state.finish():
        yield rest


def strip_pieces(pieces: DataFrame) -> DataFrame:
    """(doc_id, text) of a batch table (doc_id, piece_no, piece): each document's pieces in order."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("piece_no")["piece"].fillna("")
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "text": ["".join(strip_stream(ordered))]})

    return pieces.groupBy("doc_id").applyInPandas(one, "doc_id long, text string")


def strip_streaming(pieces: DataFrame, patience: int = 600_000) -> DataFrame:
    """(doc_id, out_no, text) of a streaming table (doc_id, piece_no, piece, last): text as soon as it is safe.

    A piece waits for those before it, also over micro-batches; a piece that was there already is dropped. State per
    document is the held text, the waiting pieces and two counters. It goes when the last piece has come, or when none
    has come for `patience` milliseconds: then what is held is given out with the waiting pieces in their order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, begun, number, due, held, end = state.get if state.exists else ("", False, 0, 0, "[]", -1)
        fence, out, waiting = FenceStripper(text, begun), [], {n: p for n, p in json.loads(held)}
        if not state.hasTimedOut:
            for rows in batches:
                for n, piece, last in zip(rows["piece_no"].tolist(), rows["piece"], rows["last"]):
                    if n >= due:
                        waiting.setdefault(n, piece or "")
                    end = n if last else end
            while due in waiting:
                out.append(fence.feed(waiting.pop(due)))
                due += 1
        else:
            out += [fence.feed(waiting[n]) for n in sorted(waiting)]
        ended = state.hasTimedOut or 0 <= end < due
        if ended:
            out.append(fence.finish())
        given = [o for o in out if o]
        if ended:
            state.remove()
        else:
            state.update((fence.text, fence.begun, number + len(given), due, json.dumps(sorted(waiting.items())), end))
            state.setTimeoutDuration(patience)
        if given:
            yield pd.DataFrame({"doc_id": [key[0]] * len(given), "out_no": range(number, number + len(given)), "text": given})

    kept = "text string, begun boolean, number int, due int, held string, end int"
    return pieces.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, out_no int, text string", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_piece(line: Column) -> Column:
    """Text of an event line, null for other lines, for the end mark and for broken events."""
    body = F.when(line.startswith("data:"), F.trim(F.substring(line, F.lit(6), F.length(line))))
    event = F.from_json(body, "choices array<struct<delta:struct<content:string>,finish_reason:string>>")
    return F.when(body != "[DONE]", F.nullif(F.get(event["choices"], F.lit(0))["delta"]["content"], F.lit("")))


def event_truncated(line: Column) -> Column:
    """Whether an event says that the answer was cut off."""
    body = F.when(line.startswith("data:"), F.trim(F.substring(line, F.lit(6), F.length(line))))
    event = F.from_json(body, "choices array<struct<delta:struct<content:string>,finish_reason:string>>")
    return F.coalesce(F.get(event["choices"], F.lit(0))["finish_reason"] == "length", F.lit(False))
