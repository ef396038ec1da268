"""Conversations archived as they fall silent, from state that holds their turns."""

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nearwell import constants as K
from nearwell.operators.sessions import TURN_FIELDS, TURNS_PER_ARCHIVE_ROW

# ship the processor by value: executors need pyspark only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURN = ("struct<turn_no: int, role: string, content: string, parsed_need: string, parsed_place: string, "
        "lat: double, lng: double, result_count: int, results_json: string, created_at: bigint>")
CLOSED = (f"conversation_id string, user_id string, lang string, started_at long, closed_at long, "
          f"turn_count int, part int, turns array<{TURN}>")


class OpenConversations(StatefulProcessor):
    """Per conversation: who, when and how many, and its turns in pieces of ``per_row`` turn numbers.

    An event-time timer stands at the last turn plus the gap. When it fires, or a turn comes later
    than that, each piece is one row and the state is cleared. No piece grows with the conversation.
    """

    def __init__(self, gap_ms: int, per_row: int):
        self.gap, self.per_row = gap_ms, per_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState(
            "head", "user_id string, lang string, started_at long, last long, turns int")
        self.pieces = handle.getMapState("pieces", "part int", f"turns array<{TURN}>")

    def _close(self, key: str) -> Iterator[Row]:
        user, lang, started, last, n = self.head.get()
        for (part,), (turns,) in sorted(self.pieces.iterator(), key=lambda x: x[0][0]):
            yield Row(conversation_id=key, user_id=user, lang=lang, started_at=started,
                      closed_at=last + self.gap * 1000, turn_count=n, part=part, turns=turns)
        self.head.clear()
        self.pieces.clear()

    def _add(self, turns: list[Row]) -> None:
        first = turns[0]
        user, lang, started, last, n = self.head.get() if self.head.exists() else (
            first.user_id, first.conversation_lang, first.started_at, first.created_at, 0)
        by_part: dict[int, list] = {}
        for t in turns:
            by_part.setdefault((t.turn_no - 1) // self.per_row, []).append(
                tuple(t[c] for c in TURN_FIELDS))
        for part, new in by_part.items():
            old = self.pieces.getValue((part,))[0] if self.pieces.containsKey((part,)) else []
            self.pieces.updateValue((part,), ([*map(tuple, old), *new],))
        last = max(last, max(t.created_at for t in turns))
        self.head.update((user, lang, started, last, n + len(turns)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turns = sorted(rows, key=lambda t: (t.created_at, t.turn_no))
        last = self.head.get()[3] if self.head.exists() else None
        stretch: list[Row] = []
        for t in turns:
            if last is not None and t.created_at >= last + self.gap * 1000:
                if stretch:
                    self._add(stretch)
                yield from self._close(key[0])
                stretch = []
            stretch.append(t)
            last = t.created_at if last is None else max(last, t.created_at)
        self._add(stretch)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-last // 1000) + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.head.exists():
            yield from self._close(key[0])

    def close(self) -> None:
        pass


def stream_archive(turns: DataFrame, gap_minutes: int = K.IDLE_MINUTES, delay: str = "10 minutes",
                   per_row: int = TURNS_PER_ARCHIVE_ROW) -> DataFrame:
    """The archive rows of conversations that have been silent for ``gap_minutes``.

    ``turns`` streams the turns with their conversation's user_id, conversation_lang and started_at.
    The rows are those of ``archive_rollup``, with the end of the silence as ``archived_at``; one
    conversation that goes on after a silence is archived again, with its later turns. Nothing but
    the stream is read: the turns wait in state. Turns without a conversation, a number or a time,
    and turns behind the watermark, are left out. State is kept in RocksDB (``session.tune``).
    """
    micros = {"created_at": F.unix_micros("created_at"), "started_at": F.unix_micros("started_at")}
    late = turns.where("conversation_id IS NOT NULL AND turn_no IS NOT NULL AND created_at IS NOT NULL")
    rows = (late.withColumn("event_at", F.col("created_at")).withWatermark("event_at", delay)
            .select("conversation_id", "user_id", "conversation_lang", "event_at",
                    *[micros.get(c, F.col(c)).alias(c) for c in ("started_at", *TURN_FIELDS)]))
    closed = rows.groupBy("conversation_id").transformWithState(
        OpenConversations(gap_minutes * 60_000, per_row), CLOSED, "append", "eventTime")
    ordered = F.sort_array(F.transform("turns", lambda t: F.struct(*[
        (F.timestamp_micros(t[c]) if c == "created_at" else t[c]).alias(c) for c in TURN_FIELDS])))
    return closed.select(
        "conversation_id", "user_id", "lang", F.timestamp_micros("started_at").alias("started_at"),
        F.timestamp_micros("closed_at").alias("archived_at"), "turn_count", "part",
        F.to_json(ordered).alias("turns"))
