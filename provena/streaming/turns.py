"""The life of a conversation's turn as one stateful operator: admission, memory, two attempts, a stored reply or rejection."""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provena.functions.text import references
from provena.operators.chat import MOST_QUESTION, MOST_TURNS, citation_status, reply_error

REMEMBERED, ATTEMPTS = 2, 2
STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
APOLOGY = "No valid reply was made to this question."
ENDED = "the conversation has its ten turns"
OUT = "run_id string, turn_no long, ordinal int, scope string, text string, items array<string>, citation_status string, error string, generation_attempts int, history array<long>"


def judged(turns: DataFrame, known: Column, devices: Column) -> DataFrame:
    """(run_id, turn_no, question, question_error, attempts): each reply of replies with the first rule that it breaks, its references and their status."""
    question = F.trim(F.coalesce("question", F.lit("")))
    wrong = F.when(~F.coalesce(F.col("run_id").rlike("^[0-9a-f]{32}$"), F.lit(False)), "run").when(~F.length(question).between(1, MOST_QUESTION), "question")
    one = lambda r: F.struct(F.trim(r).alias("text"), reply_error(r, known, devices).alias("error"), references(r).alias("items"), citation_status(r).alias("citation_status"))
    return turns.select("run_id", F.col("turn_no").cast("long").alias("turn_no"), question.alias("question"), wrong.alias("question_error"), F.transform(F.slice("replies", 1, ATTEMPTS), one).alias("attempts"))


class Turns(StatefulProcessor):
    """State of a run: how many turns it has admitted, at most ten, and the last two that were answered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getValueState("admitted", "n int")
        self.recent = handle.getListState("recent", "turn_no long, question string, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        n = found[0] if (found := self.admitted.get()) else 0
        recent = [tuple(r) for r in self.recent.get()]
        room: list[tuple[int, int, Row]] = []  # the first turns that still have room, largest on top; no more than ten are held
        for i, row in enumerate(rows):
            if row["question_error"]:
                yield self._row(key, row["turn_no"], None, "invalid", None, row["question_error"], 0, [])
                continue
            heapq.heappush(room, (-row["turn_no"], -i, row))
            if len(room) > MOST_TURNS - n:
                late = heapq.heappop(room)[2]
                yield self._row(key, late["turn_no"], None, "ended", None, ENDED, 0, [])
        for _, _, row in sorted(room, key=lambda r: (-r[0], -r[1])):
            n += 1
            history = [t for t, _, _ in recent]
            tried, error, taken = 0, "no reply", None
            for attempt in row["attempts"] or []:
                tried, error = tried + 1, attempt["error"]
                if not error:
                    taken = attempt
                    break
            if taken:
                recent = [*recent, (row["turn_no"], row["question"], taken["text"])][-REMEMBERED:]
                yield self._row(key, row["turn_no"], n, "conversation", taken, None, tried, history)
            else:
                yield self._row(key, row["turn_no"], n, "rejected", None, error, tried, history)
        self.admitted.update((n,))
        if recent:
            self.recent.put(recent)

    @staticmethod
    def _row(key: tuple, turn_no: int, ordinal: int | None, scope: str, taken: Row | None, error: str | None, tried: int, history: list[int]) -> Row:
        text, items, status = (taken["text"], list(taken["items"]), taken["citation_status"]) if taken else (APOLOGY, [], None)
        return Row(run_id=key[0], turn_no=turn_no, ordinal=ordinal, scope=scope, text=text, items=items, citation_status=status, error=error, generation_attempts=tried, history=history)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keeping_state(spark: SparkSession):
    """State that this operator needs a store for, set for the queries that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, STATES)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def lifecycle(turns: DataFrame) -> DataFrame:
    """Every turn of a stream of judged ones, once: answered or rejected with the turns that it remembers, ended beyond ten, or invalid.

    Turns of a batch are taken by turn_no; invalid ones are not counted. Rejected turns are counted, kept and never
    remembered. A turn without replies is rejected. To be started within keeping_state.
    """
    return turns.groupBy("run_id").transformWithState(Turns(), OUT, "Append", "None")
