"""Stateful streams whose state ends: typed state, event-time timers, late rows beside the result.

Each operator keeps a small typed state for its key in the state store and gives it up: when the key says its last (a call that is
confirmed, a turn's last piece, a document that is gone), or by an event-time timer once the watermark is an idle time beyond its newest
row. Of a key that has ended, a mark stays for that time, so that what comes too late is known as late. Late rows don't change
a result; they come out beside it with late true and the row as JSON, for a table of their own (run.split_late).

Order is by a sequence number within the key; rows of a batch are put in it first, so that results don't depend on how the stream is cut.
A row without a number moves the watermark and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.quantiles import Rolling

#: A step gives the new state, or ENDED, and the rows that come out.
ENDED = object()
Step = Callable[[dict, dict], tuple[object, list[tuple]]]
#: How far behind the newest event a row may be, and how long a key may be silent.
DELAY, IDLE_MS = "1 hour", 6 * 3_600_000


def fields(schema: str) -> tuple[list[str], list[str]]:
    names, kinds = zip(*(c.split(maxsplit=1) for c in schema.split(", ")), strict=True)
    return list(names), list(kinds)


def plain(v):
    """A pandas value as a Python one; null for what isn't there."""
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return v.item() if hasattr(v, "item") else v


class Ending(StatefulProcessor):
    """What the operators share: rows of a key in order, late rows, the timer that ends a key."""

    def __init__(self, schema: str, order: str, time: str, idle_ms: int = IDLE_MS):
        self.names, self.kinds = fields(schema)
        self.order, self.time, self.idle_ms = order, time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "at long, closed boolean")
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        """Reads what the key holds."""

    def row(self, row: dict) -> list[tuple] | None:
        """Rows that come out, or None once the key has ended (what comes out then is in self.last)."""
        raise NotImplementedError

    def keep(self) -> None:
        """Writes what the key holds."""

    def clear(self) -> None:
        raise NotImplementedError

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["late", "late_row", *self.names])
        return found.astype({n: "Int64" for n, k in zip(self.names, self.kinds, strict=True) if k in ("long", "int")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        rows = rows[rows[self.order].notna()].sort_values(self.order, kind="stable").to_dict("records")
        if not rows:
            return
        watermark, ends = timerValues.getCurrentWatermarkInMs(), self.ends.get()
        closed, fresh = bool(ends and ends[1]), ends is None
        newest, out, begun = ends[0] - self.idle_ms if ends else 0, [], False
        for r in rows:
            r = {k: plain(v) for k, v in r.items()}
            at = int(r[self.time].timestamp() * 1000)
            if closed or fresh and at < watermark:
                out.append((True, json.dumps(r, default=str, ensure_ascii=False), *(None for _ in self.names)))
                continue
            if not begun:
                self.begin()
                begun, fresh = True, False
            newest = max(newest, at)
            found = self.row(r)
            if found is None:
                closed, found = True, self.last
            out += [(False, None, *f) for f in found]
        if begun:
            if closed:
                self.clear()
            else:
                self.keep()
            if ends:
                self.handle.deleteTimer(ends[0])
            self.ends.update((newest + self.idle_ms, closed))
            self.handle.registerTimer(newest + self.idle_ms)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        self.ends.clear()
        return iter([])


class Folding(Ending):
    """One typed value for each key, changed row by row."""

    def __init__(self, schema: str, order: str, time: str, held: str, start: dict, step: Step, idle_ms: int = IDLE_MS):
        super().__init__(schema, order, time, idle_ms)
        self.held, self.start, self.step = held, start, step

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.held)

    def begin(self) -> None:
        found = self.value.get()
        self.now = dict(zip(fields(self.held)[0], found, strict=True)) if found else dict(self.start)

    def row(self, row: dict) -> list[tuple] | None:
        self.now, out = self.step(self.now, row)
        if self.now is ENDED:
            self.last = out
            return None
        return out

    def keep(self) -> None:
        self.value.update(tuple(self.now[n] for n in fields(self.held)[0]))

    def clear(self) -> None:
        self.value.clear()


def run(stream: DataFrame, key: str, processor: Ending, time: str, delay: str = DELAY, initial=None) -> DataFrame:
    """late, late_row and the processor's columns for a stream with a time column."""
    # the watermark stands on a column of its own: on the one that rows bring along, Spark would drop late ones unseen
    timed = stream.withColumn("_watermark", F.col(time)).withWatermark("_watermark", delay)
    columns = ", ".join(f"{n} {k}" for n, k in zip(processor.names, processor.kinds, strict=True))
    rows = timed.select(*stream.columns)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"late boolean, late_row string, {columns}", "Append", "EventTime", initialState=initial)


def alarms(stream: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """call_id, id, phase (alarm, confirmation) of patient turns (call_id, id, at, flagged boolean), and late rows.

    The first flagged turn arms the call, the patient's next turn ends it; what comes after that is late.
    """

    def step(held: dict, row: dict) -> tuple[object, list[tuple]]:
        if held["armed"]:
            return ENDED, [(row["call_id"], row["id"], "confirmation")]
        if row["flagged"]:
            return {"armed": True}, [(row["call_id"], row["id"], "alarm")]
        return held, []

    return run(stream, "call_id", Folding("call_id long, id long, phase string", "id", "at", "armed boolean", {"armed": False}, step, idle_ms), "at", delay)


class Feed(Ending):
    """The visible state of a document; nothing is held of one that is gone."""

    def __init__(self):
        super().__init__("id long, seq long, change string", "seq", "at")

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "visible string")

    def clear(self) -> None:
        self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        held = self.seen.get()
        before = seen = held[0] if held else None
        out = []
        for r in rows[rows["seq"].notna()].sort_values("seq", kind="stable").itertuples(index=False):
            now = plain(r.visible)
            if now != seen:
                out.append((False, None, r.id, r.seq, "eliminado" if now is None else "documento"))
            seen = now
        if seen is None and before is not None:
            self.seen.clear()
        elif seen != before:
            self.seen.update((seen,))
        if out:
            yield self.frame(out)


def change_feed(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """id, seq, change for each row (id, seq, at, visible string or null when gone) that changes what is seen of a document.

    A document that exists is held for as long as it exists, however silent; one that is gone leaves no state.
    """
    return run(stream, "id", Feed(), "at", delay)


class Sentences(Folding):
    """The open end of a turn's text and how many sentences came before it."""

    def __init__(self, split: Callable[[str], tuple[list[str], str]], idle_ms: int):
        def step(held: dict, row: dict) -> tuple[object, list[tuple]]:
            closed, rest = split(held["rest"] + (row["piece"] or ""))
            if row["last"] and rest.strip():
                closed = [*closed, rest.strip()]
            out = [(row["turn_id"], held["n"] + i, s) for i, s in enumerate(closed)]
            return (ENDED if row["last"] else {"rest": rest, "n": held["n"] + len(closed)}), out

        super().__init__("turn_id long, nth long, sentence string", "seq", "at", "rest string, n long", {"rest": "", "n": 0}, step, idle_ms)


def sentences(stream: DataFrame, split: Callable[[str], tuple[list[str], str]], delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Sentences of each turn as soon as they are closed, from its pieces (turn_id, seq, at, piece, last boolean), and late pieces.

    split gives the closed sentences of a text and its open rest.
    """
    return run(stream, "turn_id", Sentences(split, idle_ms), "at", delay)


class Leases(StatefulProcessor):
    """The newest heartbeat of a job and a timer at the end of its lease."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.beat = handle, handle.getValueState("beat", "last long")

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["job_id", "expired_at_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, watermark, out = self.beat.get(), timerValues.getCurrentWatermarkInMs(), []
        last = before = held[0] if held else None
        for at in sorted(int(t) for t in pd.concat(list(rows))["at_ms"].dropna()):
            if last is None and at < watermark:
                continue  # the lease of a beat this late has been answered for
            if last is not None and at - last > self.lease_ms:
                out.append((key[0], last + self.lease_ms))
            last = at if last is None else max(last, at)
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.lease_ms)
            self.beat.update((last,))
            self.handle.registerTimer(last + self.lease_ms)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.beat.clear()
        yield self.frame([(key[0], expiredTimerInfo.getExpiryTimeInMs())])

    def close(self) -> None:
        pass


def expired_leases(stream: DataFrame, lease_ms: int, delay: str = "1 minute") -> DataFrame:
    """job_id, expired_at_ms: each lease (heartbeats job_id, at) that ended before the job's next heartbeat.

    A heartbeat takes the timer of the one before away, if it comes in time (a lease's last millisecond included). Of a job that
    stays silent the timer tells once the watermark has passed it. Nothing is held of a job whose lease has ended.
    """
    timed = stream.select("job_id", F.floor(F.unix_micros("at") / 1000).alias("at_ms"), F.col("at").alias("_watermark")).withWatermark("_watermark", delay)
    return timed.select("job_id", "at_ms").groupBy("job_id").transformWithStateInPandas(Leases(lease_ms), "job_id long, expired_at_ms long", "Append", "EventTime")


class Conversation(Ending):
    """A call's conversation: settled utterances only ever appended, the last one and the sums beside them.

    What a message writes doesn't depend on how long the call is.
    """

    UTTERANCE = "who string, text string, open boolean, citations string, ms string"
    SUMS = "settled long, settled_open long, interruptions long, discarded_ms long, pending string, flag string, phase string, reason string"
    SCHEMA = "call_id long, utterances long, open long, citations long, interruptions long, discarded_ms long, end_reason string, flag string, texts string"

    def __init__(self, idle_ms: int = IDLE_MS):
        super().__init__(self.SCHEMA, "seq", "at", idle_ms)

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", self.UTTERANCE)
        self.latest = handle.getValueState("latest", self.UTTERANCE)
        self.sums = handle.getValueState("sums", self.SUMS)
        self.cited = handle.getMapState("cited", "citation string", "n long")

    def begin(self) -> None:
        found, last = self.sums.get(), self.latest.get()
        zero = {"settled": 0, "settled_open": 0, "interruptions": 0, "discarded_ms": 0, "pending": "[]", "flag": None, "phase": None, "reason": None}
        self.now = dict(zip(fields(self.SUMS)[0], found, strict=True)) if found else zero
        self.open = dict(zip(fields(self.UTTERANCE)[0], last, strict=True)) if last else None
        self.settled = []

    def say(self, utterance: dict) -> None:
        if self.open:
            self.settled.append(tuple(self.open.values()))
            self.now["settled"] += 1
            self.now["settled_open"] += self.open["open"]
        self.open = utterance

    def row(self, row: dict) -> list[tuple] | None:
        kind, body, now, last = row["kind"], json.loads(row["body"] or "{}"), self.now, self.open
        if kind == "transcripcion":
            who = body.get("quien", "paciente")
            if last and last["who"] == who and last["open"]:
                last |= {"text": body["texto"], "open": body.get("parcial", False)}
            else:
                own = who == "agente"
                self.say({"who": who, "text": body["texto"], "open": body.get("parcial", False), "citations": now["pending"] if own else "[]", "ms": "{}"})
                now["pending"] = "[]" if own else now["pending"]
        elif kind == "citas" and body.get("citas"):
            for c in body["citas"]:
                if not self.cited.containsKey((json.dumps(c),)):
                    self.cited.updateValue((json.dumps(c),), (1,))
            if last and last["who"] == "agente" and last["open"]:
                has = json.loads(last["citations"])
                last["citations"] = json.dumps(has + [c for c in body["citas"] if c not in has])
            else:
                now["pending"] = json.dumps(body["citas"])
        elif kind == "bandera_roja":
            now["flag"] = body.get("urgencia", "urgente")
        elif kind == "metricas" and last:
            last["ms"] = json.dumps(json.loads(last["ms"]) | body.get("ms", {}))
        elif kind == "nota":
            if last:
                last["open"] = False
            self.say({"who": "sistema", "text": body.get("texto"), "open": False, "citations": "[]", "ms": "{}"})
        elif kind == "interrupcion":
            now["interruptions"] += 1
            now["discarded_ms"] += int(body.get("ms", 0))
        elif kind == "estado":
            now["phase"] = body.get("fase")
        elif kind in ("fin", "terminar"):
            now["reason"] = body.get("motivo") if kind == "fin" else now["reason"] or body.get("motivo")
            now["phase"] = None
            if kind == "fin":
                self.last = [self.folded(row["call_id"])]
                return None
        return []

    def folded(self, call_id: int) -> tuple:
        said = [*(dict(zip(fields(self.UTTERANCE)[0], s, strict=True)) for s in [*self.said.get(), *self.settled]), *([self.open] if self.open else [])]
        now, tail = self.now, self.open
        return (call_id, now["settled"] + bool(tail), now["settled_open"] + bool(tail and tail["open"]), sum(1 for _ in self.cited.keys()), now["interruptions"], now["discarded_ms"], now["reason"], now["flag"], " | ".join(f"{u['who']}: {u['text']}" for u in said))

    def keep(self) -> None:
        if self.settled:
            self.said.appendList(self.settled)
        if self.open:
            self.latest.update(tuple(self.open.values()))
        self.sums.update(tuple(self.now[n] for n in fields(self.SUMS)[0]))

    def clear(self) -> None:
        for state in (self.said, self.latest, self.sums, self.cited):
            state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A snapshot's messages of the call go through the same steps once."""
        self.begin()
        newest = 0
        for r in initialState.sort_values("seq", kind="stable").to_dict("records"):
            r = {k: plain(v) for k, v in r.items()}
            newest = max(newest, int(r["at"].timestamp() * 1000))
            self.row(r)
        self.keep()
        self.ends.update((newest + self.idle_ms, False))
        self.handle.registerTimer(newest + self.idle_ms)


def conversations(stream: DataFrame, snapshot: DataFrame | None = None, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """The folded conversation of each call at the message that ends it (call_id, seq, at, kind, body JSON), and late messages.

    snapshot: messages of calls that were under way when the stream began, as a table; the stream goes on from there.
    """
    initial = snapshot.groupBy("call_id") if snapshot is not None else None
    return run(stream, "call_id", Conversation(idle_ms), "at", delay, initial)


class Frames(Ending):
    """The last so many values of a stream of frames, as bytes."""

    def __init__(self, p: float, frame: int, idle_ms: int):
        super().__init__("stream_id long, id long, p double", "id", "at", idle_ms)
        self.p, self.size = p, frame

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", "held binary")

    def begin(self) -> None:
        found = self.values.get()
        self.window = Rolling(self.size, np.frombuffer(found[0]).tolist() if found else [])

    def row(self, row: dict) -> list[tuple]:
        self.window.push(np.inf if row["value"] is None else row["value"])
        return [(row["stream_id"], row["id"], self.window.percentile(self.p))]

    def keep(self) -> None:
        self.values.update((np.array(self.window.held).tobytes(),))

    def clear(self) -> None:
        self.values.clear()


def rolling(stream: DataFrame, p: float, frame: int, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """stream_id, id, p of the last so many values of each stream (stream_id, id, at, value) at each frame, as quantiles.rolling_percentile()."""
    return run(stream, "stream_id", Frames(p, frame, idle_ms), "at", delay)
