"""Speech turns as a stream, and what batch and stream share of conversations and sentences.

Speech turns keep one small state for a stream of frames and give the same rows however it is cut into batches: frames carry their
number, and those of a batch are put in its order first. Streams whose keys end are in streaming.ending.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.turns import BARGE_IN_MS, FRAME_MS, SILENCE_MS, START_MS, THRESHOLD

Step = Callable[[dict, dict], list[tuple]]


def fold(stream: DataFrame, key: str, order: str, schema: str, start: dict, step: Step) -> DataFrame:
    """Rows that step(state, row) gives for the rows of each key in their order; state is a dict of JSON values that it changes."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(c.split(maxsplit=1) for c in schema.split(", "))

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(start))
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = [r for row in rows.to_dict("records") for r in step(held, row)]
        state.update((json.dumps(held),))
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({n: "Int64" for n in names if kinds[n] in ("long", "int", "bigint")})

    return stream.groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def speech(stream: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """The events of operators.turns.speech_events from a stream of frames; the clock is the frame number."""

    def step(held: dict, row: dict) -> list[tuple]:
        now = (int(row["frame_no"]) + 1) * FRAME_MS
        if row["prob"] >= THRESHOLD:
            held["voiced"] += FRAME_MS
            held["silent"], held["last"] = 0, now
        else:
            held["silent"] += FRAME_MS
            held["voiced"] = 0
        if not held["speaking"] and held["voiced"] >= (BARGE_IN_MS if row["agent_speaking"] else START_MS):
            held["speaking"] = True
            return [(row["stream_id"], "start", now - held["voiced"], now)]
        if held["speaking"] and held["silent"] >= silence_ms:
            held["speaking"] = False
            return [(row["stream_id"], "end", held["last"], now)]
        return []

    return fold(stream, "stream_id", "frame_no", "stream_id long, kind string, ms long, decision_ms long", {"voiced": 0, "silent": 0, "last": 0, "speaking": False}, step)


def conversation_step(held: dict, kind: str, body: dict, instant: int) -> None:
    """One message into the state of a call's conversation.

    Text of a speaker whose utterance is open replaces it. A new utterance of the agent takes the citations that came before
    it; citations that come while it is open join it. Metrics belong to the last utterance. A note closes what is open.
    """
    said = held["said"]
    last = said[-1] if said else None
    if kind == "transcripcion":
        who = body.get("quien", "paciente")
        if last and last["who"] == who and last["open"]:
            last |= {"text": body["texto"], "open": body.get("parcial", False)}
        else:
            own = who == "agente"
            said.append({"who": who, "text": body["texto"], "open": body.get("parcial", False), "citations": held["pending"] if own else [], "ms": {}, "at": instant})
            held["pending"] = [] if own else held["pending"]
    elif kind == "citas" and body.get("citas"):
        held["citations"] += [c for c in body["citas"] if c not in held["citations"]]
        if last and last["who"] == "agente" and last["open"]:
            last["citations"] = last["citations"] + [c for c in body["citas"] if c not in last["citations"]]
        else:
            held["pending"] = body["citas"]
    elif kind == "bandera_roja":
        held["flag"] = {"reason": body.get("motivo"), "urgency": body.get("urgencia", "urgente")}
    elif kind == "metricas":
        if last:
            last["ms"] |= body.get("ms", {})
    elif kind == "nota":
        if last:
            last["open"] = False
        said.append({"who": "sistema", "text": body.get("texto"), "open": False, "citations": [], "ms": {}, "at": instant})
    elif kind == "interrupcion":
        held["interruptions"] += 1
        held["discarded_ms"] += body.get("ms", 0)
    elif kind == "estado":
        held["phase"] = body.get("fase")
    elif kind in ("fin", "terminar"):
        held["end"] = body.get("motivo") if kind == "fin" else held["end"] or body.get("motivo")
        held["phase"] = None


CONVERSATION = {"said": [], "pending": [], "citations": [], "flag": None, "phase": None, "end": None, "interruptions": 0, "discarded_ms": 0}
FOLDED = "call_id long, utterances long, open long, citations long, interruptions long, discarded_ms long, end_reason string, flag string, texts string"


def _folded(call_id: int, held: dict) -> tuple:
    flag = held["flag"] and held["flag"]["urgency"]
    return (call_id, len(held["said"]), sum(u["open"] for u in held["said"]), len(held["citations"]), held["interruptions"], held["discarded_ms"], held["end"], flag, " | ".join(f"{u['who']}: {u['text']}" for u in held["said"]))


def folded_batch(messages: DataFrame) -> DataFrame:
    """The same for whole calls at once; one call is one group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = json.loads(json.dumps(CONVERSATION))
        for r in rows.sort_values("seq").to_dict("records"):
            conversation_step(held, r["kind"], json.loads(r["body"]), int(r["seq"]))
        return pd.DataFrame([_folded(key[0], held)], columns=[c.split()[0] for c in FOLDED.split(", ")])

    return messages.groupBy("call_id").applyInPandas(run, FOLDED)


def sentence_pieces(pending: str, split: Callable[[str], list[str]]) -> tuple[list[str], str]:
    """Closed sentences of what has come so far and the rest, white space at its end included."""
    found = split(pending)
    if len(found) < 2:
        return [], pending
    at = pending.rfind(found[-1])
    rest = pending[at:] if at >= 0 else found[-1] + pending[len(pending.rstrip()) :]
    return found[:-1], rest
