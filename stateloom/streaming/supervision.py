"""Supervised runs as a keyed stream: events in, diagnostics out, by checkers that remember.

Events of a run are numbered.  They are applied in order of their numbers, each once, however
they arrive: early ones wait in a map state until those before them are there.  A checker is
a function of its state (a JSON object) and an event; what it says becomes diagnostics, and
what it keeps is there at the next event, also after a restart.  A run keeps the first
diagnostics and the last ones, and says at its end how many lie between.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Kinds of events, severities, and what the supervisor itself reports.
EVENTS = ("start", "line", "tick", "source-eof", "process-exit")
SEVERITIES = ("info", "warning", "error", "fatal")
TRUNCATED, PROTOCOL_ERROR = "diagnostics_truncated", "checker_protocol_error"

SCHEMA = "run_id long, number long, event string, source string, line string, at timestamp"
OUTPUT = "run_id long, number long, code string, severity string, summary string, source string, evidence string, stop boolean"
#: A checker's step: (state, event) -> (state, diagnostics), a diagnostic being code, severity, summary, and perhaps evidence and stop.
Step = Callable[[dict, Mapping[str, Any]], tuple[dict, Sequence[Mapping[str, Any]]]]


class Checker(NamedTuple):
    name: str
    step: Step
    required: bool = False


def judged(checker: Checker, state: dict, event: Mapping[str, Any]) -> tuple[dict | None, list[tuple]]:
    """A checker's next state, None once it has broken, and its diagnostics: (code, severity, summary, source, evidence, stop)."""
    source = f"checker:{checker.name}"
    try:
        after, said = checker.step(json.loads(json.dumps(state)), event)
        json.dumps(after)
        out = []
        for d in said:
            severity = d.get("severity", "error")
            if severity not in SEVERITIES:
                raise ValueError(f"invalid severity {severity!r}")
            evidence = d.get("evidence")
            out.append((str(d.get("code", "checker")), severity, str(d.get("summary", "")), str(d.get("source", source)), None if evidence is None else str(evidence), bool(d.get("stop", False))))
        return after, out
    except Exception as e:  # noqa: BLE001  a checker may raise anything; it is not asked again
        return None, [(PROTOCOL_ERROR, "fatal" if checker.required else "warning", f"{type(e).__name__}: {e}", source, None, checker.required)]


def applied(run: dict, event: Mapping[str, Any], checkers: Sequence[Checker], keep: int) -> list[tuple]:
    """The diagnostics that one event brings out; ``run`` (states, said, tail, dropped, stopped) is changed.

    The first keep/2 of a run come out at once, later ones wait as its last keep/2 and come
    out at its end; one that stops the run always comes out at once.
    """
    found = []
    for c in checkers:
        state = run["states"].get(c.name, {})
        if state is None:
            continue
        run["states"][c.name], said = judged(c, state, event)
        found += said
    out = []
    for d in found:
        if run["said"] < keep // 2 or (d[5] and not run["stopped"]):
            run["said"] += 1
            out.append((event["number"], *d))
        else:
            run["tail"].append([event["number"], *d])
            if len(run["tail"]) > keep - keep // 2:
                run["tail"].pop(0)
                run["dropped"] += 1
        run["stopped"] |= d[5]
    if event["event"] == "process-exit":
        if run["dropped"]:
            out.append((event["number"], TRUNCATED, "warning", f"{run['dropped']} intermediate diagnostics were dropped", "supervisor", None, False))
        out += [tuple(d) for d in run["tail"]]
        run["tail"], run["ended"] = [], True
    return out


def new_run() -> dict:
    return {"states": {}, "said": 0, "tail": [], "dropped": 0, "stopped": False, "ended": False, "next": 0}


class Supervisor(StatefulProcessor):
    def __init__(self, checkers: Sequence[Checker], keep: int):
        self.checkers, self.keep = list(checkers), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "state string")
        self.waiting = handle.getMapState("waiting", "number long", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = json.loads(self.run.get()[0]) if self.run.exists() else new_run()
        out: list[tuple] = []
        for batch in rows:
            for number, event, source, line, at in batch[["number", "event", "source", "line", "at"]].itertuples(index=False):
                # What was applied before, or comes behind the end, changes nothing.
                if number >= run["next"] and not run["ended"] and not self.waiting.containsKey((int(number),)):
                    packed = {"number": int(number), "event": event, "source": source, "line": line, "at": str(at)}
                    self.waiting.updateValue((int(number),), (json.dumps(packed),))
        while not run["ended"] and self.waiting.containsKey((run["next"],)):
            event = json.loads(self.waiting.getValue((run["next"],))[0])
            self.waiting.removeKey((run["next"],))
            out += applied(run, event, self.checkers, self.keep)
            run["next"] += 1
        if run["ended"]:
            self.waiting.clear()
            # Enough stays to know the run as ended.
            run |= {"states": {}}
        self.run.update((json.dumps(run),))
        yield pd.DataFrame([(key[0], *d) for d in out], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def supervised(events: DataFrame, checkers: Sequence[Checker], keep: int = 200) -> DataFrame:
    """The diagnostics (OUTPUT) of a stream of numbered events (SCHEMA), numbers from 0 in each run.

    The session needs the RocksDB state store (``clocks.needed_settings``).
    """
    rows = events.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    return rows.groupBy("run_id").transformWithStateInPandas(Supervisor(checkers, keep), OUTPUT, "append", "none")


def supervised_of(events: DataFrame, checkers: Sequence[Checker], keep: int = 200) -> DataFrame:
    """The same diagnostics from all events at once, one run after the other in its partition's order of numbers."""
    ordered = events.dropDuplicates(["run_id", "number"]).repartition("run_id").sortWithinPartitions("run_id", "number")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, new_run()
        for batch in batches:
            out = []
            for e in batch.to_dict("records"):
                if e["run_id"] != at:
                    at, now = e["run_id"], new_run()
                if e["number"] == now["next"] and not now["ended"]:
                    out += [(at, *d) for d in applied(now, {**e, "at": str(e["at"])}, checkers, keep)]
                    now["next"] += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return ordered.mapInPandas(run, OUTPUT)


# Checkers


def repeated_line(pattern: str, times: int, code: str, severity: str = "error", stop: bool = True) -> Step:
    """Says so when a pattern has matched ``times`` lines in a row."""
    import re

    rule = re.compile(pattern)

    def step(state: dict, event: Mapping[str, Any]) -> tuple[dict, list[dict]]:
        if event["event"] != "line":
            return state, []
        n = state.get("n", 0) + 1 if rule.search(event["line"] or "") else 0
        hit = [{"code": code, "severity": severity, "summary": f"{n} lines in a row", "evidence": event["line"], "stop": stop}] if n == times else []
        return {"n": n}, hit

    return step


def quiet_ticks(most: int, code: str = "no_output") -> Step:
    """Says so when so many ticks have passed without a line, once until the next line."""

    def step(state: dict, event: Mapping[str, Any]) -> tuple[dict, list[dict]]:
        ticks = {"tick": state.get("ticks", 0) + 1, "line": 0}.get(event["event"], state.get("ticks", 0))
        said = [{"code": code, "severity": "warning", "summary": f"no line for {most} ticks"}] if ticks == most and event["event"] == "tick" else []
        return {"ticks": ticks}, said

    return step


def missing_at_exit(pattern: str, code: str) -> Step:
    """Says so at a run's end if no line has matched."""
    import re

    rule = re.compile(pattern)

    def step(state: dict, event: Mapping[str, Any]) -> tuple[dict, list[dict]]:
        seen = state.get("seen", False) or (event["event"] == "line" and rule.search(event["line"] or "") is not None)
        return {"seen": seen}, [{"code": code, "severity": "error", "summary": "the run ended without it"}] if event["event"] == "process-exit" and not seen else []

    return step
