"""Tools as registered functions: typed arguments, staged calls with codes, retries by error class, bounded loops."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.calls import Policy, call

TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool}


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., object]
    args: dict[str, str] = field(default_factory=dict)  # name -> JSON type
    required: tuple[str, ...] = ()
    choices: dict[str, tuple] = field(default_factory=dict)
    description: str = ""
    idempotent: bool = True

    def schema(self) -> str:
        props = {k: {"type": t, **({"enum": list(self.choices[k])} if k in self.choices else {})} for k, t in self.args.items()}
        return json.dumps({"type": "object", "properties": props, "required": list(self.required)}, sort_keys=True)

    def problems(self, given: dict) -> str:
        out = [f"{k}: missing" for k in self.required if k not in given]
        for k, v in given.items():
            if k in self.args and (not isinstance(v, TYPES[self.args[k]]) or isinstance(v, bool) != (self.args[k] == "boolean")):
                out.append(f"{k}: not {self.args[k]}")
            elif k in self.choices and v not in self.choices[k]:
                out.append(f"{k}: not allowed")
        return "; ".join(out)


class Registry:
    def __init__(self, tools: Iterable[Tool]):
        self.tools = {t.name: t for t in tools}

    def catalogue(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, t.name, t.description, t.schema(), t.idempotent) for i, t in enumerate(self.tools.values())], "seq int, name string, description string, input_schema string, idempotent boolean")

    def call(self, name: str, args: str | None) -> tuple[str | None, str | None, str | None]:
        """(code, result, error); never raises."""
        t = self.tools.get(name)
        if t is None:
            return "UNKNOWN_TOOL", None, f"no tool {name}"
        try:
            given = json.loads(args or "{}")  # no arguments are an empty set of arguments
            if not isinstance(given, dict):
                raise ValueError("not an object")
        except ValueError as e:
            return "INVALID_JSON", None, str(e)
        if p := t.problems(given):
            return "VALIDATION_ERROR", None, p
        try:
            return None, str(t.run(**given)), None
        except Exception as e:  # noqa: BLE001
            return "EXECUTION_ERROR", None, f"{type(e).__name__}: {e}"

    def calls(self, df: DataFrame, key: str, name: str, args: str) -> DataFrame:
        """(key, code, result, error). Only tools without side effects belong here: Spark may run a task again."""
        wrong = [t.name for t in self.tools.values() if not t.idempotent]

        def run(it):
            for pdf in it:
                rows = [("BLOCKED_WRITE", None, "not idempotent") if n in wrong else self.call(n, a) for n, a in zip(pdf[name], pdf[args])]
                yield pd.DataFrame({key: pdf[key], "code": [r[0] for r in rows], "result": [r[1] for r in rows], "error": [r[2] for r in rows]})

        return df.select(key, name, args).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, code string, result string, error string")


class Ended(Exception):
    """An attempt that ended with a given class of failure."""

    def __init__(self, klass: str):
        super().__init__(klass)
        self.status_code = {"SAFE": 503, "UNKNOWN": 504}.get(klass, 400)


def attempts_allowed(outcomes: list[str | None], idempotent: bool, most: int = 3) -> tuple[int, bool, float]:
    """(attempts made, blocked, seconds waited) of a call whose attempts would end as given (None: success): operators.calls on a log."""
    log = iter(outcomes)

    def attempt() -> None:
        o = next(log, None)
        if o is not None:
            raise Ended(o)

    r = call(attempt, policy=Policy(attempts=most, idempotent=idempotent), sleep=lambda s: None)
    return r.attempts, r.blocked, r.waited_s


def reflect_loop(task: str, act: Callable[[str, str], str], judge: Callable[[str, str], tuple[bool, str]], trials: int = 3) -> list[tuple[int, str, bool, str]]:
    """(trial, answer, passed, feedback) per trial; the feedback of a failed trial goes into the next one."""
    log, feedback = [], ""
    for n in range(1, trials + 1):
        answer = act(task, feedback)
        ok, feedback = judge(task, answer)
        log.append((n, answer, ok, feedback))
        if ok:
            break
    return log


def resolve_engine(wanted: str, available: dict[str, bool], fallback: str | None = None) -> str:
    """The engine to use; one that is not there gives way to the fallback, else it is an error."""
    if available.get(wanted):
        return wanted
    if fallback and available.get(fallback):
        return fallback
    raise LookupError(f"engine {wanted} is not available")


def is_bold(spans: str = "spans"):
    """Any span with the bold flag or a bold font; ``spans`` is an array of struct(flags, font)."""
    return F.expr(f"exists({spans}, s -> s.flags & 16 <> 0 OR contains(s.font, 'Bold'))")


def clean_fields(desc: str, allowed: tuple[str, ...] = ("ocr_text", "vlm_description")):
    """Struct of the allowed fields of a map column, trimmed, empty ones null."""
    return F.struct(*[F.expr(f"nullif(trim(try_element_at({desc}, '{k}')), '')").alias(k) for k in allowed])
