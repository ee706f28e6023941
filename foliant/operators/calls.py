"""Calls that may fail: what kind of failure it was decides whether the call is made again."""
from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

SAFE, UNKNOWN, NO = "SAFE", "UNKNOWN", "NO"


def failure_class(e: BaseException) -> str:
    """As operators.resilience.error_class, for an exception: its status if it has one, then its kind, then its name."""
    status = getattr(e, "status_code", None) or getattr(getattr(e, "response", None), "status_code", None)
    if status is not None:
        return SAFE if status in (429, 503) or (status >= 500 and status != 504) else UNKNOWN if status == 504 else NO
    name = type(e).__name__
    low = name.lower()
    if name == "ConnectTimeout":
        return SAFE
    if isinstance(e, (TimeoutError, ConnectionResetError, BrokenPipeError)) or name == "ChunkedEncodingError" or "timeout" in low or "timed out" in str(e).lower():
        return UNKNOWN
    if isinstance(e, ConnectionError) or any(w in low for w in ("connection", "network", "dns")):
        return SAFE
    return UNKNOWN if any(w in low for w in ("reset", "broken", "chunked")) else NO


@dataclass(frozen=True)
class Policy:
    """``attempts`` calls of an idempotent function, SAFE and UNKNOWN failures are tried again; another function is called
    once and, if that failed SAFE, ``attempts`` times more for SAFE failures. Waits of one loop double from ``base_s``."""

    attempts: int = 3
    base_s: float = 1.0
    timeout_s: float | None = None
    idempotent: bool = True


@dataclass(frozen=True)
class Outcome:
    ok: bool
    data: object = None
    error: str | None = None
    klass: str | None = None
    attempts: int = 1
    waited_s: float = 0.0
    blocked: bool = False  # an effect may have happened: the function must not be called again


def within(timeout_s: float | None, f: Callable, *args):
    """f(*args), or TimeoutError once the time is over; what the call still does is left to itself."""
    if timeout_s is None:
        return f(*args)
    box: dict = {}

    def run() -> None:
        try:
            box["data"] = f(*args)
        except BaseException as e:  # noqa: BLE001
            box["error"] = e

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(timeout_s)
    if t.is_alive():
        raise TimeoutError(f"no answer within {timeout_s} s")
    if "error" in box:
        raise box["error"]
    return box["data"]


def call(f: Callable, *args, policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Calls f under the policy; never raises. The error text tells how often it was really called."""
    again = {SAFE, UNKNOWN} if policy.idempotent else {SAFE}
    # after each call: the wait before the next one, or None
    waits = [policy.base_s * 2**k for k in range(policy.attempts - 1)] + [None]
    if not policy.idempotent:
        waits = [0.0, *waits]
    waited = 0.0
    for n, wait in enumerate(waits, 1):
        try:
            return Outcome(True, within(policy.timeout_s, f, *args), attempts=n, waited_s=waited)
        except Exception as e:  # noqa: BLE001
            klass = failure_class(e)
            if klass not in again or wait is None:
                text = f"{type(e).__name__}: {e}" + (f" (called {n} times)" if n > 1 else "")
                return Outcome(False, None, text, klass, n, waited, not policy.idempotent and klass == UNKNOWN and n == 1)
            if wait:
                sleep(wait)
                waited += wait
    raise AssertionError
