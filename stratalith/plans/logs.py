"""Structured log of the pipeline: counts and codes, never names or values."""

from __future__ import annotations

import json
import logging
import sys
import time
import uuid
from typing import Any, TextIO

LEVELS = ("trace", "debug", "info", "warn", "error", "fatal", "silent")
EVENTS = (
    "run_started", "run_finished", "run_failed", "mode_selected", "scope_checked", "scope_rejected", "retrieval_started", "retrieval_skipped", "retrieval_finished",
    "prompt_built", "model_called", "statement_extracted", "statement_rejected", "guard_warned", "parameters_kept", "parameters_dropped",
    "index_started", "index_batch", "index_finished", "index_stale", "chunks_built", "embedder_changed", "search_finished",
)


class EventLog:
    """JSON lines to a stream or file, with one correlation id a run. Only numbers, booleans and codes are taken as fields."""

    def __init__(self, target: TextIO | str | None = None, level: str = "info", correlation: str | None = None) -> None:
        if level not in LEVELS:
            raise ValueError(f"level is one of {', '.join(LEVELS)}")
        self.level, self.correlation = level, correlation or uuid.uuid4().hex
        self.stream: TextIO = open(target, "a", encoding="utf-8") if isinstance(target, str) else target or sys.stderr  # noqa: SIM115

    def emit(self, event: str, level: str = "info", **fields: Any) -> None:
        """Write one event; text fields beyond a short code are refused."""
        if event not in EVENTS:
            raise ValueError(f"no event {event}")
        if any(isinstance(v, str) and (len(v) > 40 or not v.replace("_", "").isalnum()) for v in fields.values()):
            raise ValueError("a log field is a number, a boolean or a code")
        if LEVELS.index(level) >= LEVELS.index(self.level):
            self.stream.write(json.dumps({"time": round(time.time(), 3), "level": level, "event": event, "correlation": self.correlation} | fields) + "\n")
            self.stream.flush()


def quiet_spark(level: str = "WARN") -> None:
    """Hide py4j's chatter."""
    logging.getLogger("py4j").setLevel(level)
