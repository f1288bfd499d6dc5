"""What a stage's function tells while it runs: log lines, heartbeats and steps, as events of the run.

Each worker process appends JSON lines to a file of its own in the run's folder, so writers never mix; readers of
:mod:`gridweave.sources.run_store` and the streams over them take the folder. Outside a flow with ``events`` the calls do nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from gridweave.sources.run_store import append_line

_context: dict[str, Any] | None = None
_files: dict[tuple[str, int], str] = {}


@contextmanager
def sending(folder: str | None, context: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """Events sent within go to ``folder`` with the fields of ``context``."""
    global _context
    before, _context = _context, {"_folder": folder, **context}
    try:
        yield _context
    finally:
        _context = before


def run_context() -> dict[str, Any] | None:
    """run_id, row_id, stage and attempt of the call that is going on; None outside one."""
    return None if _context is None else {k: v for k, v in _context.items() if not k.startswith("_")}


def emit(event_type: str, severity: str = "info", source: str = "user", **more: Any) -> None:
    """One event with the fields of the call that is going on."""
    if _context is None or _context["_folder"] is None:
        return
    folder = _context["_folder"].removeprefix("file://")
    key = folder, os.getpid()
    if key not in _files:
        os.makedirs(folder, exist_ok=True)
        _files[key] = os.path.join(folder, f"{uuid.uuid4().hex}.jsonl")
    append_line(_files[key], run_context() | {"timestamp": datetime.now(UTC).isoformat(), "event_type": event_type, "severity": severity, "source": source} | more)


def log(message: str, severity: str = "info", **more: Any) -> None:
    """A line of a user's own log."""
    emit("user_log", severity, "user", message=message, **more)


def heartbeat(message: str | None = None, stage: str | None = None, **more: Any) -> None:
    """A sign of life, of the stage if there is one."""
    stage = stage or (_context or {}).get("stage")
    emit("stage_heartbeat" if stage else "worker_heartbeat", "info", "heartbeat", **({"message": message} if message else {}), **({"stage": stage} if stage else {}), **more)


def step(stage: str, state: str = "started", message: str | None = None, severity: str = "info", **more: Any) -> None:
    """A step of a longer piece of work: started, heartbeat or completed. Until it is completed it is the stage of
    what else is sent."""
    if state not in ("started", "heartbeat", "completed"):
        raise ValueError("state is started, heartbeat or completed")
    if _context is None:
        return
    if state == "started":
        _context.setdefault("_outer", []).append(_context.get("stage"))
        _context["stage"] = stage
    emit(f"stage_{state}", severity, "user", stage=stage, **({"message": message} if message else {}), **more)
    if state == "completed" and _context.get("_outer"):
        _context["stage"] = _context["_outer"].pop()
