"""Ordered stages with a start, a single-stage and a stop switch."""

from __future__ import annotations

from collections.abc import Callable


def run(stages: list[tuple[str, Callable[[], object]]], start: str | None = None, only: str | None = None) -> dict[str, object]:
    """Run stages in order and return their results; unknown names are errors."""
    names = [n for n, _ in stages]
    for wanted in (start, only):
        if wanted is not None and wanted not in names:
            raise KeyError(f"{wanted}: not one of {names}")
    out, on = {}, start is None
    for name, stage in stages:
        on = on or name == start
        if on and only in (None, name):
            out[name] = stage()
    return out
