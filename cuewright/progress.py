"""Row counts at named steps of a plan, and messages on the way."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """``step`` counts the rows that pass while an action runs, at no job of its own; ``say`` gets the messages."""

    def __init__(self, say: Callable[[str], None] | None = None):
        self._say = say
        self._seen: dict[str, Observation] = {}

    def say(self, message: str) -> None:
        if self._say:
            self._say(message)

    def step(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, its rows counted under ``name``. A name given again counts anew; a plan that reads a step twice (a global sort does) counts twice."""
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"))

    def counts(self) -> dict[str, int]:
        """Rows of each step. Waits for an action that runs them, so call it once the result is written."""
        return {name: _rows(seen) for name, seen in self._seen.items()}


def _rows(seen: Observation) -> int:
    try:
        return seen.get["rows"]
    except Py4JError:  # nothing came to the step, so the plan went on without it
        return 0


def counted(progress: Progress | None, name: str, df: DataFrame) -> DataFrame:
    return progress.step(name, df) if progress else df


def percent_hook(say: Callable[[str], None]) -> Callable[[dict], None]:
    """For a downloader's progress events: passes on percentages without colour codes, and 100% at the end."""
    def hook(event: dict) -> None:
        if event.get("status") == "finished":
            say("100%")
        elif event.get("status") == "downloading":
            shown = re.sub("\x1b[^m]*m", "", event.get("_percent_str", "")).strip()
            if shown and shown != "N/A%":
                say(shown)

    return hook
