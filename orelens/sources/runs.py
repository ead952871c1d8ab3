"""A run's state on the driver: identity, stages that are unlocked in order, temporary files, progress."""

from __future__ import annotations

import shutil
import time
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

STAGES = ("ingestion", "preprocessing", "features", "classification", "postprocess", "export")


def new_run_id() -> str:
    return uuid.uuid4().hex[:8].upper()


@dataclass
class Run:
    """Values by key with defaults, and the stages that may be entered; the first always may."""

    root: Path
    run_id: str = field(default_factory=new_run_id)
    values: dict[str, Any] = field(default_factory=dict)
    unlocked: set[str] = field(default_factory=lambda: {STAGES[0]})

    def get(self, key: str, default: Any = None) -> Any:
        return self.values.get(key, default)

    def set(self, key: str, value: Any) -> None:
        self.values[key] = value

    def unlock(self, stage: str) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        self.unlocked.add(stage)

    def is_unlocked(self, stage: str) -> bool:
        return stage in self.unlocked

    def folder(self, kind: str = "outputs") -> Path:
        out = self.root / kind / self.run_id
        out.mkdir(parents=True, exist_ok=True)
        return out

    def cleanup(self, kinds: tuple[str, ...] = ("uploads",)) -> list[Path]:
        """Removes the run's temporary folders, and nothing outside the root."""
        gone = []
        for kind in kinds:
            path = (self.root / kind / self.run_id).resolve()
            if self.root.resolve() in path.parents and path.is_dir():
                shutil.rmtree(path)
                gone.append(path)
        return gone

    def renew(self) -> "Run":
        """A fresh run under the same root, after the old one's temporary files are gone."""
        self.cleanup()
        return Run(self.root)


class Progress:
    """Calls back with (done, total, text), the text with the time that is left."""

    def __init__(self, say, clock=time.monotonic):
        self.say, self.clock, self.began = say, clock, clock()

    def __call__(self, done: int, total: int) -> None:
        spent = self.clock() - self.began
        left = spent / done * (total - done) if done else None
        self.say(done, total, f"{done}/{total}" + (f", about {_span(left)} left" if left is not None and done < total else ""))


def _span(seconds: float) -> str:
    return f"{seconds:.0f} s" if seconds < 60 else f"{seconds / 60:.1f} min"
