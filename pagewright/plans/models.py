"""Models on workers: set up once, and swapped while jobs and streams go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

_LOADED: dict[str, tuple[str, Any]] = {}


@dataclass(frozen=True)
class Model:
    """What makes a model where it is needed. A worker keeps one object of a name from task to task; when rows come with
    another version, that takes its place."""

    name: str
    version: str
    factory: Callable[[], Any]

    def get(self) -> Any:
        if _LOADED.get(self.name, (None,))[0] != self.version:
            _LOADED.pop(self.name, None)  # the old one goes before the new one is there
            _LOADED[self.name] = (self.version, self.factory())
        return _LOADED[self.name][1]


class Slot:
    """The model in use of a name, on the driver. Jobs, and each batch of a stream, take what is there as they start."""

    def __init__(self, name: str, version: str, factory: Callable[[], Any]):
        self._now = Model(name, version, factory)

    def swap(self, version: str, factory: Callable[[], Any]) -> None:
        self._now = Model(self._now.name, version, factory)

    @property
    def now(self) -> Model:
        return self._now


def in_use(fn: Any) -> Any:
    """fn itself, or of a slot the model in it now; to be sent to workers."""
    return fn.now if isinstance(fn, Slot) else fn


def ready(fn: Any) -> Any:
    """On a worker: what is to be called."""
    return fn.get() if isinstance(fn, Model) else fn
