"""Events of a query's life: what was parsed, planned, scanned, joined, aggregated and run, and how long it took."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

INVOKED, PARSED, PLANNED, COMPLETE, FAILED = "query/invoked", "query/parsed", "query/planned", "query/complete", "error/query"
SCAN, LOG, JOIN, PRODUCT, FILTER, EXPRESSION, SUBQUERY, AGGREGATION = "pattern/scan", "pattern/log", "join/natural", "join/product", "filter", "expression", "subquery", "aggregation"


@dataclass(frozen=True)
class Event:
    name: str
    start: float  # seconds since 1970
    end: float
    data: dict[str, Any] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.end - self.start


class Collector:
    """Keeps events and gives each to the handler, if there is one. Planning events come while a query is
    compiled, on the driver; they cost no job."""

    def __init__(self, handler: Callable[[Event], None] | None = None):
        self.handler, self.events = handler, []

    def add(self, name: str, start: float | None = None, **data: Any) -> None:
        now = time.time()
        event = Event(name, now if start is None else start, now, data)
        self.events.append(event)
        if self.handler:
            self.handler(event)

    @contextmanager
    def timed(self, name: str, **data: Any) -> Iterator[dict[str, Any]]:
        """The event is added at the end; the body may put more data into the dict. A failure is an event too."""
        start = time.time()
        try:
            yield data
        except Exception as e:
            self.add(f"{FAILED}.{name.partition('/')[2]}", start, error=str(e), **data)
            raise
        self.add(name, start, **data)

    def reset(self) -> None:
        self.events = []

    def seconds(self, name: str) -> float:
        """Of all events of this name."""
        return sum(e.seconds for e in self.events if e.name == name)


def relation_text(variables: list[str], rows: int | None = None) -> str:
    """`Relation([?a ?b], 3 rows)`."""
    return f"Relation([{' '.join(variables)}]{'' if rows is None else f', {rows} rows'})"


def event_text(e: Event) -> str:
    """One line for people."""
    data = dict(e.data)
    where = data.pop("table", None)
    of = relation_text(data.pop("variables")) if "variables" in data else ""
    parts = [f"[{e.seconds * 1000:.1f} ms]", e.name, *([f"on {where}"] if where else []), *([of] if of else []), *(f"{k}={v}" for k, v in sorted(data.items()))]
    return " ".join(parts)


class Console:
    """A handler that prints."""

    def __init__(self, write: Callable[[str], None] = print):
        self.write = write

    def __call__(self, e: Event) -> None:
        self.write(event_text(e))
