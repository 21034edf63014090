"""What a run did, as a tree of timed spans on the driver, and as a table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "span_id int, parent_id int, name string, start double, end double, attributes map<string, string>"


@dataclass
class Span:
    name: str
    start: float
    end: float | None = None
    attributes: dict[str, object] = field(default_factory=dict)
    children: list[Span] = field(default_factory=list)


class Tracer:
    """``with tracer.span("parse", n=3) as span`` nests spans; a span that fails keeps its error as an attribute."""

    def __init__(self) -> None:
        self.roots: list[Span] = []
        self._open: list[Span] = []

    @contextmanager
    def span(self, name: str, **attributes: object) -> Iterator[Span]:
        new = Span(name, time.time(), attributes=dict(attributes))
        (self._open[-1].children if self._open else self.roots).append(new)
        self._open.append(new)
        try:
            yield new
        except BaseException as e:
            new.attributes["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            new.end = time.time()
            self._open.pop()

    def add(self, **attributes: object) -> None:
        """Attributes of the innermost open span; outside of spans they go nowhere."""
        if self._open:
            self._open[-1].attributes |= attributes

    def walk(self) -> Iterator[tuple[int, int | None, int, Span]]:
        """(number, parent's number, depth, span), parents first."""
        number, stack = 0, [(None, 0, s) for s in reversed(self.roots)]
        while stack:
            parent, depth, span = stack.pop()
            yield number, parent, depth, span
            stack += [(number, depth + 1, c) for c in reversed(span.children)]
            number += 1

    def format(self) -> str:
        """One line for each span; attributes that are empty, zero or false are left out."""
        out = []
        for _, _, depth, span in self.walk():
            took = "open" if span.end is None else f"{span.end - span.start:.3f} s"
            shown = "".join(f" {k}={v}" for k, v in span.attributes.items() if v)
            out.append("  " * depth + f"{span.name} ({took}){shown}")
        return "\n".join(out)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p, s.name, s.start, s.end, {k: str(v) for k, v in s.attributes.items()}) for i, p, _, s in self.walk()]
        return spark.createDataFrame(rows, SCHEMA)


class NoTracer(Tracer):
    """Takes the same calls and keeps nothing."""

    @contextmanager
    def span(self, name: str, **attributes: object) -> Iterator[Span]:
        yield Span(name, 0.0)
