"""Path patterns over nested data: ``$``, ``.key``, ``.*``, ``[n]``, ``[*]``, ``..``, ``..key``, ``..*``.

A pattern is matched against a whole path, a tuple of keys (str) and indexes
(int). In a typed schema an array's elements share one symbolic index; then a
match is a set of demands on the indexes, met by the row's own positions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ANY_INDEX = object()
"""A path's segment for every element of an array."""


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    kind: str
    """key, index, or deep (any number of segments)."""
    value: str | int | None = None
    """None: any."""


_STEP = re.compile(r"(?P<deep>\.\.)(?P<deep_key>\*|[A-Za-z_][\w\-]*)?|\.(?P<key>\*|[A-Za-z_][\w\-]*)|\[(?P<index>\*|\d+)\]")


def parse_path(pattern: str) -> tuple[Step, ...]:
    if not pattern.startswith("$"):
        raise PathError(f"a path starts with '$': {pattern!r}")
    steps: list[Step] = []
    at = 1
    while at < len(pattern):
        m = _STEP.match(pattern, at)
        if m is None:
            raise PathError(f"bad path at offset {at} in {pattern!r}")
        if m["deep"]:
            steps.append(Step("deep"))
        if key := m["deep_key"] or m["key"]:
            steps.append(Step("key", None if key == "*" else key))
        elif m["index"]:
            steps.append(Step("index", None if m["index"] == "*" else int(m["index"])))
        at = m.end()
    if not steps:
        raise PathError(f"the path names nothing: {pattern!r}")
    return tuple(steps)


Demand = tuple[tuple[int, int], ...]
"""(which array on the way, position) pairs that must hold."""


def demands(steps: tuple[Step, ...], path: tuple) -> set[Demand]:
    """How the pattern can fit a path: sets of demands on its symbolic indexes. An empty demand always holds; no demands: it never fits."""
    # states after each segment: how many steps are done, and what was demanded on the way
    def open_ends(states: set[tuple[int, Demand]]) -> set[tuple[int, Demand]]:
        out = set(states)
        todo = list(states)
        while todo:
            done, d = todo.pop()
            if done < len(steps) and steps[done].kind == "deep" and (done + 1, d) not in out:
                out.add((done + 1, d))
                todo.append((done + 1, d))
        return out

    states = open_ends({(0, ())})
    arrays = 0
    for segment in path:
        following: set[tuple[int, Demand]] = set()
        for done, d in states:
            if done < len(steps):
                step = steps[done]
                if step.kind == "deep":
                    following.add((done, d))
                elif step.kind == "key":
                    if isinstance(segment, str) and step.value in (None, segment):
                        following.add((done + 1, d))
                elif segment is ANY_INDEX:
                    following.add((done + 1, d if step.value is None else (*d, (arrays, step.value))))
                elif isinstance(segment, int) and step.value in (None, segment):
                    following.add((done + 1, d))
        arrays += segment is ANY_INDEX
        states = open_ends(following)
    return {d for done, d in states if done == len(steps)}


def path_fits(steps: tuple[Step, ...], path: tuple) -> bool:
    """Whether the pattern fits a concrete path."""
    return bool(demands(steps, path))


def render_path(path: tuple) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in path)
