"""Change events of a mounted tree, found by polling, as files that a stream reads (``streaming.events_stream``)."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from codeloom.sources.repo import _walk

EVENTS = "path string, kind string, ts timestamp"


def look(root: str) -> dict[str, tuple[int, int]]:
    """path -> (time of change in nanoseconds, bytes) of every file that the scan would see."""
    out = {}
    for p, size in _walk(root):
        try:
            out[p] = (os.stat(os.path.join(root, p)).st_mtime_ns, size)
        except OSError:  # gone in between
            continue
    return out


def differences(before: dict, now: dict) -> list[tuple[str, str]]:
    """(path, created | modified | deleted), sorted."""
    kinds = {p: "created" if p not in before else "modified" for p in now if before.get(p) != now[p]}
    return sorted([*kinds.items(), *((p, "deleted") for p in before if p not in now)])


def write_events(events: list[tuple[str, str]], folder: str, at: float) -> str | None:
    """One file of JSON lines, renamed into place when it is whole; None without events."""
    if not events:
        return None
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"{uuid.uuid4().hex}.json")
    ts = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(at)) + f".{int(at % 1 * 1000):03d}Z"
    with open(name + ".part", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"path": p, "kind": k, "ts": ts}) + "\n" for p, k in events)
    os.rename(name + ".part", name)
    return name


def watch(root: str, folder: str, go_on: Callable[[], bool], pause: float = 1.0) -> int:
    """Poll a tree while ``go_on()`` and write its changes; the number of events. For a thread beside the stream."""
    n, before = 0, look(root)
    while go_on():
        time.sleep(pause)
        now = look(root)
        events = differences(before, now)
        write_events(events, folder, time.time())
        n, before = n + len(events), now
    return n
