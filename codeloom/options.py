"""Options of a run: environment files, the environment and overrides, as one typed record.

Later sources win: files in the order given, then the environment, then explicit overrides. A file holds ``NAME=value`` lines; blank
lines and ``#`` comments are skipped, an ``export`` before the name and quotes around the value are dropped.
"""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Mapping
from pathlib import Path

_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$")


@dataclasses.dataclass(frozen=True)
class Options:
    """Which analyses run, and the limits they keep."""

    dead_code: bool = True
    test_gaps: bool = True
    impact: bool = False
    security: bool = False
    refactor: bool = False
    embeddings: bool = False
    base_branch: str = "main"
    max_running_jobs: int = 3
    max_file_tokens: int = 50_000


def read_env(path: str) -> dict[str, str]:
    """Names and values of an environment file; a missing file has none."""
    out: dict[str, str] = {}
    if not Path(path).is_file():
        return out
    for line in Path(path).read_text(encoding="utf-8", errors="replace").splitlines():
        m = _LINE.match(line)
        if not m or line.lstrip().startswith("#"):
            continue
        v = m.group(2)
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            v = v[1:-1]
        else:
            v = re.sub(r"\s+#.*$", "", v)
        out[m.group(1)] = v
    return out


def options(files: list[str] = [], environ: Mapping[str, str] | None = None, prefix: str = "CODELOOM_", **given) -> Options:
    """Options from files, the environment (names with the prefix) and keyword overrides; a value that does not fit its type raises."""
    raw: dict[str, str] = {}
    for f in files:
        raw |= read_env(f)
    raw |= dict(os.environ if environ is None else environ)
    out = {}
    for f in dataclasses.fields(Options):
        text = raw.get(prefix + f.name.upper())
        if text is None or text == "":
            continue
        if f.type == "bool":
            if text.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
                raise ValueError(f"{f.name}: {text!r} is neither true nor false")
            out[f.name] = text.lower() in ("1", "true", "yes", "on")
        else:
            out[f.name] = int(text) if f.type == "int" else text
    return dataclasses.replace(Options(), **{**out, **given})
