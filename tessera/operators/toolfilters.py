"""Filters of tool output: a registry by program and subcommand; a filter's result counts only if it is shorter."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Rule = tuple[str, str | None]


@dataclass
class ToolFilter:
    """Ordered line rules (None drops a line) for some programs; errors pass as they are."""

    name: str
    programs: tuple[str, ...]
    rules: list[Rule]
    subcommands: tuple[str, ...] = ()
    keep: str = r"(?i)\b(error|fail(ed|ure)?|panic|exception|fatal)\b"
    most: int = 200
    extra: Callable[[list[str]], list[str]] | None = field(default=None)

    def matches(self, argv: list[str]) -> bool:
        return bool(argv) and argv[0].rsplit("/", 1)[-1] in self.programs and (not self.subcommands or any(a in self.subcommands for a in argv[1:3]))

    def apply(self, text: str, code: int) -> str:
        out = []
        for line in text.splitlines():
            if not re.search(self.keep, line):
                for pattern, to in self.rules:
                    if to is None and re.search(pattern, line):
                        break
                    line = re.sub(pattern, to, line) if to is not None else line
                else:
                    out.append(line)
                continue
            out.append(line)
        out = self.extra(out) if self.extra else out
        if code == 0 and len(out) > self.most:
            head, tail = out[: self.most // 2], out[-self.most // 2 :]
            out = [*head, f"... {len(out) - len(head) - len(tail)} lines ...", *tail]
        return "\n".join(out)


#: The registry, first match first.
FILTERS = [
    ToolFilter("tests", ("pytest", "jest", "vitest"), [(r"^\s*$", None), (r" PASSED\b|^\s*✓|^PASS ", None), (r"^=+ .* =+$", None)]),
    ToolFilter("packages", ("npm", "pnpm", "yarn", "pip"), [(r"^(npm )?(WARN|notice)\b", None), (r"^(Collecting|Downloading|Requirement already)", None), (r"^\s*$", None)], ("install", "i", "ci", "add")),
    ToolFilter("builds", ("cargo", "go", "make", "mvn", "gradle"), [(r"^\s*(Compiling|Downloaded|Downloading|Checking) ", None), (r"^\s*$", None)]),
    ToolFilter("git", ("git",), [(r"^\s*\(use \"git .*\)$", None), (r"^index [0-9a-f]+\.\.", None), (r"^\s*$", None)]),
]


OUTPUTS = 64  # that a task holds at once


def dispatch(command: str) -> ToolFilter | None:
    argv = [a for a in command.split() if "=" not in a.split("/")[0] or a.startswith("-")]
    return next((f for f in FILTERS if f.matches(argv)), None)


def reduced(command: str, text: str, code: int = 0) -> tuple[str, str | None]:
    """(text, filter): the filter's text where it is shorter, else the text as it is and no filter."""
    f = dispatch(command)
    out = f.apply(text, code) if f else text
    return (out, f.name) if f and len(out.encode()) < len(text.encode()) else (text, None)


def filtered(df: DataFrame, command: str, text: str, keep: list[str]) -> DataFrame:
    """(*keep, filter, bytes_before, bytes_after, output) of rows with a command and its output."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(frames):
        for f in (f[at : at + OUTPUTS] for f in frames for at in range(0, len(f), OUTPUTS)):
            done = [reduced(c or "", t or "") for c, t in zip(f[command], f[text])]
            out = f[keep].copy()
            out["filter"] = [n for _, n in done]
            out["bytes_before"] = [len((t or "").encode()) for t in f[text]]
            out["bytes_after"] = [len(o.encode()) for o, _ in done]
            out["output"] = [o for o, _ in done]
            yield pd.DataFrame(out)

    return df.select(*dict.fromkeys([*keep, command, text])).mapInPandas(run, f"{kinds}, filter string, bytes_before long, bytes_after long, output string")
