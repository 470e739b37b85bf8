"""Rows out of source files and tool output: symbols, imports, failures, tracebacks, conflicts, dependencies, hunks."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "name string, kind string, line_start int, line_end int, parent string"
#: Definition patterns by language; the first group is the kind, the second the name.
PATTERNS = {
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|const|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|mod)\s+([A-Za-z_]\w*)",
    "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*\b(class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "ruby": r"^\s*(def|class|module)\s+([A-Za-z_][\w.?!]*)",
    "sql": r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:unique\s+)?(table|view|index|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)",
    "markdown": r"^(#{1,6})\s+(.+?)\s*$",
}
#: Language by file name ending.
ENDINGS = {".py": "python", ".js": "js", ".ts": "js", ".tsx": "js", ".jsx": "js", ".mjs": "js", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "java", ".rb": "ruby", ".sql": "sql", ".md": "markdown"}


def language(path: str) -> str | None:
    return next((v for k, v in ENDINGS.items() if path.lower().endswith(k)), None)


def symbols(path: str, content: str) -> Iterator[tuple]:
    """Definitions with closed line ranges: Python by its grammar, others by pattern up to the next definition."""
    lang = language(path)
    rows = content.splitlines()
    if lang == "python":
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            return
        todo = [(n, None) for n in tree.body]
        while todo:
            n, parent = todo.pop(0)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent else "function"
                yield n.name, kind, n.lineno, n.end_lineno, parent
                todo += [(c, n.name) for c in n.body]
    elif lang:
        hits = [(i, m) for i, r in enumerate(rows, 1) if (m := re.match(PATTERNS[lang], r))]
        for (i, m), (j, _) in zip(hits, [*hits[1:], (len(rows) + 1, None)]):
            yield m[2], f"h{len(m[1])}" if lang == "markdown" else m[1].lower(), i, j - 1, None


def imports(path: str, content: str) -> Iterator[tuple]:
    """(module, line, names) of imports; exports of JavaScript with module ''."""
    for i, r in enumerate(content.splitlines(), 1):
        if m := re.match(r"\s*from\s+([\w.]+)\s+import\s+(.+)", r):
            yield m[1], i, m[2].strip("() ")
        elif m := re.match(r"\s*import\s+(?:(.+?)\s+from\s+)?['\"]([^'\"]+)['\"]", r):
            yield m[2], i, (m[1] or "").strip()
        elif m := re.search(r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r):
            yield m[1], i, ""
        elif m := re.match(r"\s*import\s+([\w.]+)", r):
            yield m[1], i, ""
        elif m := re.match(r"\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|interface|type)\s+([\w$]+)", r):
            yield "", i, m[1]


FAILURES = "tool string, test string, message string"
_FAIL = [
    ("pytest", re.compile(r"^FAILED (\S+)(?: - (.*))?$")),
    ("jest", re.compile(r"^\s*● (.+?)()$")),
    ("vitest", re.compile(r"^\s*(?:FAIL|×)\s+(\S.*?)(?:\s+\d+ms)?()$")),
    ("go", re.compile(r"^\s*--- FAIL: (\S+) \(([\d.]+s)\)")),
    ("cargo", re.compile(r"^test (\S+) \.\.\. FAILED()$")),
    ("generic", re.compile(r"^(?:ERROR|Error|FAIL(?:ED)?)[: ]+(.+)()$")),
]


def failures(text: str) -> Iterator[tuple]:
    """Failed tests of the first runner whose form the output has; each once."""
    rows = text.splitlines()
    for tool, pattern in _FAIL:
        hits = dict.fromkeys((tool, m[1], m[2] or None) for r in rows if (m := pattern.match(r)))
        if hits:
            yield from hits
            return


FRAMES = "kind string, file string, line int, func string"
_FRAMES = [
    ("python", re.compile(r'^\s*File "([^"]+)", line (\d+), in (.+)$'), (1, 2, 3)),
    ("node", re.compile(r"^\s*at (?:(.+?) \()?((?:/|[A-Za-z]:|file:|\.)[^():]*):(\d+):\d+\)?$"), (2, 3, 1)),
    ("jvm", re.compile(r"^\s*at ([\w.$<>]+)\(([\w.]+):(\d+)\)$"), (2, 3, 1)),
    ("dotnet", re.compile(r"^\s*at (.+?) in (.+):line (\d+)$"), (2, 3, 1)),
    ("rust", re.compile(r"^\s*at ([^\s:]+\.rs):(\d+)(?::\d+)?()$"), (1, 2, 3)),
]


def traceback(text: str) -> Iterator[tuple]:
    for r in text.splitlines():
        for kind, pattern, (f, n, g) in _FRAMES:
            if m := pattern.match(r):
                yield kind, m[f], int(m[n]), m[g] or None
                break


CONFLICTS = "line int, ours string, theirs string"


def conflicts(text: str) -> Iterator[tuple]:
    """Conflict regions with both sides; one that never ends is dropped."""
    start, side, ours, theirs = None, None, [], []
    for i, r in enumerate(text.splitlines(), 1):
        if r.startswith("<<<<<<< "):
            start, side, ours, theirs = i, "ours", [], []
        elif start and r.startswith("||||||| "):
            side = "base"
        elif start and r == "=======":
            side = "theirs"
        elif start and r.startswith(">>>>>>> "):
            yield start, "\n".join(ours), "\n".join(theirs)
            start = None
        elif start:
            (ours if side == "ours" else theirs if side == "theirs" else []).append(r)


HUNKS = "file string, lo int, hi int"


def hunks(text: str) -> Iterator[tuple]:
    """New-side line ranges of a unified diff; a pure deletion is the line before it."""
    file = None
    for r in text.splitlines():
        if r.startswith("+++ "):
            file = r[4:].split("\t")[0].removeprefix("b/")
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", r):
            n = int(m[2]) if m[2] is not None else 1
            if file != "/dev/null":
                yield file, int(m[1]), int(m[1]) + max(n, 1) - 1


DEPENDENCIES = "name string, version string"


def dependencies(path: str, content: str) -> Iterator[tuple]:
    """Locked packages of npm, Cargo, Poetry, Go, pip and Gemfile locks."""
    name = path.rsplit("/", 1)[-1]
    if name == "package-lock.json":
        for k, v in json.loads(content).get("packages", {}).items():
            if k:
                yield k.rsplit("node_modules/", 1)[-1], v.get("version")
    elif name in ("Cargo.lock", "poetry.lock"):
        for m in re.finditer(r'\[\[package\]\]\s*name = "([^"]+)"\s*version = "([^"]+)"', content):
            yield m[1], m[2]
    elif name == "go.sum":
        yield from dict.fromkeys((m[1], m[2]) for m in re.finditer(r"^(\S+) (v[^\s/]+)(?:/go\.mod)? h1:", content, re.M))
    elif name == "Gemfile.lock":
        yield from ((m[1], m[2]) for m in re.finditer(r"^    ([\w-]+) \(([^)]+)\)", content, re.M))
    elif name.endswith(".txt"):
        yield from ((m[1], m[2]) for m in re.finditer(r"^([A-Za-z0-9_.-]+)==([^\s;#]+)", content, re.M))


def extracted(df: DataFrame, text: str, extract: Callable[..., Iterator[tuple]], schema: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(*keep, *schema): the rows that an extractor finds in each text (and path)."""
    names = [*keep, *(c.split()[0] for c in schema.split(", "))]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    cols = list(dict.fromkeys([*keep, text, *([path] if path else [])]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                if r[text] is not None:
                    args = (r[path], r[text]) if path else (r[text],)
                    out += [(*(r[k] for k in keep), *x) for x in extract(*args)]
            yield pd.DataFrame(out, columns=names)

    return df.select(*cols).mapInPandas(run, f"{kinds}, {schema}")


FOLDS = "lo int, hi int, kind string"


def folds(path: str, content: str, least: int = 4) -> Iterator[tuple]:
    """Line ranges that a reader can skip: bodies of definitions, blocks of comment lines, long prose paragraphs."""
    rows = content.splitlines()
    for name, kind, lo, hi, _ in symbols(path, content):
        if kind not in ("class",) and not kind.startswith("h") and hi - lo >= least:
            yield lo + 1, hi, "body"
    sign = "#" if language(path) in ("python", "ruby") else "//" if language(path) not in (None, "markdown", "sql") else "--" if language(path) == "sql" else None
    start = None
    for i, r in enumerate([*rows, ""], 1):
        note = sign is not None and r.strip().startswith(sign)
        if note and start is None:
            start = i
        elif not note and start is not None:
            if i - start >= least:
                yield start, i - 1, "comment"
            start = None
    if language(path) == "markdown":
        for i, r in enumerate(rows, 1):
            if len(r) > 600 and not r.startswith(("#", "|", "-", ">")):
                yield i, i, "prose"
