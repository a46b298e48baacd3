"""Which files there are, asked on the driver (lists of paths, never their content), and small text configs.

Programs are run with a time limit and never raise: without them, or outside a repository, the answer is None.
"""

from __future__ import annotations

import re
import subprocess
from collections import deque
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Folders that hold no sources of their own.
SKIPPED = (".venv", "node_modules", "target", "build", "dist")
DELTA = "action string, rel_path string, old_path string, similarity int"


def _git(root: str | Path, *args: str, seconds: int = 5) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def git_files(root: str | Path) -> list[str] | None:
    """Tracked and untracked but not ignored paths below ``root``."""
    said = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard", seconds=30)
    return None if said is None else sorted({p for p in said.split("\0") if p})


def listed(spark: SparkSession, root: str | Path, paths: list[str], ignore: list[str] | None = None) -> DataFrame:
    """(rel_path, language, size_bytes, mtime, content) of the given paths below ``root`` that are indexed."""
    base = str(Path(root).resolve())
    there = [f"file://{base}/{p}" for p in paths if (Path(base) / p).is_file()]
    shape = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.read.format("binaryFile").load(there) if there else spark.createDataFrame([], shape)
    rel = F.substring(F.regexp_replace("path", r"^file:/*", "/"), len(base) + 2, 1 << 20)
    return files.indexed_files(raw.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content"), ignore)


def walk_git(spark: SparkSession, root: str | Path, ignore: list[str] | None = None) -> DataFrame:
    """The files that version control lists; without it, all files below ``root``."""
    paths = git_files(root)
    return files.walk(spark, f"file://{Path(root).resolve()}", ignore) if paths is None else listed(spark, root, paths, ignore)


def nested_repos(root: str | Path, depth: int = 4) -> list[Path]:
    """Folders below ``root`` (not itself) that hold a repository, breadth first down to ``depth``."""
    found, queue = [], deque([(Path(root), 0)])
    while queue:
        at, d = queue.popleft()
        if d >= depth:
            continue
        try:
            children = sorted(p for p in at.iterdir() if p.is_dir())
        except OSError:
            continue
        for child in children:
            if child.name == ".git":
                if at != Path(root):
                    found.append(at)
            elif child.name not in SKIPPED:
                queue.append((child, d + 1))
    return found


def walk_nested(spark: SparkSession, root: str | Path, depth: int = 4, root_first: bool = True, ignore: list[str] | None = None) -> DataFrame:
    """Files of the root's repository and of those nested in it, by paths below ``root``, each file once."""
    base, seen = Path(root), []
    repos = ([base] if root_first and (base / ".git").is_dir() else []) + nested_repos(base, depth)
    for repo in repos:
        prefix = "" if repo == base else f"{repo.relative_to(base)}/"
        seen += [f"{prefix}{p}" for p in git_files(repo) or []]
    return listed(spark, root, list(dict.fromkeys(seen)), ignore)


def git_identity(root: str | Path) -> dict[str, str | None]:
    """remote_url, default_branch and head_commit of a repository; None for what is not known."""
    clean = lambda x: (x or "").strip() or None
    head = clean(_git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD"))
    branch = head.removeprefix("origin/") if head else clean(_git(root, "rev-parse", "--abbrev-ref", "HEAD"))
    return {"remote_url": clean(_git(root, "remote", "get-url", "origin")), "default_branch": branch, "head_commit": clean(_git(root, "rev-parse", "HEAD"))}


def repo_name(root: str | Path) -> str | None:
    """Key of a repository without a remote: ``local:`` and its root; outside of one ``path:`` and the folder."""
    top = _git(root, "rev-parse", "--show-toplevel")
    return f"local:{top.strip()}" if top else f"path:{Path(root).resolve()}"


def parse_deltas(said: str) -> list[tuple[str, str, str | None, int | None]]:
    """Rows of ``git diff --name-status -z``: (action, rel_path, old_path, similarity)."""
    parts, rows, i = said.split("\0"), [], 0
    while i < len(parts) and parts[i]:
        code = parts[i]
        pair = code[0] in "RC"
        old, path = (parts[i + 1], parts[i + 2]) if pair else (None, parts[i + 1])
        action = {"M": "modify", "D": "delete", "R": "rename"}.get(code[0], "add")
        rows.append((action, path, old if code[0] == "R" else None, int(code[1:] or 0) if pair else None))
        i += 3 if pair else 2
    return rows


def git_deltas(spark: SparkSession, root: str | Path, since: str, similar: int = 80) -> DataFrame | None:
    """Changes from ``since`` to HEAD as a change feed; None if they cannot be told (then index all)."""
    said = _git(root, "diff", "--name-status", "-z", f"-M{similar}%", f"{since}..HEAD", seconds=60)
    return None if said is None else spark.createDataFrame(parse_deltas(said), DELTA)


def parse_entries(body: str, top: str) -> list[dict]:
    """The mappings listed under ``top:`` in a small YAML file: scalars, ``[a, b]`` and lists one level deep."""
    out: list[dict] = []
    inside, lists_at, key = False, None, None
    bare = lambda x: x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x
    for n, raw in enumerate(body.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if not line[0].isspace() and not line.startswith("- "):
            inside, lists_at = line == f"{top}:", None
            continue
        if not inside:
            continue
        indent, body_ = len(line) - len(line.lstrip()), line.strip()
        if body_.startswith("- ") and (lists_at is None or indent <= lists_at):
            lists_at, key = indent, None
            out.append({"line": n})
            body_ = body_[2:].strip()
        elif body_.startswith("- ") and out and key:
            out[-1].setdefault(key, [])
            out[-1][key] = [*(out[-1][key] or []), bare(body_[2:].strip())]
            continue
        if not out:
            raise ValueError(f"line {n}: an entry must start with `- `")
        name, colon, value = body_.partition(":")
        if not colon:
            out[-1] |= {"value": bare(body_)}
            continue
        key, value = name.strip(), value.strip()
        out[-1][key] = [bare(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else bare(value) if value else None
    return out


def parse_glossary(body: str) -> list[tuple[str, str, list[str], str | None]]:
    """(term, definition, aliases, category) of a glossary file; both first ones are required."""
    rows = []
    for i, e in enumerate(parse_entries(body, "terms")):
        if not e.get("term") or not e.get("definition"):
            raise ValueError(f"entry {i} (line {e['line']}): term and definition are required")
        rows.append((e["term"], e["definition"], e.get("aliases") or [], e.get("category")))
    return rows


def read_glossary(spark: SparkSession, places: list[str | Path]) -> DataFrame:
    """Terms of the first glossary file that exists among ``places``; no rows without one."""
    body = next((Path(p).read_text() for p in places if Path(p).is_file()), "")
    return spark.createDataFrame(parse_glossary(body), "term string, definition string, aliases array<string>, category string")
