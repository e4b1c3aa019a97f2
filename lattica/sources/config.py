"""Which archives a run reads: a configuration file and its rules of inclusion."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

KNOWN = ("archives", "folder", "include", "exclude", "schema", "index")


@dataclass
class Selection:
    archives: list[str] = field(default_factory=list)
    unused_excludes: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def find(start: str, name: str = "lattica.json", switch: str = "LATTICA_NO_CONFIG") -> tuple[dict, list[str]] | None:
    """The nearest configuration upwards of a folder, paths resolved against it, and its unknown keys; none if the environment has the switch set."""
    if os.environ.get(switch, "") not in ("", "0"):
        return None
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        if (path := folder / name).is_file():
            raw = json.loads(path.read_text("utf-8"))
            resolve = lambda v: [str((folder / x).resolve()) for x in v] if isinstance(v, list) else str((folder / v).resolve())
            return {k: resolve(v) if k in ("archives", "folder", "include", "schema", "index") else v for k, v in raw.items()}, [k for k in raw if k not in KNOWN]
    return None


def select(folder: str, exclude: list[str] = (), include: list[str] = ()) -> Selection:
    """Archives of a folder in sorted order, less the excluded ones, and those included by name, which no exclusion touches; each once."""
    out, seen, used = Selection(), set(), set()
    root = Path(folder)
    names = sorted(p for p in root.iterdir() if p.suffix.lower() in (".jar", ".zip")) if root.is_dir() else []
    if not root.is_dir():
        out.missing.append(folder)
    for p in names:
        hits = {e for e in exclude if fnmatch.fnmatch(p.name.lower(), e.lower())}
        used |= hits
        if not hits and (key := str(p.resolve()).lower()) not in seen:
            seen.add(key)
            out.archives.append(str(p))
    for i in include:
        if not Path(i).is_file():
            out.missing.append(i)
        elif (key := str(Path(i).resolve()).lower()) not in seen:
            seen.add(key)
            out.archives.append(i)
    out.unused_excludes = [e for e in exclude if e not in used]
    return out


def stamp(paths: list[str]) -> str:
    """16 hex digits that change with any of the files' paths, sizes or times, not with their order."""
    lines = [f"{p}\0{Path(p).stat().st_size}\0{Path(p).stat().st_mtime_ns}" for p in sorted(paths)]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
