"""Indexes that several writers change at once: numbered versions, committed optimistically.

Beside ``index.json`` lies the folder ``index.json.versions``. A writer reads the last version n, makes its change and
creates version n + 1 by an atomic step that fails if another writer was first; then it reads again and makes its change anew. A
version exists whole or not at all, so a writer that dies leaves the index as it was. ``index.json`` is a copy of the
last version, put in place in one step.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from . import documents as D

TRIES = 1000


def _folder(path: Path) -> Path:
    return path.with_name(f"{path.name}.versions")


def last_version(path: str | Path) -> int:
    """Number of the last whole version; 0 without one."""
    folder = _folder(Path(path))
    return max((int(p.stem) for p in folder.glob("*.json") if p.stem.isdigit()), default=0) if folder.is_dir() else 0


def read_version(path: str | Path, version: int | None = None) -> dict[str, Any] | None:
    """The index of a version (the last one), or one written before there were versions; None without any."""
    path = Path(path)
    version = last_version(path) if version is None else version
    if version:
        return D.read(_folder(path) / f"{version:09}.json")
    return D.read(path) if path.exists() else None


def _whole(folder: Path, text: str) -> str:
    """A hidden file that holds the text on disk."""
    handle, name = tempfile.mkstemp(dir=folder, prefix=".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    return name


def _create(path: Path, version: int, text: str) -> bool:
    """Whether this call made the version: linking fails where the name is taken."""
    folder = _folder(path)
    folder.mkdir(parents=True, exist_ok=True)
    name = _whole(folder, text)
    try:
        os.link(name, folder / f"{version:09}.json")
    except FileExistsError:
        return False
    finally:
        os.unlink(name)
    return True


def _show(path: Path) -> None:
    """Put the last version in place of ``path``; again if there is a later one by then."""
    shown = 0
    while shown < (version := last_version(path)):
        name = _whole(path.parent, D.dumps(read_version(path, version)))
        os.chmod(name, 0o644)
        os.replace(name, path)
        shown = version


def commit(path: str | Path, change: Callable[[dict[str, Any] | None], dict[str, Any]]) -> tuple[int, dict[str, Any]]:
    """(version, index) of ``change(the last index)``, committed. ``change`` runs again whenever another
    writer was first, so it must depend on what it is given alone; an error in it leaves the index as it is."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(TRIES):
        version = last_version(path)
        index = change(read_version(path, version))
        if _create(path, version + 1, D.dumps(index)):
            _show(path)
            return version + 1, index
    raise D.ValidationError(f"{path} is changed by others all the time")
