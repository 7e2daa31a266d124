"""Concurrent writers of an index, and one that dies."""

import json
import multiprocessing
import os

import pytest

from sextant.artifacts import commits
from sextant.artifacts import documents as D


def _add(path, names):
    for n in names:
        commits.commit(path, lambda index, n=n: {"names": sorted([*(index or {"names": []})["names"], n])})


def test_concurrent_upserts_all_survive(tmp_path):
    path = tmp_path / "at" / "index.json"
    jobs = [multiprocessing.get_context("spawn").Process(target=_add, args=(path, [f"{w}-{i}" for i in range(10)])) for w in range(4)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert commits.last_version(path) == 40 and len(D.read(path)["names"]) == 40 == len(set(D.read(path)["names"]))
    assert D.read(path) == commits.read_version(path) and len(commits.read_version(path, 7)["names"]) == 7
    assert sorted(p.name for p in path.parent.iterdir()) == ["index.json", "index.json.versions"]


def test_a_writer_that_dies_leaves_the_index(tmp_path, monkeypatch):
    path = tmp_path / "index.json"
    _add(path, ["a"])

    def dies(*_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        commits.commit(path, dies)
    monkeypatch.setattr(os, "link", dies)  # before the version is there
    with pytest.raises(KeyboardInterrupt):
        _add(path, ["b"])
    monkeypatch.undo()
    assert commits.last_version(path) == 1 and D.read(path) == {"names": ["a"]}
    monkeypatch.setattr(commits, "_show", dies)  # after it, before the copy
    with pytest.raises(KeyboardInterrupt):
        _add(path, ["b"])
    monkeypatch.undo()
    assert D.read(path) == {"names": ["a"]} and commits.read_version(path) == {"names": ["a", "b"]}
    _add(path, ["c"])
    assert D.read(path) == {"names": ["a", "b", "c"]}


def test_an_index_without_versions_is_the_first(tmp_path):
    path = tmp_path / "index.json"
    assert commits.read_version(path) is None and commits.last_version(path) == 0
    path.write_text(json.dumps({"names": ["old"]}))
    _add(path, ["new"])
    assert D.read(path) == {"names": ["new", "old"]} and commits.last_version(path) == 1


def test_a_writer_that_always_comes_second_gives_up(tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "TRIES", 3)
    monkeypatch.setattr(commits, "_create", lambda *_: False)
    with pytest.raises(D.ValidationError, match="changed by others"):
        _add(tmp_path / "index.json", ["a"])
