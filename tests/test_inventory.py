"""Inventories of files that change between two scans, and ledgers against manifests."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import inventory


def base():
    return F.regexp_extract("path", r"([^/]*)$", 1)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "files"
    (top / "2024-05-06 notes").mkdir(parents=True)
    for name, text in {"a.MD": "one", "b.txt": "two", "2024-05-06 notes/c.md": "one", "plain": "three", ".hidden.md": "no", "d.md": ""}.items():
        (top / name).write_text(text)
    return top


def names(rows, field):
    return {x.path.rsplit("/", 1)[1]: x[field] for x in rows}


def test_inventory(spark, folder):
    rows = inventory.inventory(inventory.digests(spark, str(folder))).collect()
    assert names(rows, "format") == {"a.MD": "md", "b.txt": "txt", "c.md": "md", "plain": "", "d.md": "md"}
    assert {x.path.rsplit("/", 1)[1] for x in rows if x.duplicate_of} in ({"a.MD"}, {"c.md"}) and names(rows, "date_hint")["c.md"] == "2024-05-06"
    assert names(rows, "sha256")["b.txt"] == sha(b"two") and names(rows, "size")["d.md"] == 0


def test_refresh(spark, folder, monkeypatch):
    known = spark.createDataFrame(inventory.digests(spark, str(folder)).collect(), inventory.KNOWN)
    after, changes = inventory.refresh(spark, str(folder), known)
    assert changes.count() == 0 and after.count() == 5
    read = []
    real = inventory.digests
    monkeypatch.setattr(inventory, "digests", lambda spark, paths, glob="*": read.append(paths) or real(spark, paths, glob))
    inventory.refresh(spark, str(folder), known)[0].count()
    assert read == []  # nothing has changed: no content is read
    (folder / "b.txt").write_text("changed")
    (folder / "plain").rename(folder / "moved")
    os.utime(folder / "a.MD", (1, 1))
    (folder / "d.md").unlink()
    (folder / "new [1].md").write_text("new")
    after, changes = inventory.refresh(spark, str(folder), known)
    got = {x.path.rsplit("/", 1)[1]: (x.change, x.was and x.was.rsplit("/", 1)[1]) for x in changes.collect()}
    assert got == {"b.txt": ("changed", None), "moved": ("renamed", "plain"), "plain": ("removed", None), "a.MD": ("touched", None), "d.md": ("removed", None), "new [1].md": ("added", None)}
    assert {p.rsplit("/", 1)[1].replace("\\", "") for p in read[0]} == {"b.txt", "moved", "a.MD", "new [1].md"}
    assert names(after.collect(), "sha256") == {"a.MD": sha(b"one"), "b.txt": sha(b"changed"), "c.md": sha(b"one"), "moved": sha(b"three"), "new [1].md": sha(b"new")}


def test_ledgers(spark, tmp_path):
    top = tmp_path / "ledger"
    top.mkdir()
    for name, text in {"a.jsonl": "{}\n\n{}\n", "b.jsonl": "{}", "c.jsonl": " \n", "extra.jsonl": "{}", "other.txt": "x"}.items():
        (top / name).write_text(text)
    rows = [("a.jsonl", sha(b"{}\n\n{}\n").upper(), 2), ("b.jsonl", sha(b"{ }"), 3), ("c.jsonl", None, 0), ("gone.jsonl", "x", 1), ("b.jsonl", sha(b"{ }"), 3)]
    manifest = spark.createDataFrame(rows, "name string, sha256 string, row_count long")
    got = {(x.name, x.fault): (x.expected, x.found) for x in inventory.ledger_faults(spark, str(top), manifest, base(), "*.jsonl").collect()}
    assert got == {("b.jsonl", "sha256"): (sha(b"{ }"), sha(b"{}")), ("b.jsonl", "row_count"): ("3", "1"), ("b.jsonl", "repeated"): ("1", "2"), ("gone.jsonl", "missing"): ("file", None), ("extra.jsonl", "extra"): (None, "file")}
    with pytest.raises(ValueError, match="extra.jsonl: extra"):
        inventory.verified(spark, str(top), manifest, base(), "*.jsonl")
    inventory.verified(spark, str(top), manifest.where("name = 'a.jsonl'"), base(), "a.jsonl")
