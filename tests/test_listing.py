"""Listing of folders: cycles, dead and looping links, closed folders, two ways to one folder; the registry of traces."""

import os

import pyarrow as pa
import pytest

from roadspan.sources import listing


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    for at in ("a/deep/deeper", "b", "C", ".hidden", "half"):
        (root / at).mkdir(parents=True)
    for at in ("a/adma.csv", "a/annotation.xml", "b/adma.csv", "b/annotation.xml", "half/adma.csv", "a/deep/adma.csv", "a/deep/annotation.xml", "a/deep/deeper/x.bin"):
        (root / at).write_text("x")
    (root / "a/deep/up").symlink_to(root)  # a cycle
    (root / "C/short").symlink_to(root / "a/deep/deeper")  # a shorter way than the real one
    (root / "C/gone").symlink_to(root / "nowhere")
    (root / "C/loop").symlink_to(root / "C/loop")
    return root


def _plain(root):
    """(kind, path) of everything, level by level."""
    front, seen, out = [str(root)], {os.path.realpath(root)}, []
    while front:
        below = []
        for at in front:
            out.append(("folder", at))
            for e in os.scandir(at):
                try:
                    (below if e.is_dir() else out).append(e.path if e.is_dir() else ("file", e.path))
                except OSError:
                    out.append(("unreadable", e.path))
        front = []
        for at in sorted(below):
            real = os.path.realpath(at)
            if real in seen:
                out.append(("again", at))
            else:
                seen.add(real)
                front.append(at)
    return sorted(out)


def test_walk(spark, tree):
    found = listing.walk(spark, f"{tree}/").cache()
    assert sorted((r.kind, r.path) for r in found.where("kind <> 'link'").collect()) == _plain(tree)
    again = {r.path for r in found.where("kind = 'again'").collect()}
    assert again == {f"{tree}/a/deep/up", f"{tree}/a/deep/deeper"}  # the way through the link is shorter
    row = listing.walk_counts(found).first()
    assert (row.dirs_visited, row.dirs_unreadable, row.links_followed, row.again_skipped) == (8, 1, 2, 2)
    assert row.unreadable_examples == [f"{tree}/C/loop (Too many levels of symbolic links)"]


def test_closed_folder(spark, tree):
    if os.geteuid() == 0:
        pytest.skip("root opens every folder")
    (tree / "half").chmod(0)
    try:
        row = listing.walk_counts(listing.walk(spark, str(tree))).first()
        assert (row.dirs_unreadable, row.unreadable_examples[1]) == (2, f"{tree}/half (Permission denied)")
        assert listing.subfolders(spark, str(tree / "half")).count() == 0
    finally:
        (tree / "half").chmod(0o755)


def test_folder_that_does_not_open(tree, monkeypatch):
    """The same in one process, where the system's answer can be given."""
    scan = os.scandir

    def refuse(at):
        if at.endswith("half"):
            raise PermissionError(13, "Permission denied", at)
        return scan(at)

    monkeypatch.setattr(listing.os, "scandir", refuse)
    given = pa.RecordBatch.from_pylist([{"path": f"{tree}/{n}", "real": None} for n in ("half", "b")])
    rows = [r for b in listing._contents([given]) for r in b.to_pylist()]
    assert {(r["kind"], r["path"], r["reason"]) for r in rows} == {("unreadable", f"{tree}/half", "Permission denied"), ("folder", f"{tree}/b", None), ("file", f"{tree}/b/adma.csv", None), ("file", f"{tree}/b/annotation.xml", None)}


def test_no_folder(spark, tree):
    for name in ("nowhere", "a/adma.csv"):
        with pytest.raises(NotADirectoryError):
            listing.walk(spark, str(tree / name))
    assert listing.walk(spark, str(tree / "a/deep/deeper")).count() == 2


def test_subfolders(spark, tree):
    assert [r.name for r in listing.subfolders(spark, str(tree)).collect()] == ["a", "b", "C", "half"]


def test_registry(spark, tree):
    schema = "trace_id string, ego_path string, annotation_path string, ord int"
    external = spark.createDataFrame([("b", "/e/late", "/n/late", 3), ("b", "/e/b", "/n/b", 1), ("far", "/e/far", "/n/far", 2)], schema)
    entries = listing.walk(spark, str(tree))
    got = {r.trace_id: (r.ego_path, r.annotation_path) for r in listing.registered(entries, str(tree), external).collect()}
    assert got == {"a": (f"{tree}/a/adma.csv", f"{tree}/a/annotation.xml"), "b": ("/e/b", "/n/b"), "far": ("/e/far", "/n/far")}
    assert {r.trace_id for r in listing.registered(entries, str(tree), external.limit(0)).collect()} == {"a", "b"}
    assert {r.trace_id for r in listing.registered(entries.limit(0), str(tree), external).collect()} == {"b", "far"}
