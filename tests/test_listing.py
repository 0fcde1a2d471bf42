"""Listing in tasks: levels, hidden names, empty files, globs, agreement with Spark's own listing."""

import os

import pytest

from strata.sources import listing as L
from strata.sources.inventory import _by_source, inventory


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    deep = root
    for i in range(6):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / f"f{i}.txt").write_text("x" * i)
    for name in ("a.txt", "b.csv", "c d+é.txt", "_hidden.txt", ".dot.txt", "empty.txt"):
        (root / name).write_text("" if name == "empty.txt" else name)
    for folder in ("_temporary", ".git", "k=1", "_k=2"):
        (root / folder).mkdir()
        (root / folder / "z.txt").write_text("z")
    return root


def test_one_level_of_a_deep_tree_lists_one_level(spark, tree):
    rows = L.walk(spark, str(tree), max_levels=1).collect()
    assert {r.level for r in rows} == {1} and {os.path.dirname(r.path) for r in rows} == {str(tree)}
    assert {os.path.basename(r.path) for r in rows if r.is_dir} == {"d0", "k=1", "_k=2"}
    # a folder that cannot be listed without end: one level never goes in
    loop = tree / "d0" / "loop"
    if not loop.exists():
        os.symlink(tree / "d0", loop)
    try:
        assert inventory(spark, str(tree), recursive=False).count() == 4
    finally:
        os.unlink(loop)


def test_levels_match_a_walk(spark, tree):
    want = {}
    for d, folders, names in os.walk(tree):
        folders[:] = [x for x in folders if not L.hidden(x)]
        want.update({os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for n in names if not L.hidden(n)})
    got = inventory(spark, f"file://{tree}/").collect()
    assert {r.path: r.length for r in got} == want and len(got) == len(want)
    assert all(abs(r.mtime.timestamp() - os.path.getmtime(r.path)) < 86_400 for r in got)


def test_agrees_with_spark(spark, tree):
    for recursive in (True, False):
        for glob in (None, "*.txt", "{a,b}.*", "f[0-2].txt", "c d+?.txt"):
            mine = {(r.path, r.length, r.mtime) for r in inventory(spark, [str(tree)], recursive, glob).collect() if r.length}
            theirs = {(r.path, r.length) for r in _by_source(spark, [str(tree)], recursive, glob, None).select("path", "length").collect()}
            assert {x[:2] for x in mine} == theirs


def test_nested_bases_and_files_count_once(spark, tree):
    got = [r.path for r in inventory(spark, [str(tree), str(tree / "d0"), str(tree / "a.txt")]).collect()]
    assert len(got) == len(set(got)) and str(tree / "a.txt") in got


def test_missing_base_and_empty_folder(spark, tmp_path):
    assert inventory(spark, str(tmp_path)).collect() == []
    with pytest.raises(FileNotFoundError):
        inventory(spark, str(tmp_path / "nope"))


def test_modified_before(spark, tmp_path):
    (tmp_path / "old").write_text("x")
    (tmp_path / "new").write_text("x")
    os.utime(tmp_path / "old", (0, 1_000_000))
    got = inventory(spark, str(tmp_path), modified_before="2020-01-01 00:00:00").collect()
    assert [os.path.basename(r.path) for r in got] == ["old"] and str(got[0].mtime) == "1970-01-12 13:46:40"


def test_the_driver_plan_holds_no_file_list(spark, tree):
    plan = inventory(spark, str(tree))._jdf.queryExecution().optimizedPlan().toString()
    assert "f5.txt" not in plan


def test_schemes():
    assert L.supported("/a") and L.supported("s3a://b/c") and not L.supported("viewfs://x/y") and not L.supported("relative/x")
    assert L.plain("file:///a/b/") == "/a/b" == L.plain("file:/a/b") and L.plain("/") == "/"
    assert L.glob_regex("a{b,c}[!d]?.x") == r"^a(?:b|c)[^d].\.x$"
