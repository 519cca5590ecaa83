"""Trees of one file an item are listed and read by tasks: no status of a file goes to the driver."""

import bz2
import gzip
import os
import zlib

import pytest

from kshot.session import local_path, shared_dir
from kshot.sources import files as A

SEEN = {("a b%", "x y+.txt"): b"one", ("c", "z.gz"): b"zipped", ("c", "z.bz2"): b"bz", ("c", "z.deflate"): b"defl",
        ("c", "bad"): b"\xff\xfeq", ("f", "g"): b"deep", ("k=1", "ü.txt"): "ö\r\n".encode(), ("c", "_x=1"): b"named"}
EMPTY = {("c", "empty"): b"", ("c", "empty.gz"): b""}


def tree(spark):
    root = shared_dir(spark, "t_tree")
    put = {"a b%/x y+.txt": b"one", "c/z.gz": gzip.compress(b"zipped"), "c/z.bz2": bz2.compress(b"bz"),
           "c/z.deflate": zlib.compress(b"defl"), "c/bad": b"\xff\xfeq", "d/e/f/g": b"deep", "k=1/ü.txt": "ö\r\n".encode(),
           "c/_x=1": b"named", "c/empty": b"", "c/empty.gz": b"", "c/.hidden": b"h", "_d/f": b"h", "c/_SUCCESS": b"h",
           "c/_metadata": b"h", "c/q._COPYING_": b"h"}
    for name, data in put.items():
        path = os.path.join(local_path(root), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(data)
    return root


def rows(df):
    got = [((r["class"], r["name"]), bytes(r["raw"])) for r in df.selectExpr("class", "name", "cast(text as binary) raw").collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tree_and_catalog_list_no_file_on_the_driver(spark):
    root = tree(spark)
    for df in (A.scan_class_tree(spark, root), A.scan_image_catalog(spark, root)):
        assert not df.inputFiles() and "FileScan" not in physical(df)


def test_tree_has_every_file_with_its_plain_name(spark):
    root = tree(spark)
    assert rows(A.scan_class_tree(spark, root)) == SEEN | EMPTY
    assert rows(A.scan_class_tree(spark, root, in_tasks=False)) == SEEN
    assert rows(A.scan_class_tree(spark, root + "/[ac]*")) == {k: v for k, v in (SEEN | EMPTY).items() if k[0] in ("a b%", "c")}
    assert rows(A.scan_class_tree(spark, root + "/d/e/f/g")) == {("f", "g"): b"deep"}


def test_more_files_than_a_batch_holds(spark, monkeypatch):
    monkeypatch.setattr(A, "PATHS", 7)
    root = shared_dir(spark, "t_many")
    items = spark.range(500).selectExpr("concat('c', id % 3) AS c", "concat(id, '.txt') AS n", "repeat(id, 3) AS t")
    assert A.write_class_tree(items, root, "c", "n", "t") == 500
    want = {(r.c, r.n): r.t.encode() for r in items.collect()}
    assert rows(A.scan_class_tree(spark, root)) == want
    assert len(list(A._files_below(local_path(root)))) == 500
    assert [len(b) for b in A._frames(iter([(i,) for i in range(15)]), ["i"])] == [7, 7, 1]


def test_catalog_walks_trees_of_any_depth(spark):
    root = shared_dir(spark, "t_deep")
    paths = {f"s{i % 2}/g{i % 3}/c{i}/{d}i.img" for i in range(6) for d in ("", "more/", "more/yet/")}
    for p in paths:
        os.makedirs(os.path.dirname(os.path.join(local_path(root), p)), exist_ok=True)
        open(os.path.join(local_path(root), p), "w").close()
    got = [r.path for r in A.scan_image_catalog(spark, root).select("path").collect()]
    assert sorted(got) == sorted(f"file:{local_path(root)}/{p}" for p in paths)


def test_other_file_systems_are_left_to_the_file_source(spark):
    root = tree(spark)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./in", f"file://{local_path(root)}")
    assert A.list_tree(spark, "viewfs://trees/in") is None
    assert rows(A.scan_class_tree(spark, "viewfs://trees/in")) == SEEN


def test_missing_tree_and_unknown_codec_are_told(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        A.scan_class_tree(spark, shared_dir(spark, "t_none"))
    root = tree(spark)
    with open(local_path(root) + "/c/x.snappy", "wb") as fh:
        fh.write(b"x")
    with pytest.raises(Exception, match="in_tasks=False"):
        A.scan_class_tree(spark, root).collect()


def test_stage_over_a_tree_follows_its_files(spark):
    root, stages = tree(spark), shared_dir(spark, "t_stages")
    with pytest.raises(ValueError, match="tree_version"):
        A.stage_key(A.scan_class_tree(spark, root))

    def stage():
        return A.reuse_stage(A.scan_class_tree(spark, root), stages, "s", A.tree_version(spark, root))
    first = stage()
    assert first.count() == len(SEEN | EMPTY) and sorted(stage().inputFiles()) == sorted(first.inputFiles())
    with open(local_path(root) + "/c/bad", "wb") as fh:
        fh.write(b"longer than before")
    assert rows(stage())["c", "bad"] == b"longer than before"
    assert A.tree_version(spark, root) != A.tree_version(spark, tree(spark))
