"""File-tree and text-format sources and sinks.

Readers use Spark's file sources (``wholetext``, ``csv``, ``binaryFile``, ``json``, ``text``) with the
file path from ``_metadata``; schemas are fixed, never inferred.  The tree writers exist to produce the
one-file-per-item layouts; each task writes its own files into a shared folder.

Trees of one file an item (A1, A3) on a shared POSIX mount are listed and read by tasks: Spark's file sources hold
the status of every file on the driver.  They remain the way on other file systems, which Python tasks do not reach.
"""

from __future__ import annotations

import bz2
import contextlib
import csv
import gzip
import hashlib
import io
import os
import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kshot.operators.text import WHITESPACE
from kshot.session import local_path

PATHS = 10_000           # in a batch of listed files
BYTES = 1 << 23          # of contents in a batch (a single longer file is a batch)

#: By the end of a file's name, as Hadoop's codecs go by it; those without a decoder here are left to Spark's source.
DECODE = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".deflate": zlib.decompress, ".lz4": None, ".snappy": None,
          ".zst": None}


# ---------------------------------------------------------------- trees of files
def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """Path, and whether it is a folder, of what lies in ``folder``; names that Spark's file sources take for hidden are left out."""
    with os.scandir(folder) as found:
        for e in found:
            hidden = (e.name.startswith("_") and "=" not in e.name) or e.name.startswith(".") or e.name.endswith("._COPYING_")
            if not hidden and (e.is_dir() or e.is_file()):
                yield e.path, e.is_dir()


def _files_below(path: str) -> Iterator[str]:
    folders = [path]
    while folders:
        for sub, is_folder in _entries(folders.pop()):
            if is_folder:
                folders.append(sub)
            else:
                yield sub


def _frames(rows: Iterator[tuple], columns: list[str]):
    import itertools

    import pandas as pd
    while part := list(itertools.islice(rows, PATHS)):
        yield pd.DataFrame(part, columns=columns)


def _open_folders(batches):
    """Folders give way to what lies in them, files stay."""
    rows = ((f"file:{sub}", is_folder) for b in batches for path, folder in zip(b["path"], b["folder"])
            for sub, is_folder in (_entries(local_path(path)) if folder else [(local_path(path), False)]))
    return _frames(rows, ["path", "folder"])


def _walk_folders(batches):
    rows = ((f"file:{sub}",) for b in batches for path, folder in zip(b["path"], b["folder"])
            for sub in (_files_below(local_path(path)) if folder else [local_path(path)]))
    return _frames(rows, ["path"])


def _read_files(batches):
    import pandas as pd
    paths, contents, size = [], [], 0
    for path in (p for b in batches for p in b["path"]):
        with open(local_path(path), "rb") as fh:
            data = fh.read()
        end = os.path.splitext(path)[1]
        if end in DECODE and data:
            if DECODE[end] is None:
                raise ValueError(f"{path}: {end} is not decoded in tasks; scan_class_tree(..., in_tasks=False) reads it")
            data = DECODE[end](data)
        paths.append(path)
        contents.append(data)
        size += len(data)
        if size >= BYTES or len(paths) >= PATHS:
            yield pd.DataFrame({"path": paths, "content": contents})
            paths, contents, size = [], [], 0
    if paths:
        yield pd.DataFrame({"path": paths, "content": contents})


def _stat_files(batches):
    rows = ((path, s.st_size, s.st_mtime_ns) for b in batches for path in b["path"] for s in [os.stat(local_path(path))])
    return _frames(rows, ["path", "length", "changed"])


def _roots(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """What ``root`` (a path, URI or glob) names: qualified paths, and whether each is a folder."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(root)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return [(s.getPath().toString(), s.isDirectory()) for s in found or ()]


def list_tree(spark: SparkSession, root: str, levels: int = 1) -> DataFrame | None:
    """``path`` of every file below ``root`` on a shared POSIX mount, listed by tasks and dealt out evenly; None if
    ``root`` is elsewhere or not there.

    The folders of ``levels`` levels below ``root`` are dealt out over tasks, deeper ones are walked with the folder that
    they lie in.  Only ``root`` itself passes through the driver; a task holds ``PATHS`` paths at a time."""
    roots = _roots(spark, root)
    if not roots or not all(path.startswith("file:/") for path, _ in roots):
        return None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))       # given, else AQE would merge by the few bytes of paths
    at = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[
        F.struct(F.lit(path).alias("path"), F.lit(folder).alias("folder")) for path, folder in roots])).alias("r")).select("r.*")
    for _ in range(levels):
        at = at.mapInPandas(_open_folders, "path string, folder boolean").repartition(n, "path")
    return at.mapInPandas(_walk_folders, "path string").repartition(n, "path")


def tree_version(spark: SparkSession, root: str) -> str:
    """What ``reuse_stage`` takes as ``version`` of a stage over such a tree: count and hashes of path, size and time of its files."""
    files = list_tree(spark, root)
    if files is None:
        raise ValueError(f"{root}: not there, or not on a POSIX mount")
    each = F.xxhash64("path", "length", "changed")
    seen = files.mapInPandas(_stat_files, "path string, length long, changed long")
    return str(tuple(seen.agg(F.count(F.lit(1)), F.bit_xor(each), F.sum(F.shiftright(each, 8))).first()))


# ---------------------------------------------------------------- A1
def write_class_tree(df: DataFrame, root: str, class_col: str, name_col: str, text_col: str) -> int:
    """Write ``root/<class>/<name>`` files, one per row (the layout A1 reads).  Returns files written."""
    root = local_path(root)

    def run(batches):
        import pandas as pd
        for b in batches:
            n = 0
            for c, name, text in zip(b[class_col], b[name_col], b[text_col]):
                d = os.path.join(root, str(c))
                os.makedirs(d, exist_ok=True)
                with open(os.path.join(d, str(name)), "w", encoding="utf-8", newline="") as fh:
                    fh.write(text)
                n += 1
            yield pd.DataFrame({"n": [n]})
    out = df.select(class_col, name_col, text_col).mapInPandas(run, "n long")
    return out.agg(F.sum("n")).first()[0] or 0


def scan_class_tree(spark: SparkSession, root: str, in_tasks: bool = True) -> DataFrame:
    """A1: every file is one document, its class the parent directory: ``(class, name, text)``.

    On a shared POSIX mount tasks list and read the files (``list_tree``), empty ones too; elsewhere, or if not
    ``in_tasks``, Spark's file source does, which lists every file on the driver and leaves out empty files."""
    files = list_tree(spark, root) if in_tasks else None
    if files is None:
        raw = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))      # file_path is percent-encoded
        df = (spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
              .select(F.col("value").alias("text"), F.url_decode(raw).alias("path")))
    else:
        df = (files.mapInPandas(_read_files, "path string, content binary")
              .select(F.col("content").cast("string").alias("text"), "path"))
    parts = F.split(F.col("path"), "/")
    return df.select(F.element_at(parts, -2).alias("class"), F.element_at(parts, -1).alias("name"), "text")


# ---------------------------------------------------------------- A2
def write_class_csv(df: DataFrame, root: str, class_col: str, text_col: str) -> int:
    """One CSV file per class (``root/<class>``), first column the sentence (RFC 4180 quoting)."""
    root = local_path(root)

    def run(batches):
        import pandas as pd
        files: dict[str, list[str]] = {}
        for b in batches:
            for c, t in zip(b[class_col], b[text_col]):
                files.setdefault(str(c), []).append(t)
        os.makedirs(root, exist_ok=True)
        for c, rows in files.items():
            buf = io.StringIO()
            w = csv.writer(buf, lineterminator="\n")
            for t in rows:
                w.writerow([t])
            with open(os.path.join(root, c), "w", encoding="utf-8", newline="") as fh:
                fh.write(buf.getvalue())
        yield pd.DataFrame({"n": [len(files)]})
    out = df.select(class_col, text_col).repartition(class_col).mapInPandas(run, "n long")
    return out.agg(F.sum("n")).first()[0] or 0


def scan_class_csv(spark: SparkSession, root: str) -> DataFrame:
    """A2: one CSV per class, class = file name (suffix kept): ``(class, sentence)``."""
    df = (spark.read.schema("sentence string").option("multiLine", True).option("escape", '"')
          .option("header", False).csv(root))
    return df.select(F.col("_metadata.file_name").alias("class"), "sentence")


# ---------------------------------------------------------------- A3
def scan_image_catalog(spark: SparkSession, root: str) -> DataFrame:
    """A3: ``root/<split>/<superclass>/<class>/<file>`` -> ``(split, superclass, class, path)``; file contents are
    never read.  On a shared POSIX mount tasks list the files, elsewhere Spark's file source (on the driver)."""
    df = list_tree(spark, root, levels=3)
    if df is None:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split(F.col("path"), "/")
    return df.select(F.element_at(parts, -4).alias("split"), F.element_at(parts, -3).alias("superclass"),
                     F.element_at(parts, -2).alias("class"), "path")


# ---------------------------------------------------------------- A4, A5
def pair_lines(pairs: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """The legacy pair line ``a,b,label`` (one text value per pair; texts are written as they are)."""
    return pairs.select(F.concat_ws(",", F.col(a), F.col(b), F.col(label).cast("string")).alias("value"))


def read_pair_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4: each line holds ``a,b,label``; a row per line: ``(line, sent_a, sent_b, label, ok)``.  Lines that do
    not split into exactly 3 parts with a 0/1 label are not ``ok`` (their fields are null).  Surrounding
    double quotes are removed."""
    lines = spark.read.text(path)
    v = F.col("value")
    unq = F.when(v.startswith('"') & v.endswith('"') & (F.length(v) >= 2),
                 F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), '""', '"')).otherwise(v)
    parts = F.split(unq, ",", -1)
    ok = (F.size(parts) == 3) & F.element_at(parts, 3).isin("0", "1")
    field = lambda i: F.when(F.col("ok"), F.element_at("parts", i))
    return lines.select(v.alias("line"), parts.alias("parts"), F.coalesce(ok, F.lit(False)).alias("ok")).select(
        "line", field(1).alias("sent_a"), field(2).alias("sent_b"), field(3).cast("int").alias("label"), "ok")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A5: typed pair rows as parquet (no delimiter clash)."""
    pairs.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- A6-A9
def save_vocab(vocab: DataFrame, path: str) -> None:
    """``(token, id)`` rows as JSON lines."""
    vocab.select("token", F.col("id").cast("bigint").alias("id")).write.mode("overwrite").json(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id bigint").json(path)


def write_word_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """Text word-vector format: header ``count dim`` then ``token v1 ... vd``.

    Line breaks inside a token are written as ``\\n`` and ``\\r``, a backslash as two.
    """
    token = F.col("token")
    for plain, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        token = F.replace(token, F.lit(plain), F.lit(coded))
    body = vectors.select(F.concat_ws(" ", token, F.array_join(
        F.transform("vector", lambda x: x.cast("string")), " ")).alias("value"))
    header = vectors.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.lit(str(dim))).alias("value"))
    header.unionByName(body).write.mode("overwrite").text(path)


def load_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(token, vector array<float>)``; the header line (2 fields) is dropped."""
    parts = F.split(F.col("value"), " ", -1)
    df = spark.read.text(path).where(F.size(parts) == dim + 1)
    token = F.element_at(parts, 1)
    for coded, plain in (("\\\\", "\0"), ("\\n", "\n"), ("\\r", "\r"), ("\0", "\\")):
        token = F.replace(token, F.lit(coded), F.lit(plain))
    return df.select(token.alias("token"),
                     F.transform(F.slice(parts, 2, dim), lambda x: x.cast("float")).alias("vector"))


def write_id_vectors(vectors: DataFrame, path: str) -> None:
    """``{"id": [floats]}`` per line (one map per line so the file splits)."""
    vectors.select(F.to_json(F.create_map(F.col("id").cast("string"), F.col("vector"))).alias("value")) \
        .write.mode("overwrite").text(path)


def load_id_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(id int, vector array<float>)``."""
    m = F.from_json(F.col("value"), "map<string,array<float>>")
    return spark.read.text(path).select(F.explode(m).alias("k", "vector")).select(
        F.col("k").cast("int").alias("id"), "vector")


def load_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One stop word per line, stripped."""
    return spark.read.text(path).select(F.btrim(F.col("value"), F.lit(WHITESPACE)).alias("token"))


# ---------------------------------------------------------------- A10, A11
def write_predictions(pred: DataFrame, path: str) -> None:
    """A10: one prediction per row as CSV with a header."""
    pred.write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a finished stage (``_SUCCESS`` present) or compute, write and read it back."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)     # also over what a failed write left
    return spark.read.parquet(path)


def plan_text(df: DataFrame) -> str:
    """The optimized plan without what differs from run to run: column ids and lambda variables are numbered anew."""
    spark, width = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before, out = spark.conf.get(width), io.StringIO()
    spark.conf.set(width, "100000")
    try:
        with contextlib.redirect_stdout(out):
            df.explain("extended")
    finally:
        spark.conf.set(width, before)
    plan = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    seen: dict[str, int] = {}
    return re.sub(r"#\d+L?|\b[xyz]_\d+\b", lambda m: f"#{seen.setdefault(m[0], len(seen))}", plan).strip()


def stage_key(df: DataFrame, version: str = "") -> str:
    """What a stage depends on: its plan, its schema, and path, size and time of every input file.

    The body of a Python function is not part of a plan: ``version`` stands for it, and for a tree whose files are listed
    by tasks (``tree_version``)."""
    plan = plan_text(df)
    if _walk_folders.__name__ in plan and not version:
        raise ValueError("the files of a tree are not part of the plan: give tree_version(spark, root) in version")
    files = sorted(df.inputFiles())
    state = ""
    if files:
        seen = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        each = F.xxhash64("path", "length", "modificationTime")           # contents are not read
        state = str(tuple(seen.agg(F.count(F.lit(1)), F.bit_xor(each), F.sum(F.shiftright(each, 8))).first()))
    return hashlib.sha256("\n".join((version, df.schema.json(), plan, state)).encode()).hexdigest()[:32]


def reuse_stage(df: DataFrame, root: str, name: str, version: str = "") -> DataFrame:
    """A11 for stages that may go stale: ``df`` as last written under the same ``stage_key``, else written now.

    A changed plan or input file has another key, so it never meets the old stage; a write that did not end has no
    ``_SUCCESS`` and is made again.  A file that is replaced without a change of size and time is not noticed."""
    return materialize_once(df.sparkSession, f"{root.rstrip('/')}/{name}/{stage_key(df, version)}", lambda: df)
