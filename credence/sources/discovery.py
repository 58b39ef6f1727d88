"""Which files of a project are scanned: filters on (path, ...) frames, whatever store the files are in."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.identity import glob_pattern
from credence.sources.stores import Ignore

#: Directories that are never looked into, and build output directly below the root.
SKIP_DIRS = ("__pycache__", ".venv", "venv", ".git", ".mypy_cache", ".uv-cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", "node_modules")
ROOT_BUILD = (".eggs", "build", "dist")

#: Both in one pattern: the filter runs wherever the files are read, often by few tasks, and a path may itself be computed.
_SKIPPED = f"(?:^|/)(?:{'|'.join(map(re.escape, SKIP_DIRS))})/|^(?:{'|'.join(map(re.escape, ROOT_BUILD))}|[^/]*\\.egg-info)/"


def _below(root: str):
    root = root.strip("/")
    return F.lit(True) if root in ("", ".") else (F.col("path") == root) | F.col("path").startswith(f"{root}/")


def in_project(files: DataFrame, roots: tuple[str, ...] = (".",), excluded: tuple[str, ...] = ()) -> DataFrame:
    """The files below ``roots``, without those in skipped directories or build output and those that an
    ``excluded`` glob matches.  ``path`` is relative."""
    wanted = F.lit(False)
    for root in roots:
        wanted = wanted | _below(root)
    kept = files.filter(wanted & ~F.col("path").rlike(_SKIPPED))
    for glob in excluded:
        kept = kept.filter(~F.col("path").rlike(glob_pattern(glob)))
    return kept


def discovered(files: DataFrame, roots: tuple[str, ...] = (".",), excluded: tuple[str, ...] = (), suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """The files of the project with one of ``suffixes``, each path once."""
    named = F.lit(False)
    for s in suffixes:
        named = named | F.col("path").endswith(s)
    return in_project(files.filter(named), roots, excluded).dropDuplicates(["path"])


def missing_roots(files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """(root) of the configured roots below which there is nothing; one pass for all of them."""
    counts = files.agg(*[F.count_if(_below(r)).alias(f"c{i}") for i, r in enumerate(roots)])
    rows = F.array(*[F.struct(F.lit(r).alias("root"), F.col(f"c{i}").alias("n")) for i, r in enumerate(roots)])
    return counts.select(F.explode(rows).alias("r")).filter("r.n = 0").select("r.root")


def without_ignored(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """``files`` (path, ...) without those that ignore files (path, text) tell to leave out.  The patterns of
    an ignore file hold below its directory; those of a deeper one come later, and the last match wins.
    A file meets the ignore files of its own directories only, by an equi-join."""
    place = lambda path: F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")
    given = ignores.select(place(F.col("path")).alias("dir"), "text")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "/")))
    met = files.select("path").distinct().select("path", F.explode(above).alias("dir")).join(given, "dir")
    rules = met.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.length("dir").alias("depth"), "dir", "text"))).alias("rules"))

    def run(batches: Iterator) -> Iterator:
        import functools

        import pyarrow as pa

        parsed = functools.lru_cache(1024)(lambda text: Ignore(text.split("\n")))
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gone = False
                for rule in r["rules"]:
                    own = r["path"][len(rule["dir"]) + 1 :] if rule["dir"] else r["path"]
                    for pattern, ignored in parsed(rule["text"]).rules:
                        if pattern.match(own):
                            gone = ignored
                if gone:
                    out.append(r["path"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

    return files.join(rules.mapInArrow(run, "path string"), "path", "left_anti")
