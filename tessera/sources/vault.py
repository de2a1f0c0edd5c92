"""Markdown vaults as a table: one row for each note file.

`vault` is a Python data source for folders that every executor sees; it lists all *.md files, also those whose name
starts with a dot or an underscore. read_files does the same through Spark's binary file reader, for stores that only
Spark reads, and so leaves hidden names out.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.staging import gapless

SCHEMA = "root_label string, root_path string, relative_path string, note_seq long, raw_text string"
FILES_PER_PARTITION = 256


def parse_root(spec: str, base: str | None = None) -> tuple[str, str]:
    """(label, path) of `label=path`; a relative path starts at `base`."""
    label, equals, path = spec.partition("=")
    if not equals or not label.strip():
        raise ValueError(f"a source root is label=path, not {spec!r}")
    found = Path(path.strip())
    return label.strip(), str(found if found.is_absolute() or base is None else Path(base) / found)


def check_roots(roots: list[tuple[str, str]]) -> None:
    """Every root must be there, and no two may share a label, for ids are made of labels."""
    labels = [label for label, _ in roots]
    if len(set(labels)) < len(labels):
        raise ValueError("labels of source roots must differ")
    for _, path in roots:
        if not Path(path).is_dir():
            raise FileNotFoundError(path)


class _Files(InputPartition):
    def __init__(self, label: str, root: str, paths: list[str], first: int) -> None:
        self.label, self.root, self.paths, self.first = label, root, paths, first


class _Reader(DataSourceReader):
    def __init__(self, roots: list[tuple[str, str]]) -> None:
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        out, seq = [], 0
        for label, root in self.roots:
            paths = sorted(p for p in Path(root).rglob("*.md") if p.is_file())
            names = [p.relative_to(root).as_posix() for p in paths]
            for at in range(0, len(names), FILES_PER_PARTITION):
                out.append(_Files(label, root, names[at : at + FILES_PER_PARTITION], seq + at))
            seq += len(names)
        return out or [_Files("", "", [], 0)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for i, name in enumerate(partition.paths):
            text = (Path(partition.root) / name).read_text(encoding="utf-8")
            yield partition.label, partition.root, name, partition.first + i, text


class VaultSource(DataSource):
    """Options: root_0, root_1, ... as label=path, in order."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        found = sorted((int(k.split("_")[1]), v) for k, v in self.options.items() if k.startswith("root_"))
        return _Reader([parse_root(v) for _, v in found])


def read_vault(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    check_roots(roots)
    spark.dataSource.register(VaultSource)
    reader = spark.read.format("vault")
    for i, (label, path) in enumerate(roots):
        reader = reader.option(f"root_{i}", f"{label}={path}")
    return reader.load()


def read_files(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    """As read_vault, through Spark's own file reader: any file system, no hidden names.

    Only names are ordered and numbered, by ranges; contents are read afterwards, in the tasks that use them.
    """
    every = None
    for i, (label, path) in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
        inside = F.regexp_replace("path", rf"^.*?\Q{path.rstrip('/').split('://')[-1]}\E/", "")
        text = F.regexp_replace(F.decode("content", "utf-8"), "\r\n?", "\n")
        one = files.select(F.lit(i).alias("_root"), F.lit(label).alias("root_label"), F.lit(path).alias("root_path"), inside.alias("relative_path"), text.alias("raw_text"))
        every = one if every is None else every.unionByName(one)
    places = gapless(every.select("_root", "relative_path"), ["_root", "relative_path"], "note_seq")
    numbered = every.join(places, ["_root", "relative_path"])
    return numbered.select("root_label", "root_path", "relative_path", "note_seq", "raw_text")
