"""Manifest trees: ``<root>/<model>/transfer_info.json``, one file of that exact name a folder (SRC-7, SNK-2).

Spark's own writers name files themselves, so the writer is a Python data source.
Tasks put their files below a folder of the write; only the commit moves
them to their places, so a failed or repeated task leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

#: Fixed value: the name of a manifest.
FILE_NAME = "transfer_info.json"


def _open(uri: str):
    """File system and path of a folder of the cluster's shared storage."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@dataclass
class Written(WriterCommitMessage):
    """Staged files of one task: name of the file there, folder that it is for."""

    files: list[tuple[str, str]]


class ManifestWriter(DataSourceWriter):
    """Rows with a ``model`` and the manifest's fields; ``path`` is the tree's root."""

    def __init__(self, root: str):
        self.root, self.staging = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = _open(self.root)
        system.create_dir(f"{root}/{self.staging}", recursive=True)
        files = []
        for row in rows:
            body = row.asDict(recursive=True)
            model, name = body.pop("model"), f"{uuid.uuid4().hex}.json"
            with system.open_output_stream(f"{root}/{self.staging}/{name}") as out:
                out.write(json.dumps(body).encode())
            files.append((name, model))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.root)
        for name, model in (f for m in messages if m for f in m.files):
            system.create_dir(f"{root}/{model}", recursive=True)
            system.move(f"{root}/{self.staging}/{name}", f"{root}/{model}/{FILE_NAME}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.root)
        system.create_dir(f"{root}/{self.staging}", recursive=True)
        system.delete_dir(f"{root}/{self.staging}")


class ManifestTree(DataSource):
    """Spark data source ``transfer_manifests``; its trees are read as JSON files."""

    @classmethod
    def name(cls) -> str:
        return "transfer_manifests"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ManifestWriter(self.options["path"])


def write_manifest_tree(manifest: DataFrame, root: str) -> None:
    """SNK-2: ``<root>/<model>/transfer_info.json`` for every row."""
    spark: SparkSession = manifest.sparkSession
    spark.dataSource.register(ManifestTree)
    manifest.write.format("transfer_manifests").mode("append").save(root)
