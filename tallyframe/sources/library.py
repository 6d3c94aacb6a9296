"""A library of processed tables and synonyms in a folder of any store that Spark reaches."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import ontology
from .files import read_processed

SYNONYMS = "_synonyms"


def slug(name: str) -> str:
    """A file name: letters, digits, dots, dashes and underscores; ``reference`` if nothing is left."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_") or "reference"


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files(self) -> list[str]:
        """Names of the files directly in the folder, in order."""
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isFile())

    def names(self) -> list[str]:
        """Names of readable processed documents."""
        found = []
        for name in self.files():
            if name.endswith(".json") and not name.startswith("_"):
                try:
                    json.loads(self.read(name))
                except ValueError:
                    continue
                found.append(name[:-5])
        return found

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))  # Spark's readers pass over names that begin with an underscore
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(f"{self.root}/{slug(name)}.json"), False))

    def save(self, name: str, doc: dict) -> str:
        self.write(f"{slug(name)}.json", json.dumps(doc, ensure_ascii=False, indent=2).encode())
        return slug(name)

    def get(self, name: str) -> dict | None:
        file = f"{slug(name)}.json"
        return json.loads(self.read(file)) if file in self.files() else None

    def load(self, name: str) -> DataFrame:
        """Records of a processed document."""
        return read_processed(self.spark, f"{self.root}/{slug(name)}.json")

    def synonyms(self) -> DataFrame | None:
        """The alias table of the library's synonyms, if it has any."""
        name = next((f for f in self.files() if f.startswith(f"{SYNONYMS}.")), None)
        return ontology.aliases(ontology.file_groups(self.spark, name, self.read(name))) if name else None

    def write_synonyms(self, filename: str, data: bytes) -> DataFrame:
        """Replace the synonyms by those of a file, which must be readable."""
        made = ontology.aliases(ontology.file_groups(self.spark, filename, data))
        for f in self.files():
            if f.startswith(f"{SYNONYMS}."):
                self._fs.delete(self._path(f"{self.root}/{f}"), False)
        self.write(f"{SYNONYMS}.{filename.rsplit('.', 1)[-1].lower() if '.' in filename else 'txt'}", data)
        return made
