"""Versions of tables in a folder: parts are written once and never changed, a manifest names the parts that count.

Committing a version is one rename of the manifest over the one before, which readers see whole or not at all. What a
crashed writer left is named by no manifest, so nobody reads it; ``sweep`` removes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

NAME = "_manifest.json"


@dataclass
class Version:
    """``parts``: folders (below the manifest's own) by name; ``before``: those of the version before; ``about``: what
    the writer notes for the next one."""

    number: int = -1
    parts: dict[str, str] = field(default_factory=dict)
    before: dict[str, str] = field(default_factory=dict)
    about: dict[str, str] = field(default_factory=dict)


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._fs.Path(self.path).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return self._files().exists(self._at(name))

    def read(self) -> Version:
        """The last version; number -1 and no parts if there is none."""
        if not self.exists(NAME):
            return Version()
        stream = self._files().open(self._at(NAME))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def fresh(self, name: str) -> str:
        """A folder that no version names yet, for a new part called ``name``."""
        return f"{name}/{uuid.uuid4().hex}"

    def folders(self, name: str) -> list[str]:
        """Names of the folders in a part."""
        return sorted(s.getPath().getName() for s in self._files().listStatus(self._at(name)) if s.isDirectory())

    def commit(self, parts: dict[str, str], number: int | None = None, about: dict[str, str] | None = None) -> Version:
        """Make ``parts`` (with all that earlier versions named and these do not) the last version."""
        old = self.read()
        new = Version(old.number + 1 if number is None else number, {**old.parts, **parts}, old.parts, {**old.about, **(about or {})})
        draft = f"{NAME}.{uuid.uuid4().hex}"
        stream = self._files().create(self._at(draft))
        try:
            stream.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            stream.close()
        context = self._fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        option = self._fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(option, 1)
        over[0] = option.OVERWRITE
        context.rename(self._at(draft), self._at(NAME), over)
        return new

    def sweep(self, names: list[str]) -> int:
        """Remove the folders below these names that neither the last version nor the one before names (a reader may
        still be at the one before); of folders that hold a named one, the others inside go. Gives how many went."""
        version = self.read()
        kept = {*version.parts.values(), *version.before.values()}
        return sum(self._sweep(name, kept) for name in names if self.exists(name))

    def _sweep(self, name: str, kept: set[str]) -> int:
        files, gone = self._files(), 0
        for status in files.listStatus(self._at(name)):
            leaf = f"{name}/{status.getPath().getName()}"
            if not status.isDirectory() or leaf in kept:
                continue
            if any(k.startswith(leaf + "/") for k in kept):
                gone += self._sweep(leaf, kept)
            else:
                files.delete(self._at(leaf), True)
                gone += 1
        return gone
