"""Parquet tables that change together: data first, then one manifest that names all of it.

`_commits/<number>.json` is the manifest of a state: for every table the folders it consists of. A reader takes
the newest manifest and sees one state, however many tables a step writes and wherever it breaks off. A
writer puts its rows into fresh folders, which nobody sees yet, and publishes them by creating the next number. A
number can be created once: if another writer was first, the step looks at the new state, decides again and tries the
number after it. Of the file system this asks for a rename that does not overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = 50


class CommitConflict(RuntimeError):
    """Other writers were first every time."""


@dataclass(frozen=True)
class Part:
    """One written folder of a table; parts with a key can be replaced by it."""

    folder: str
    key: str | None = None


@dataclass(frozen=True)
class Change:
    """Take parts of a table away and add one. Without `removed` folders, those of the added part's key go."""

    table: str
    added: Part
    removed: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    number: int
    tables: dict[str, tuple[Part, ...]]

    def parts(self, table: str, key: str | None = None) -> tuple[Part, ...]:
        return tuple(p for p in self.tables.get(table, ()) if key is None or p.key == key)

    def after(self, changes: list[Change]) -> State:
        tables = dict(self.tables)
        for c in changes:
            kept = [p for p in tables.get(c.table, ()) if p.folder not in c.removed and (c.added.key is None or p.key != c.added.key)]
            tables[c.table] = (*kept, c.added)
        return State(self.number + 1, tables)


class SnapshotStore:
    """Tables below one root folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def folders(self) -> list[str]:
        """Names of the folders below the root."""
        root = self._path(self.root)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root) if f.isDirectory()) if self._fs.exists(root) else []

    # ------------------------------------------------------------ states

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def state(self, number: int | None = None) -> State:
        """The newest state, or an earlier one."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return State(0, {})
            number = numbers[-1]
        stream = self._fs.open(self._path(self._manifest(number)))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(number, {t: tuple(Part(**p) for p in parts) for t, parts in held.items()})

    def _manifest(self, number: int) -> str:
        return f"{self.root}/_commits/{number:012d}.json"

    def publish(self, state: State) -> bool:
        """Create the manifest of the state; false if its number is taken."""
        text = json.dumps({t: [{"folder": p.folder, "key": p.key} for p in parts] for t, parts in state.tables.items()})
        draft, final = self._path(f"{self.root}/_commits/_{uuid.uuid4().hex}"), self._path(self._manifest(state.number))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        plainly = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, plainly)
            return True
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

    def commit(self, prepare: Callable[[State], list[Change]]) -> State:
        """Publish what `prepare` makes of the newest state; it is asked again whenever another writer was first."""
        for _ in range(ATTEMPTS):
            state = self.state()
            changes = prepare(state)
            if not changes:
                return state
            following = state.after(changes)
            if self.publish(following):
                return following
        raise CommitConflict(f"no commit to {self.root} in {ATTEMPTS} attempts")

    # ------------------------------------------------------------ data

    def write_part(self, table: str, rows: DataFrame, key: str | None = None) -> Part:
        """Write rows that no reader sees before a commit names the part."""
        part = Part(f"{table}/{uuid.uuid4().hex}", key)
        rows.write.mode("errorifexists").parquet(f"{self.root}/{part.folder}")
        return part

    def read(self, table: str, schema: str, state: State | None = None, key: str | None = None) -> DataFrame:
        """The rows of a table with a fixed schema; columns added later are null in older parts."""
        parts = (state or self.state()).parts(table, key)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.folder}" for p in parts])

    def expire(self, keep: int = 20) -> int:
        """Remove the manifests before the newest `keep` and the folders that only they name; returns how many folders.
        Folders of steps that are not published yet are named nowhere and stay."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        named = {p.folder for n in kept for parts in self.state(n).tables.values() for p in parts}
        gone = {p.folder for n in old for parts in self.state(n).tables.values() for p in parts} - named
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        for n in old:
            self._fs.delete(self._path(self._manifest(n)), False)
        return len(gone)
