"""Single files in the shared file system: named writes, state files that survive corruption, versions."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or, where that is unset and all runs
    on one machine (as in tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp(prefix='quillspark-')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder of any file system that Spark reaches, for small files with names of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def write(self, name: str, text: str | bytes) -> None:
        """Write to a name beside it, then rename: readers see the old file or the new one."""
        at, part = self._at(name), self._at(f".{name.rsplit('/', 1)[-1]}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode() if isinstance(text, str) else text))
        out.close()
        self._fs.mkdirs(at.getParent())
        self._fs.delete(at, False)
        if not self._fs.rename(part, at):
            raise OSError(f"{name} can't be replaced")

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self._fs.exists(self._at(old)) and self._fs.rename(self._at(old), self._at(new))

    def names(self) -> list[str]:
        at = self._path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def remove(self) -> None:
        self._fs.delete(self._path(self.path), True)

    # -- state ---------------------------------------------------------------------------

    def load_state(self, name: str, fresh: Callable[[], dict]) -> dict:
        """The state of a run; a corrupt file is kept under ``name.bad`` and the run begins afresh."""
        text = self.read(name)
        if text is None:
            return fresh()
        try:
            state = json.loads(text)
            if not isinstance(state, dict):
                raise ValueError("no object")
            return state
        except ValueError:
            self.rename(name, f"{name}.bad")
            return fresh()

    def save_state(self, name: str, state: dict) -> None:
        self.write(name, json.dumps(state, ensure_ascii=False, sort_keys=True))

    def backed_up(self, name: str, text: str, stamp: str) -> None:
        """Replace a file; what was there stays under the stamp."""
        self.rename(name, f"{name}.{stamp}")
        self.write(name, text)

    # -- commits and locks ------------------------------------------------------------------

    def commit(self, changes: dict[str, str | None], parent: str | None) -> str | None:
        """Many files at once or none: a version folder holds them all, and one small file, replaced at the end, names the
        version that readers see.  Without success (another version than ``parent`` is the last) nothing changes.  None deletes a file."""
        if self.head() != parent:
            return None
        tree = json.loads(self.read(f"{parent}/.tree") or "{}") if parent else {}
        version = f"v-{uuid.uuid4().hex}"
        for name, text in changes.items():
            if text is None:
                tree.pop(name, None)
            else:
                self.write(f"{version}/{name}", text)
                tree[name] = f"{version}/{name}"
        self.write(f"{version}/.tree", json.dumps(tree, sort_keys=True))
        if self.head() != parent:
            return None
        self.write("HEAD", version)
        return version

    def head(self) -> str | None:
        return self.read("HEAD")

    def committed(self, version: str) -> dict[str, str | None]:
        return {name: self.read(at) for name, at in json.loads(self.read(f"{version}/.tree") or "{}").items()}

    def lock(self, name: str, owner: str, now: float, alive: Callable[[str], bool], stale: float = 3600.0) -> bool:
        """Take a lock that one owner at a time holds; one whose owner is gone, or that is too old, is taken over."""
        held = self.load_state(name, dict)
        if held and held["owner"] != owner and alive(held["owner"]) and now - held["since"] < stale:
            return False
        if held:
            self.write(name, json.dumps({"owner": owner, "since": now}))
            return True
        return self._create(name, json.dumps({"owner": owner, "since": now}))

    def _create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; False if another was first."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # the file system's own "it exists already"
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def renamed(self, moves: dict[str, str]) -> dict[str, str]:
        """Rename many files at once, swaps too: first all to names of their own, then to their targets.  The outcome of each."""
        here = set(self.names())
        staged = {old: f".move-{k}" for k, old in enumerate(sorted(moves)) if old in here}
        for old, part in staged.items():
            self.rename(old, part)
        out = {old: "missing" for old in moves if old not in here}
        for old, part in staged.items():
            done = moves[old] not in self.names() and self.rename(part, moves[old])
            out[old] = "moved" if done else "taken"
            if not done:
                self.rename(part, old)
        return out
