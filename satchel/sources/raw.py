"""Raw stores: paths to bytes, on any file system that Spark reaches, or in memory."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "content.bin"
_POLL_S = 0.1


class RawStore:
    """Each path is a folder that holds its payload, so a path can have children and content."""

    def __init__(self, spark: SparkSession, root: str, clean: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if clean:
            self._fs.delete(self._path(self.root), True)
        self._fs.mkdirs(self._path(self.root))

    def _at(self, path: str, *more: str):
        return self._path("/".join([self.root, *filter(None, [path.strip("/"), *more])]))

    def store(self, path: str, content: bytes) -> None:
        """Creates or overwrites."""
        out = self._fs.create(self._at(path, _FILE), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def create(self, path: str, content: bytes, wait_s: float = 0) -> bool:
        """Creates if absent; looks again until the wait is over.  Of several callers one succeeds.

        The payload is written under another name first, so whoever sees the path sees all of it.  It is
        published by a hard link on local file systems and by a rename that never replaces on HDFS; other
        file systems have no such step and are refused.
        """
        end = time.monotonic() + wait_s
        while True:
            if self._publish(self._at(path, _FILE), content):
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(min(_POLL_S, max(end - time.monotonic(), 0)))

    def _publish(self, target, content: bytes) -> bool:
        if self._fs.exists(target):
            return False
        new = self._path(f"{target.getParent()}/.new-{uuid.uuid4().hex}")
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            at, to = new.toUri().getPath(), target.toUri().getPath()
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as f:
                f.write(content)
            try:
                os.link(at, to)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(at)
        if scheme not in ("hdfs", "viewfs"):
            raise NotImplementedError(f"exclusive creation on {scheme}")
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, target, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def fetch(self, path: str) -> bytes | None:
        at = self._at(path, _FILE)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path, _FILE))

    def delete(self, path: str) -> bool:
        """Deletes the path and all below it."""
        return self._fs.delete(self._at(path), True)

    def list_children(self, path: str = "") -> list[str]:
        """Full paths of the direct children, sorted."""
        at = self._at(path)
        if not self._fs.exists(at):
            return []
        prefix = f"{path.strip('/')}/" if path.strip("/") else ""
        return sorted(prefix + s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory())

    def frame(self, path: str = "") -> DataFrame:
        """(path, content) of everything under ``path``, read by the executors."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _FILE).load(self._at(path).toString())
        base = self._path(self.root).toUri().getPath()
        return files.select(F.regexp_extract("path", f".*?{base}/(.*)/{_FILE}$", 1).alias("path"), "content")

    def flush(self) -> None:
        """Writes are done when they return."""

    def close(self) -> None:
        self.flush()


class MemoryStore:
    """The same in the driver's memory, for tests and small control data."""

    def __init__(self, spark: SparkSession):
        self.spark, self._content = spark, {}

    def store(self, path: str, content: bytes) -> None:
        self._content[path.strip("/")] = bytes(content)

    def create(self, path: str, content: bytes, wait_s: float = 0) -> bool:
        end, own = time.monotonic() + wait_s, bytearray(content)
        while self._content.setdefault(path.strip("/"), own) is not own:  # one step, under the interpreter's lock
            if time.monotonic() >= end:
                return False
            time.sleep(_POLL_S / 10)
        return True

    def fetch(self, path: str) -> bytes | None:
        found = self._content.get(path.strip("/"))
        return None if found is None else bytes(found)

    def exists(self, path: str) -> bool:
        return path.strip("/") in self._content

    def delete(self, path: str) -> bool:
        gone = [p for p in self._content if p == path.strip("/") or p.startswith(path.strip("/") + "/")]
        for p in gone:
            del self._content[p]
        return bool(gone)

    def list_children(self, path: str = "") -> list[str]:
        prefix = f"{path.strip('/')}/" if path.strip("/") else ""
        return sorted({prefix + p[len(prefix) :].split("/")[0] for p in self._content if p.startswith(prefix) and p != path})

    def frame(self, path: str = "") -> DataFrame:
        prefix = f"{path.strip('/')}/" if path.strip("/") else ""
        rows = [(p, bytearray(c)) for p, c in self._content.items() if p.startswith(prefix)]
        return self.spark.createDataFrame(rows, "path string, content binary")

    def flush(self) -> None: ...

    def close(self) -> None: ...
