"""Files on any Hadoop path: listing, folders, copies, and a local cache for tools that need local files."""

from __future__ import annotations

import fcntl
import hashlib
import os
import shutil

from pyspark.sql import SparkSession


class Files:
    """The session's view of file systems; paths without a scheme belong to the default one."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return bool(fs.exists(where))

    def make_dirs(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none of a folder that isn't there."""
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def copy(self, source: str, target: str, overwrite: bool = True) -> None:
        """A file or folder from any file system to any other."""
        (a, from_), (b, to) = self._at(source), self._at(target)
        if b.exists(to):
            if not overwrite:
                raise FileExistsError(target)
            b.delete(to, True)
        if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, from_, b, to, False, self._conf):
            raise OSError(f"{source} was not copied to {target}")

    def local_copy(self, source: str, cache: str, always: bool = False) -> str:
        """A local path with the file's or folder's content, for tools that read local files on the driver.

        Copies are kept by the MD5 of their path; a lock file lets one process copy at a time, and a copy that was cut
        short is made again.  A local source is used in place.  Executors read ``source`` itself.
        """
        if "://" not in source:
            return source
        folder = os.path.join(cache, hashlib.md5(source.encode()).hexdigest())
        target, done = os.path.join(folder, os.path.basename(source.rstrip("/"))), os.path.join(folder, ".whole")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, ".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if always or not os.path.exists(done):
                if os.path.exists(done):
                    os.remove(done)
                if os.path.isdir(target):
                    shutil.rmtree(target)
                self.copy(source, "file://" + os.path.abspath(target))
                open(done, "w").close()
        return target
