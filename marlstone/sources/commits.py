"""Numbered records of what is committed, and files of a shared folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """A folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._paths(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears whole or not at all: it is written under another name and renamed."""
        temporary = self._at(f"_tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        if not self._fs.rename(temporary, self._at(name)):
            self._fs.delete(temporary, False)
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class CommitLog:
    """Records by number, written once each. One writer at a time; readers see the last whole record."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("commits") if n.endswith(".json"))

    def has(self, number: int) -> bool:
        return self.files.exists(f"commits/{number:012d}.json")

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"commits/{number:012d}.json"))

    def last(self, below: int | None = None) -> tuple[int, dict]:
        """The newest record (under ``below``) and its number; -1 and nothing if there is none."""
        known = [n for n in self.numbers() if below is None or n < below]
        return (known[-1], self.read(known[-1])) if known else (-1, {})

    def commit(self, number: int, record: dict) -> None:
        if self.has(number):
            raise FileExistsError(f"commit {number}")
        self.files.write(f"commits/{number:012d}.json", json.dumps(record))
