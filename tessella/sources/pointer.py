"""A small value that is replaced at once: numbered files, of which the newest whole one holds."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from ..errors import StoreConflict


class Pointer:
    """Values are JSON. A new one is a new file, made only if its number is free, so a crash leaves the old value and of two writers one is told."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "CURRENT"):
        self.spark, self.folder, self.name = spark, folder, name

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(self.folder)
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(rf"{self.name}-(\d+)", n))), reverse=True)

    def _value(self, number: int):
        """What a file says, or None if its writer didn't finish."""
        fs, path = self._fs(f"{self.folder}/{self.name}-{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def read(self) -> tuple[int, object | None]:
        """The newest whole value's number and the value; 0 and None where there is none."""
        for number in self._numbers():
            if (value := self._value(number)) is not None:
                return number, value
        return 0, None

    def swap(self, value, after: int) -> int:
        """Put a value in place of the one numbered ``after``; StoreConflict if another writer was first."""
        number = max([after, *self._numbers()]) + 1
        if self.read()[0] != after:
            raise StoreConflict(f"{self.folder} has changed meanwhile: read it again")
        fs, path = self._fs(f"{self.folder}/{self.name}-{number:012d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise StoreConflict(f"{self.folder} is being changed by another writer") from e
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return number

    def drop_before(self, keep: int) -> tuple[list, list]:
        """Remove all but the last ``keep`` values; returns the removed and the kept ones."""
        numbers = self._numbers()
        kept, old = [self._value(n) for n in numbers[:keep]], []
        for n in numbers[keep:]:
            old.append(self._value(n))
            fs, path = self._fs(f"{self.folder}/{self.name}-{n:012d}")
            fs.delete(path, False)
        return [v for v in old if v is not None], [v for v in kept if v is not None]

    def remove(self, folder: str) -> None:
        fs, path = self._fs(f"{self.folder}/{folder}")
        fs.delete(path, True)

    def listed(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        fs, path = self._fs(f"{self.folder}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
