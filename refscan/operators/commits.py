"""Numbered files in a folder that all can reach: each is made once, whole, by one writer. The last one counts."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: What a whole file ends with: one that was cut off while it was written doesn't count.
END = "\n"


class Conflict(Exception):
    """Another writer was first: what it wrote has to be read before anything is written after it."""


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm
        self.path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
        self.files = self.path().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.files.mkdirs(self.path())

    def numbers(self) -> list[int]:
        """Of all files, ascending."""
        names = (f.getPath().getName() for f in self.files.listStatus(self.path()))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdecimal())

    def text(self, number: int) -> str | None:
        """A file's text, or none if it isn't whole."""
        stream = self.files.open(self.path(f"{number:012}.json"))
        try:
            found = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return found.removesuffix(END) if found.endswith(END) else None

    def last(self) -> tuple[int, str | None]:
        """The number of the last file, whole or not, and the text of the last whole one; 0 and none without any."""
        numbers = self.numbers()
        text = next((t for n in reversed(numbers) if (t := self.text(n)) is not None), None)
        return (numbers[-1] if numbers else 0), text

    def add(self, number: int, text: str) -> None:
        """Makes the file of a number; if there is one already, by whomever, it is a ``Conflict``."""
        try:
            stream = self.files.create(self.path(f"{number:012}.json"), False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception).lower():
                raise Conflict(f"{self.folder}: {number} is written already") from None
            raise
        try:
            stream.write((text + END).encode())
        finally:
            stream.close()

    def drop(self, numbers: list[int]) -> None:
        for n in numbers:
            self.files.delete(self.path(f"{n:012}.json"), False)

    def delete(self, name: str) -> None:
        """Deletes a folder or file beside the numbered ones."""
        self.files.delete(self.path(name), True)
