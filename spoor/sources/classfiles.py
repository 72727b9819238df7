"""SRC-7: declarations of compiled classes, read from class files and from the archives that hold them.

Files are read by Spark's binary source, one row each, and parsed in Arrow batches in the tasks that read them; an
archive's entries are parsed one after another.  The result has the shape of parsed units
(``readers.UNITS``), so ``readers.declarations`` makes the three tables of it.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spoor.sources.readers import UNITS

#: Bytes that follow the tag of an entry of the constant pool, but for text (fixed values).
ENTRY = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
#: Kinds of types by the flag of their access word, the first that is set (fixed values).
KINDS = ((0x8000, "module"), (0x2000, "annotation"), (0x0200, "interface"), (0x4000, "enum"))
SCHEMA = f"{UNITS}, error string"


class Bytes:
    """Big-endian numbers one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return struct.unpack(">H", self.take(2))[0]

    def u4(self) -> int:
        return struct.unpack(">I", self.take(4))[0]


def _text(raw: bytes) -> str:
    """The format's own UTF-8: zero in two bytes, and characters beyond the first plane as two surrogates."""
    found = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return found.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse(data: bytes) -> dict:
    """sig, kind, methods and fields of one class file."""
    b = Bytes(data)
    if b.u4() != 0xCAFEBABE:
        raise ValueError("no class file")
    b.take(4)
    pool: list = [None]
    n = b.u2()
    while len(pool) < n:
        tag = b.u1()
        if tag == 1:
            pool.append(_text(b.take(b.u2())))
        elif tag in ENTRY:
            raw = b.take(ENTRY[tag])
            pool.append(struct.unpack(">H", raw)[0] if tag == 7 else None)
            if tag in (5, 6):  # these take two places
                pool.append(None)
        else:
            raise ValueError(f"no entry of a constant pool has the tag {tag}")

    def text(i: int) -> str:
        if not 0 < i < len(pool) or not isinstance(pool[i], str):
            raise ValueError("a name is not where it should be")
        return pool[i]

    def attributes() -> None:
        for _ in range(b.u2()):
            b.take(2)
            b.take(b.u4())

    def members() -> list[tuple[str, str]]:
        out = []
        for _ in range(b.u2()):
            b.take(2)
            out.append((text(b.u2()), text(b.u2())))
            attributes()
        return out

    access, this = b.u2(), b.u2()
    if not 0 < this < len(pool) or not isinstance(pool[this], int):
        raise ValueError("a class is not where it should be")
    b.take(2)
    b.take(2 * b.u2())
    fields, methods = members(), members()
    return {
        "sig": f"L{text(pool[this])};", "kind": next((k for flag, k in KINDS if access & flag), "class"),
        "methods": [{"sig": name + of, "name": name} for name, of in methods], "fields": [{"name": name, "type": of} for name, of in fields],
    }


def _classes(path: str, data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(unit, bytes, error) of a file, or of each class in an archive."""
    if not data.startswith(b"PK"):
        yield path, data, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in archive.namelist():
                if name.endswith(".class"):
                    yield f"{path}!{name}", archive.read(name), None
    except (zipfile.BadZipFile, EOFError, OSError) as e:
        yield path, None, str(e)


def units(files: DataFrame) -> DataFrame:
    """(unit, types, error) of files (path, content): a class file is a unit of one type; one that cannot be parsed has none, and says why."""
    target = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for unit, found, error in _classes(path, data.as_py() or b""):
                    types = []
                    if error is None:
                        try:
                            types = [parse(found)]
                        except ValueError as e:
                            error = str(e)
                    rows.append({"unit": unit, "types": types, "error": error})
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The units of all class files and archives below a folder, companions (``._*``) left out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{class,jar}").load(root)
    return units(listed.filter(~F.element_at(F.split("path", "/"), -1).startswith("._")))
