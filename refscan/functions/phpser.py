"""Leaves of PHP-serialized values.

Lengths count bytes, so the text is read as UTF-8 bytes by a small reader with a stack of open containers.
Keys are skipped, so are properties that aren't public; anything malformed makes the whole value unreadable.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<ok:boolean,container:boolean,leaves:array<struct<kind:string,value:string>>>"
Leaf = dict[str, str]


class Unreadable(Exception):
    pass


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def upto(self, mark: bytes) -> bytes:
        end = self.data.find(mark, self.at)
        if end < 0:
            raise Unreadable
        out, self.at = self.data[self.at : end], end + len(mark)
        return out

    def expect(self, mark: bytes) -> None:
        if not self.data.startswith(mark, self.at):
            raise Unreadable
        self.at += len(mark)

    def number(self, mark: bytes) -> int:
        raw = self.upto(mark)
        if not raw.removeprefix(b"-").removeprefix(b"+").isdigit():
            raise Unreadable
        return int(raw)

    def counted(self) -> bytes:
        """A quoted string after its length."""
        n = self.number(b":")
        self.expect(b'"')
        out = self.data[self.at : self.at + n]
        if n < 0 or len(out) < n:
            raise Unreadable
        self.at += n
        self.expect(b'"')
        return out

    def leaf(self, kind: bytes) -> Leaf | None:
        if kind == b"s":
            value = self.counted()
            self.expect(b";")
            return {"kind": "string", "value": value.decode("utf-8", "replace")}
        if kind == b"i":
            return {"kind": "int", "value": str(self.number(b";"))}
        if kind == b"b":
            if self.number(b";") not in (0, 1):
                raise Unreadable
        else:
            try:
                float(self.upto(b";").decode("ascii", "replace").replace("INF", "inf").replace("NAN", "nan"))
            except ValueError:
                raise Unreadable from None
        return None

    def read(self) -> tuple[bool, list[Leaf]]:
        """Whether the value is an array or object, and its leaves."""
        leaves: list[Leaf] = []
        # For each open container: entries left, whether a key comes next, whether entries count, whether it is an object,
        # and the leaves of each key: of equal keys the last one's count, at the first one's place.
        open_: list[list] = []
        container = None
        while True:
            if open_ and not open_[-1][0]:
                self.expect(b"}")
                inner = [x for found in open_.pop()[4].values() for x in found]
                if not open_:
                    leaves = inner
                    break
                open_[-1][4][open_[-1][5]] = inner
                continue
            kind = self.data[self.at : self.at + 1]
            visible = all(o[2] for o in open_)
            if open_ and open_[-1][1]:  # a key: only decides whether the value can be seen
                if kind not in (b"i", b"s"):
                    raise Unreadable
                self.at += 1
                self.expect(b":")
                key = self.leaf(kind)
                open_[-1][1], open_[-1][2], open_[-1][5] = False, not (open_[-1][3] and key["value"].startswith("\0")), key["value"]
                open_[-1][4].setdefault(key["value"], []).clear()
                continue
            if kind == b"N":
                self.expect(b"N;")
            elif kind in (b"a", b"O"):
                self.at += 1
                self.expect(b":")
                if kind == b"O":
                    self.counted()
                    self.expect(b":")
                n = self.number(b":")
                self.expect(b"{")
                if n < 0:
                    raise Unreadable
                container = True if container is None else container
                if open_:
                    self.passed(open_)
                open_.append([n, True, visible, kind == b"O", {}, None])
                continue
            elif kind in (b"s", b"i", b"b", b"d"):
                self.at += 1
                self.expect(b":")
                leaf = self.leaf(kind)
                if leaf and visible and open_:
                    open_[-1][4][open_[-1][5]] = [leaf]
                elif leaf and visible:
                    leaves.append(leaf)
            else:
                raise Unreadable
            container = bool(container)
            if not open_:
                break
            self.passed(open_)
        if self.at != len(self.data):
            raise Unreadable
        return container, leaves

    @staticmethod
    def passed(open_: list[list]) -> None:
        open_[-1][0] -= 1
        open_[-1][1] = True


def leaves_of(text: str) -> dict:
    """ok: it can be read; container: it is an array or object. Text that isn't serialized is one string leaf; unreadable text has none."""
    data = text.strip(" \t\n\r\0\x0b").encode()
    looks = data == b"N;" or (len(data) > 3 and data[1:2] == b":" and data[:1] in b"saObid" and data[-1:] in b";}")
    if not looks:
        return {"ok": True, "container": False, "leaves": [{"kind": "string", "value": text}]}
    try:
        container, leaves = Reader(data).read()
    except Unreadable:
        return {"ok": False, "container": False, "leaves": []}
    return {"ok": True, "container": container, "leaves": leaves}


def parsed(batch: pa.Array) -> pa.Array:
    kind = pa.struct([("ok", pa.bool_()), ("container", pa.bool_()), ("leaves", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))])
    return pa.array([leaves_of(x or "") for x in batch.to_pylist()], kind)


def php_leaves(text: Column) -> Column:
    """``leaves_of`` a text column, in Arrow batches, as TYPE."""
    return F.arrow_udf(parsed, TYPE)(text)


FILE = "struct<original_image:string,sizes:map<string,struct<file:string>>,filesize:long>"
#: What a container or a scalar is read as.
Value = dict | str | int | float | bool | None


def value_of(text: str) -> Value:
    """A serialized value as Python values; arrays and objects are dicts by key, in their order. Unreadable: raises ``Unreadable``."""
    reader = Reader(text.strip(" \t\n\r\0\x0b").encode())
    open_: list[tuple[dict, int, str | int | None]] = []  # container, entries left, key of the next value
    while True:
        kind = reader.data[reader.at : reader.at + 1]
        if kind == b"N":
            reader.expect(b"N;")
            value: Value = None
        elif kind in (b"a", b"O"):
            reader.at += 1
            reader.expect(b":")
            if kind == b"O":
                reader.counted()
                reader.expect(b":")
            n = reader.number(b":")
            reader.expect(b"{")
            value = {}
            if n > 0:
                open_.append((value, n, key_of(reader)))
                continue
            reader.expect(b"}")
        elif kind in (b"s", b"i", b"b", b"d"):
            value = scalar_of(reader, kind)
        else:
            raise Unreadable
        while open_:
            container, left, key = open_.pop()
            container[key] = value
            if left > 1:
                open_.append((container, left - 1, key_of(reader)))
                break
            reader.expect(b"}")
            value = container
        if not open_:
            break
    if reader.at != len(reader.data):
        raise Unreadable
    return value


def scalar_of(reader: Reader, kind: bytes) -> Value:
    reader.at += 1
    reader.expect(b":")
    if kind == b"s":
        text = reader.counted().decode("utf-8", "replace")
        reader.expect(b";")
        return text
    if kind == b"d":
        try:
            return float(reader.upto(b";").decode("ascii", "replace").replace("INF", "inf").replace("NAN", "nan"))
        except ValueError:
            raise Unreadable from None
    number = reader.number(b";")
    return bool(number) if kind == b"b" else number


def key_of(reader: Reader) -> str | int:
    kind = reader.data[reader.at : reader.at + 1]
    if kind not in (b"i", b"s"):
        raise Unreadable
    return scalar_of(reader, kind)


def file_of(text: str | None) -> dict | None:
    """original_image, sizes and filesize of an attachment's metadata; none if it can't be read or is no array."""
    try:
        meta = value_of(text or "")
    except Unreadable:
        return None
    if not isinstance(meta, dict):
        return None
    said = lambda x: x if isinstance(x, str) and x not in ("", "0") else None
    sizes = meta.get("sizes")
    files = {str(k): v.get("file") for k, v in sizes.items() if isinstance(v, dict)} if isinstance(sizes, dict) else {}
    size = meta.get("filesize")
    size = int(size) if isinstance(size, (int, float)) and size == size and abs(size) < 1 << 63 else int(size) if isinstance(size, str) and size.isascii() and size.isdigit() and len(size) < 19 else None
    return {"original_image": said(meta.get("original_image")), "sizes": [(k, {"file": said(f)}) for k, f in files.items() if said(f)], "filesize": size}


def filed(batch: pa.Array) -> pa.Array:
    kind = pa.struct([("original_image", pa.string()), ("sizes", pa.map_(pa.string(), pa.struct([("file", pa.string())]))), ("filesize", pa.int64())])
    return pa.array([file_of(x) for x in batch.to_pylist()], kind)


def php_file(text: Column) -> Column:
    """``file_of`` a text column, in Arrow batches, as FILE."""
    return F.arrow_udf(filed, FILE)(text)
