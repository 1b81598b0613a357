"""Bitmap files (binary PBM and PGM) as a data source of foreground pixels, and masks written as such files.

``spark.read.format("bitmap").load(path)`` after ``register(spark)`` gives pixels (image_id, r, c).  A file is read in strips of rows, each
by a task of its own that seeks to it, so an image of any size is read by many tasks.  Ranges of image_id and r are pushed to the
list of strips, those of c to the bytes of a row that are looked at.  The image_id is the last number in a file's name.

In PBM files a set bit is foreground, in PGM files a value above the option ``threshold``
(0).  Files lie in any store that pyarrow.fs opens by address.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Bytes of a strip at most, unless a row has more.
STRIP_BYTES = 4_000_000
PIXELS = "image_id long, r int, c int"
#: Pixels that are passed on together.
BATCH = 200_000


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What the first bytes of a file tell; ``begin`` is where its rows do."""

    kind: str
    width: int
    height: int
    depth: int
    begin: int

    @classmethod
    def read(cls, data: bytes) -> Header:
        fields, at = [], 0
        while len(fields) < (3 if fields[:1] == ["P4"] else 4):
            m = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)").match(data, at)
            if not m:
                raise ValueError("no header of a binary bitmap file")
            fields.append(m[1].decode())
            at = m.end()
            if len(fields) == 1 and fields[0] not in ("P4", "P5"):
                raise ValueError(f"a bitmap file of kind {fields[0][:10]!r}; P4 and P5 are read")
        top = int(fields[3]) if len(fields) == 4 else 1
        return cls(fields[0], int(fields[1]), int(fields[2]), 2 if top > 255 else 1, at + 1)

    @property
    def row_bytes(self) -> int:
        return (self.width + 7) // 8 if self.kind == "P4" else self.width * self.depth


@dataclass
class Strip(D.InputPartition):
    path: str
    image_id: int
    header: Header
    first: int
    last: int


class BitmapReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.threshold, self.rows = options["path"], int(options.get("threshold", "0")), int(options.get("strip_rows", "0"))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", ())[-1:], getattr(f, "value", None)
            step = {D.EqualTo: (0, 0), D.GreaterThan: (1, None), D.GreaterThanOrEqual: (0, None), D.LessThan: (None, -1), D.LessThanOrEqual: (None, 0)}.get(type(f))
            if isinstance(f, D.IsNotNull):
                continue  # no column has nulls
            if step is None or not isinstance(value, int) or name[0] not in ("image_id", "r", "c"):
                yield f
                continue
            if step[0] is not None:
                self.low[name[0]] = max(self.low.get(name[0], -np.inf), value + step[0])
            if step[1] is not None:
                self.high[name[0]] = min(self.high.get(name[0], np.inf), value + step[1])

    def _range(self, name: str, end: int) -> tuple[int, int]:
        """The part of 0 to ``end`` (not included) that is asked for."""
        return int(max(0, self.low.get(name, 0))), int(min(end, self.high.get(name, end) + 1))

    def partitions(self) -> list[Strip]:
        from pyarrow import fs

        store, at = _open(self.path)
        root = self.path[: len(self.path) - len(at)] if "://" in self.path else ""
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.base_name.endswith((".pbm", ".pgm")) or f.base_name.startswith((".", "_")):
                continue
            number = re.findall(r"\d+", f.base_name)
            if not number:
                raise ValueError(f"no number in the name {f.base_name!r}")
            image = int(number[-1])
            if not self.low.get("image_id", image) <= image <= self.high.get("image_id", image):
                continue
            with store.open_input_file(f.path) as file:
                header = Header.read(file.read(1000))
            first, last = self._range("r", header.height)
            rows = self.rows or max(1, STRIP_BYTES // max(header.row_bytes, 1))
            out += [Strip(root + f.path, image, header, r, min(r + rows, last)) for r in range(first, last, rows)]
        return out or [Strip("", 0, Header("P4", 0, 0, 1, 0), 0, 0)]

    def read(self, strip: Strip) -> Iterator[pa.RecordBatch]:
        if not strip.path:
            return
        h = strip.header
        left, right = self._range("c", h.width)
        if left >= right:
            return
        # the bytes of a row that hold these columns
        per = 1 / 8 if h.kind == "P4" else h.depth
        low, high = int(left * per), min(h.row_bytes, int(-(-right * per // 1)))
        store, at = _open(strip.path)
        with store.open_input_file(at) as file:
            for top in range(strip.first, strip.last, step := max(1, BATCH // max(right - left, 1))):
                n = min(step, strip.last - top)
                file.seek(h.begin + top * h.row_bytes)
                data = np.frombuffer(file.read(n * h.row_bytes), np.uint8)
                if len(data) != n * h.row_bytes:
                    raise ValueError(f"{strip.path} ends before row {top + n}")
                data = data.reshape(n, h.row_bytes)[:, low:high]
                if h.kind == "P4":
                    on, start = np.unpackbits(data, axis=1), low * 8
                else:
                    on, start = (np.ascontiguousarray(data).view(">u2") if h.depth == 2 else data) > self.threshold, left
                r, c = np.nonzero(on[:, left - start : right - start])
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), strip.image_id)), pa.array((r + top).astype(np.int32)), pa.array((c + left).astype(np.int32))], ["image_id", "r", "c"])


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, str]]


class BitmapWriter(D.DataSourceWriter):
    """Rows (image_id, r0, bits), sorted, become a PBM file an image; rows of the image that none tells of are empty."""

    def __init__(self, options: dict[str, str]):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])

    def write(self, rows: Iterator) -> Written:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        row_bytes, now, out, done, files = (self.width + 7) // 8, None, None, 0, []

        def close() -> None:
            if out is not None:
                out.write(bytes(row_bytes * (self.height - done)))
                out.close()

        for image, first, bits in rows:
            if image != now:
                close()
                now, done = image, 0
                files.append((f"{at}/.{uuid.uuid4().hex}.pbm", f"{at}/image-{image}.pbm"))
                out = store.open_output_stream(files[-1][0])
                out.write(f"P4\n{self.width} {self.height}\n".encode())
            out.write(bytes(row_bytes * (first - done)))
            out.write(bits)
            done = first + len(bits) // row_bytes
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _open(self.path)
        for m in messages:
            for made, name in m.files if m else ():
                store.move(made, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _open(self.path)
        for m in messages:
            for made, _ in m.files if m else ():
                store.delete_file(made)


class Bitmaps(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "bitmap"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> BitmapReader:
        return BitmapReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BitmapWriter:
        return BitmapWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bitmaps)


def write_bitmaps(runs: DataFrame, path: str, width: int, height: int) -> None:
    """A PBM file ``image-<id>.pbm`` for each image of ``runs`` (image_id, r, c0, c1), all ``width`` by ``height``."""
    row_bytes = (width + 7) // 8
    rows = max(1, STRIP_BYTES // row_bytes)

    def pack(table: pa.Table) -> pa.Table:
        first = int(table["strip"][0].as_py()) * rows
        n = min(rows, height - first)
        edge = np.zeros((n, width + 1), np.int8)
        r = table["r"].to_numpy() - first
        np.add.at(edge, (r, table["c0"].to_numpy()), 1)
        np.add.at(edge, (r, table["c1"].to_numpy() + 1), -1)
        bits = np.packbits(np.cumsum(edge, axis=1, dtype=np.int8)[:, :width] > 0, axis=1)
        return pa.table({"image_id": pa.array([table["image_id"][0].as_py()], pa.int64()), "r0": pa.array([first], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    strips = runs.withColumn("strip", F.floor(F.col("r") / rows)).groupBy("image_id", "strip").applyInArrow(pack, "image_id long, r0 int, bits binary")
    dealt = strips.repartition("image_id").sortWithinPartitions("image_id", "r0")
    register(runs.sparkSession)
    dealt.write.format("bitmap").mode("append").options(width=width, height=height).save(path)
