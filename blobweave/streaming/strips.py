"""Features of images that arrive row by row, in any order and in any number of batches.

The state of an image is a set of blocks of rows that have arrived next to each other.  A block knows its
first and last row's runs with their regions, and sums of those regions that touch them; regions that do
not are finished, given out and forgotten.  Blocks that become neighbours are joined.  So the state
grows with the rows' ends, not with what lies between.  An image whose ``height`` is known is closed when its
last row has come; any other when the watermark passes its last row's time: then what is open counts as finished.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.contract import joined
from ..operators.regions import touching

OUT = "image_id long, region_id long, area long, row double, col double, r1 long, c1 long, r2 long, c2 long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns of a block's open regions: label, area, sum of rows, twice that of columns, box.
LABEL, AREA, ROWS, COLUMNS, TOP, LEFT, BOTTOM, RIGHT = range(8)


def combined(parts: np.ndarray) -> np.ndarray:
    """One row a label."""
    if not len(parts):
        return parts
    parts = parts[np.argsort(parts[:, LABEL], kind="stable")]
    first = np.flatnonzero(np.append(True, np.diff(parts[:, LABEL]) != 0))
    add = np.add.reduceat(parts[:, [AREA, ROWS, COLUMNS]], first)
    low, high = np.minimum.reduceat(parts[:, [TOP, LEFT]], first), np.maximum.reduceat(parts[:, [BOTTOM, RIGHT]], first)
    return np.column_stack([parts[first, LABEL], add, low, high])


class Block:
    """Rows ``first`` to ``last`` of an image: its open regions, and (first column, last column, label) of the runs of these two rows."""

    def __init__(self, first: int, last: int, parts: np.ndarray, top: np.ndarray, bottom: np.ndarray):
        self.first, self.last, self.parts, self.top, self.bottom = first, last, parts, top, bottom

    @classmethod
    def of(cls, first: int, last: int, r: np.ndarray, c0: np.ndarray, c1: np.ndarray, width: int) -> Block:
        """From the runs, sorted by (r, c0), of rows that have all arrived."""
        label = (r * width + c0)[joined(len(r), *touching(r, c0, c1, 1))]
        n = c1 - c0 + 1
        runs = np.column_stack([c0, c1, label])
        return cls(first, last, combined(np.column_stack([label, n, r * n, (c0 + c1) * n, r, c0, r, c1])), runs[r == first], runs[r == last])

    def under(self, other: Block) -> Block:
        """Joined with ``other``, which ends in the row before."""
        a, b = touching(np.repeat([0, 1], [len(other.bottom), len(self.top)]), *(np.concatenate([other.bottom[:, k], self.top[:, k]]) for k in (0, 1)), 1)
        both = np.concatenate([other.bottom[:, 2], self.top[:, 2]])
        parts = np.concatenate([other.parts, self.parts])
        ids = np.unique(np.concatenate([parts[:, LABEL], both]))
        top = ids[joined(len(ids), np.searchsorted(ids, both[a]), np.searchsorted(ids, both[b]))]

        def named(x: np.ndarray, k: int) -> np.ndarray:
            out = x.copy()
            out[:, k] = top[np.searchsorted(ids, x[:, k])]
            return out

        return Block(other.first, self.last, combined(named(parts, LABEL)), named(other.top, 2), named(self.bottom, 2))

    def finished(self, height: int | None) -> np.ndarray:
        """Takes out the regions that no further row can touch."""
        if self.first == 0:
            self.top = self.top[:0]
        if height is not None and self.last >= height - 1:
            self.bottom = self.bottom[:0]
        done = ~np.isin(self.parts[:, LABEL], np.concatenate([self.top[:, 2], self.bottom[:, 2]]))
        out, self.parts = self.parts[done], self.parts[~done]
        return out

    def pack(self) -> bytes:
        out = io.BytesIO()
        for x in (self.parts, self.top, self.bottom):
            np.save(out, x)
        return out.getvalue()

    @classmethod
    def unpack(cls, first: int, last: int, data: bytes) -> Block:
        read = io.BytesIO(data)
        return cls(first, last, *(np.load(read) for _ in range(3)))


def figures(image: int, parts: np.ndarray) -> pd.DataFrame:
    area = parts[:, AREA].astype(float)
    columns = {"image_id": np.full(len(parts), image), "region_id": parts[:, LABEL], "area": parts[:, AREA], "row": parts[:, ROWS] / area, "col": parts[:, COLUMNS] / 2 / area}
    return pd.DataFrame(columns | {n: parts[:, k] for n, k in (("r1", TOP), ("c1", LEFT), ("r2", BOTTOM), ("c2", RIGHT))})


class Strips(StatefulProcessor):
    def __init__(self, width: int, height: int | None):
        self.width, self.height = width, height

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "first long", "last long, data binary")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            at = max(at, old)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).drop_duplicates("r").sort_values("r")
        known = {k[0]: Block.unpack(k[0], v[0], bytes(v[1])) for k, v in self.blocks.iterator()} if self.blocks.exists() else {}
        for b in known.values():  # rows that come again
            got = got[(got.r < b.first) | (got.r > b.last)]
        if not len(got):
            return
        r = got.r.to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(r) != 1) + 1
        for i, j in zip([0, *cuts], [*cuts, len(r)], strict=True):
            each = [np.asarray(runs, np.int64).reshape(-1, 2) for runs in got.runs.iloc[i:j]]
            flat = np.concatenate(each)
            known[int(r[i])] = Block.of(int(r[i]), int(r[j - 1]), np.repeat(r[i:j], [len(x) for x in each]), flat[:, 0], flat[:, 1], self.width)
        blocks: list[Block] = []
        for first in sorted(known):
            b = known[first]
            blocks.append(b.under(blocks.pop()) if blocks and blocks[-1].last + 1 == first else b)
        yield figures(key[0], np.concatenate([b.finished(self.height) for b in blocks]))
        self.blocks.clear()
        if self.height is not None and len(blocks) == 1 and blocks[0].first == 0 and blocks[0].last >= self.height - 1:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            return
        for b in blocks:
            self.blocks.updateValue((b.first,), (b.last, b.pack()))
        self._timer(int(got.ts.max().timestamp() * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [Block.unpack(k[0], v[0], bytes(v[1])).parts for k, v in self.blocks.iterator()] if self.blocks.exists() else []
        self.blocks.clear()
        if parts:
            yield figures(key[0], np.concatenate(parts))

    def close(self) -> None:
        pass


def strip_features(rows: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """A stream of region features (OUT) from a stream of image rows (image_id, r, runs: array of (c0, c1) in order, ts) with a watermark on ts.

    A row without foreground comes with no runs.  Rows that come again are passed over.  Needs the RocksDB
    state store (ROCKS in ``spark.sql.streaming.stateStore.providerClass``).
    """
    ends = F.flatten(F.transform("runs", lambda x: F.array(x["c0"], x["c1"])))
    return rows.select("image_id", "r", ends.alias("runs"), "ts").groupBy("image_id").transformWithStateInPandas(Strips(width, height), OUT, "Append", "EventTime")
