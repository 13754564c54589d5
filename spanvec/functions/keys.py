"""Packed row keys: 16 bits of file, 16 of row group, 32 of offset, in a long; and the layout of a dataset."""

from __future__ import annotations

import posixpath
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow.parquet as pq
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(file: int, group: int, offset: int) -> int:
    for value, bits, name in ((file, 16, "file"), (group, 16, "row group"), (offset, 32, "offset")):
        if not 0 <= value < 1 << bits:
            raise OverflowError(f"{name} {value} does not fit in {bits} bits")
    key = file << 48 | group << 32 | offset
    return key - (1 << 64) if key >= 1 << 63 else key


def unpack(key: int) -> tuple[int, int, int]:
    key &= (1 << 64) - 1
    return key >> 48, key >> 32 & 0xFFFF, key & 0xFFFFFFFF


def pack_columns(file: Column, group: Column, offset: Column) -> Column:
    """As ``pack``, over columns; a part that does not fit fails the query."""

    def fits(c: Column, bits: int, name: str) -> Column:
        c = c.cast("long")
        return F.when((c < 0) | (c >= 1 << bits), F.raise_error(F.lit(f"{name} does not fit in {bits} bits")).cast("long")).otherwise(c)

    return F.shiftleft(fits(file, 16, "file"), 48).bitwiseOR(F.shiftleft(fits(group, 16, "row group"), 32)).bitwiseOR(fits(offset, 32, "offset"))


def unpack_columns(key: Column) -> list[Column]:
    return [F.shiftrightunsigned(key, 48), F.shiftrightunsigned(key, 32).bitwiseAND(0xFFFF), key.bitwiseAND(0xFFFFFFFF)]


@dataclass(frozen=True)
class DatasetLayout:
    """Files of a dataset, and rows before each file and each of its row groups."""

    files: tuple[str, ...]
    before_file: tuple[int, ...]
    before_group: tuple[tuple[int, ...], ...]
    rows: int = 0

    @classmethod
    def from_files(cls, files: list[str], prefix: str = "") -> DatasetLayout:
        """Reads the footers, on the driver; paths with ``..`` are refused."""
        paths, groups = [], []
        for f in files:
            if ".." in f.split("/"):
                raise ValueError(f"path leaves its folder: {f}")
            paths.append(posixpath.join(prefix, f) if prefix else f)
            footer = pq.read_metadata(paths[-1])
            groups.append([footer.row_group(i).num_rows for i in range(footer.num_row_groups)])
        before = [0, *accumulate(map(sum, groups))][: len(groups)]
        return cls(tuple(paths), tuple(before), tuple(tuple([0, *accumulate(g)][: len(g)]) for g in groups), sum(map(sum, groups)))

    def row_number(self, key: int) -> int:
        """Number of the packed key's row in the dataset."""
        file, group, offset = unpack(key)
        if file >= len(self.files):
            raise IndexError(f"file_idx={file} is not in the dataset of {len(self.files)} files")
        if group >= len(self.before_group[file]):
            raise IndexError(f"row group {group} is not in file {file} of {len(self.before_group[file])} groups")
        return self.before_file[file] + self.before_group[file][group] + offset

    def row_number_column(self, key: Column) -> Column:
        """As ``row_number``, over a column; null for a file or row group that the dataset lacks."""
        file, group, offset = unpack_columns(key)
        before = F.array(*(F.array(*(F.lit(a + b).cast("long") for b in groups)) for a, groups in zip(self.before_file, self.before_group)))
        return F.get(F.get(before, file.cast("int")), group.cast("int")) + offset

    def packed_key(self, row: int) -> int | None:
        """Packed key of a row of the dataset; None beyond its end."""
        if not 0 <= row < self.rows:
            return None
        file = bisect_right(self.before_file, row) - 1
        group = bisect_right(self.before_group[file], row - self.before_file[file]) - 1
        return pack(file, group, row - self.before_file[file] - self.before_group[file][group])
