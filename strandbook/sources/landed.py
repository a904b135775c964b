"""Blocks of other chains, landed as Parquet files, as a stream whose offsets are block numbers per chain.

    spark.dataSource.register(LandedBlocks)
    spark.readStream.format("landed_blocks").option("path", uri).option("batch", 100).load()

Files are ``<path>/<chain>/<first>-<last>.parquet`` and hold all blocks of that range with the columns of BLOCKS; a file
must appear whole (written aside, then renamed). An offset is the last block of each chain; it depends on the landed names
alone, so that a query that restarts goes on after the offsets of its checkpoint and neither skips nor repeats a block. A
missing range holds its chain there, and no other. Each task reads at most ``batch`` blocks of one chain. Files may be
removed once newer ones of their chain have been read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LOG = "struct<topics:array<binary>,data:binary>"
BLOCKS = (
    "chain_id bigint, number bigint, hash string, seconds bigint, "
    "transactions array<struct<type:int,from:binary,to:binary,hash:string,source_hash:string>>, "
    f"receipts array<struct<status:int,tx_hash:string,logs:array<{LOG}>>>"
)
COLUMNS = ["chain_id", "number", "hash", "seconds", "transactions", "receipts"]
NAME = re.compile(r"([0-9]+)-([0-9]+)\.parquet")


class Blocks(InputPartition):
    """Blocks first to last of a chain."""

    def __init__(self, chain: str, first: int, last: int):
        super().__init__((chain, first, last))
        self.chain, self.first, self.last = chain, first, last


class LandedBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_blocks"

    def schema(self) -> str:
        return BLOCKS

    def streamReader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"], int(self.options.get("batch", "100")))


class LandedReader(DataSourceStreamReader):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def _ranges(self, chain: str | None = None) -> dict[str, list[tuple[int, int, str]]]:
        """(first, last, path) of the landed files, by chain and in order."""
        files, root = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[tuple[int, int, str]]] = {}
        for info in files.get_file_info(fs.FileSelector(f"{root}/{chain}" if chain else root, allow_not_found=True, recursive=True)):
            if info.is_file and (match := NAME.fullmatch(info.base_name)):
                found.setdefault(info.path.rsplit("/", 2)[-2], []).append((int(match[1]), int(match[2]), info.path))
        return {c: sorted(r) for c, r in found.items()}

    def initialOffset(self) -> dict:
        return {chain: ranges[0][0] - 1 for chain, ranges in self._ranges().items()}

    def latestOffset(self) -> dict:
        """The last block of each chain up to which no range is missing."""
        ends = {}
        for chain, ranges in self._ranges().items():
            end = ranges[0][0] - 1
            for first, last, _ in ranges:
                if first > end + 1:
                    break
                end = max(end, last)
            ends[chain] = end
        return ends

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        landed = self._ranges() if end.keys() - start.keys() else {}
        pieces = []
        for chain, last in sorted(end.items()):
            first = start[chain] + 1 if chain in start else landed[chain][0][0]
            pieces += [Blocks(chain, at, min(last, at + self.batch - 1)) for at in range(first, last + 1, self.batch)]
        return pieces

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        # Ranges that overlap may hold a block twice: each file gives what is after the ones before it.
        at = partition.first
        for first, last, path in self._ranges(partition.chain).get(partition.chain, []):
            if last < at or first > partition.last:
                continue
            wanted = (ds.field("number") >= at) & (ds.field("number") <= partition.last)
            yield from (b for b in ds.dataset(path, filesystem=files, format="parquet").scanner(columns=COLUMNS, filter=wanted).to_batches() if b.num_rows)
            at = last + 1
        if at <= partition.last:
            raise FileNotFoundError(f"blocks {at} to {partition.last} of chain {partition.chain} have gone")
