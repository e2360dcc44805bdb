"""Where a run tells of its files: a protocol for sinks, and the sink that writes one JSON report."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from bytelode.sources.scratch import discard, settle

from . import report


class Reporter(ABC):
    """A sink of carved files. initialize and finalize run once, on the driver; add takes the files of a batch, as a plan.

    A batch that is tried again comes with the same number, and must count once.
    """

    def initialize(self, sources: DataFrame) -> None:
        """sources has image_id and bytes_read of all images (of a stream: of those known so far)."""

    @abstractmethod
    def add(self, files: DataFrame, batch: int = 0) -> None: ...

    def finalize(self) -> None:
        """All files have been added."""


class PartitionReporter(Reporter):
    """A sink that is fed where the files are: `tell` runs in a task, on the record batches of one partition.

    What it yields, short texts about what it did, is gathered in `told` on the driver, by batch.
    """

    def __init__(self) -> None:
        self.told: dict[int, list[str]] = {}

    @abstractmethod
    def tell(self, rows: Iterator[pa.RecordBatch]) -> Iterator[str]: ...

    def add(self, files: DataFrame, batch: int = 0) -> None:
        tell = self.tell

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(tell(batches)), pa.string())], ["said"])

        self.told[batch] = [r.said for r in files.mapInArrow(run, "said string").collect()]


class JsonReporter(Reporter):
    """One JSON document over all sources and batches, written anew by each finalize."""

    def __init__(self, target: str) -> None:
        self.target = target
        self.sources: DataFrame | None = None
        self.batches: dict[int, DataFrame] = {}

    def initialize(self, sources: DataFrame) -> None:
        discard(*([self.sources] if self.sources is not None else []))
        self.sources = settle(sources.select("image_id", "bytes_read"), "sources")

    def add(self, files: DataFrame, batch: int = 0) -> None:
        if batch in self.batches:
            discard(self.batches.pop(batch))
        self.batches[batch] = settle(files.select("image_id", "seq", "filename", "filesize", "file_type", "byte_runs", "jpeg_scan"), "told")

    def finalize(self) -> None:
        """Files of all batches in the order of image_id and seq."""
        if self.sources is None or not self.batches:
            raise ValueError("nothing was told")
        told = None
        for files in self.batches.values():
            told = files if told is None else told.unionAll(files)
        report.write_merged(self.sources, told, self.target)


def tell(reporter: Reporter, sources: DataFrame, files: DataFrame) -> None:
    """A whole run told to a sink."""
    reporter.initialize(sources)
    reporter.add(files)
    reporter.finalize()
