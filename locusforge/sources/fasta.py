"""FASTA as a Spark data source: `spark.read.format("fasta").load(path)` after register(spark).

A header is a line that begins with `>` once trimmed; what comes before the first is skipped. The id is the header's
first word without leading `>`, the description its other words with single spaces; sequence lines are trimmed and
joined, case kept. gzip is told by the first two bytes, whatever the name, and may have several members.

Plain files are read in byte ranges: a range owns the records whose header begins in it. With `fragmentLength` and
`overlap` the source gives upper-cased fragments instead of whole sequences, cut while reading, so that no row is as
large as a chromosome.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusforge.schemas import CONTIG, FRAGMENT

RANGE_BYTES = 64 << 20


def is_gzip(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def parse_header(line: str) -> tuple[str, str]:
    words = line.strip().lstrip(">").split() if not line.strip().lstrip(">").startswith((" ", "\t")) else ["", *line.strip().lstrip(">").split()]
    return (words[0], " ".join(words[1:])) if words else ("", "")


def records(path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, str, str, Iterator[str]]]:
    """(byte offset, id, description, lines of the sequence) of the records whose header begins in [begin, end)."""
    with gzip.open(path, "rb") if is_gzip(path) else open(path, "rb") as f:
        at = 0
        if begin:
            f.seek(begin - 1)
            at = begin - 1 + len(f.readline())
        held: list[tuple[int, bytes]] = []

        def following() -> Iterator[bytes]:
            nonlocal at
            while raw := f.readline():
                here, at = at, at + len(raw)
                line = raw.strip()
                if line.startswith(b">"):
                    held.append((here, line))
                    return
                if line:
                    yield line

        for _ in following():  # before the first header of the range
            if end is not None and at >= end:  # inside one long record: it is another range's
                return
        while held:
            here, line = held.pop()
            if end is not None and here >= end:
                return
            name, description = parse_header(line.decode("utf-8", "replace"))
            body = following()
            yield here, name, description, (x.decode("utf-8", "replace") for x in body)
            for _ in body:  # what the caller left
                pass


def cut(parts: Iterator[str], length: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, upper-cased fragment): fragments of `length` that begin every length - overlap bases, the last one shorter."""
    step, offset, held = length - overlap, 0, ""
    for part in parts:
        held += part.upper()
        while len(held) > length:
            yield offset, held[:length]
            held, offset = held[step:], offset + step
    if held:
        yield offset, held


class Range(InputPartition):
    def __init__(self, file_no: int, path: str, begin: int, end: int | None):
        self.file_no, self.path, self.begin, self.end = file_no, path, begin, end


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.length, self.overlap = int(options.get("fragmentlength", 0)), int(options.get("overlap", 0))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(f"{path}/*")) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
        out = []
        for i, p in enumerate(files):
            if is_gzip(p):
                out.append(Range(i, p, 0, None))
            else:
                n = os.path.getsize(p)
                out += [Range(i, p, b, b + self.range_bytes) for b in range(0, max(n, 1), self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, name, description, lines in records(partition.path, partition.begin, partition.end):
            if self.length:
                for offset, frag in cut(lines, self.length, self.overlap):
                    yield name, offset, len(frag), frag
            else:
                yield (partition.file_no << 44) + at, name, description, "".join(lines)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FRAGMENT if "fragmentlength" in {k.lower() for k in self.options} else CONTIG

    def reader(self, schema) -> FastaReader:
        return FastaReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("fasta").load(path)


def read_fragments(spark: SparkSession, path: str, length: int = 20_000, overlap: int = 5_000) -> DataFrame:
    register(spark)
    return spark.read.format("fasta").option("fragmentLength", length).option("overlap", overlap).load(path)


def read_fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's text reader, for files that only Spark can open (plain, or compressed by extension). The first record must begin the file."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("contig_idx"), F.regexp_replace("value", "^>+", "").alias("value"))
    head = F.regexp_extract("value", r"^[^\n]*", 0)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"[\t\x0b\x0c\r ]*(\n|\z)[\t\x0b\x0c\r ]*", "")
    return rows.select("contig_idx", F.regexp_extract(head, r"^(\S*)", 1).alias("contig_id"), F.trim(F.regexp_replace(F.regexp_replace(head, r"^\S*\s*", ""), r"\s+", " ")).alias("description"), body.alias("sequence"))
