"""A source of polled replies, as a table and as a stream.

A service's replies lie in a folder per ticker, ``<path>/ticker=<name>/...``, in files whose names rise with time; every line
of a file is a JSON record or an array of them.  The path is a URI of any file system that Arrow opens by URI (file, s3, gs,
hdfs, abfs), so tasks on all machines can read it.

Every ticker is a partition of its own.  As a table, filters on ``ticker`` leave out whole partitions before anything is
read (``use_pushdown`` allows that).  As a stream, the offset is the last file name seen of each ticker: a batch takes the
files after it, ``filesPerTrigger`` of each ticker at most, and a query that starts again from its checkpoint goes on there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

FORMAT, SCHEMA = "polled_replies", "ticker string, file string, reply string"


@dataclass
class Stretch(InputPartition):
    """Files of one ticker after one name, up to another; None is open."""

    ticker: str
    folder: str
    after: str | None = None
    upto: str | None = None


class Replies:
    """Where replies lie."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.base = fs.FileSystem.from_uri(path)

    def tickers(self) -> dict[str, str]:
        """Folders by ticker; an absent folder has none yet."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return {unquote(f.base_name.removeprefix("ticker=")): f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("ticker=")}

    def names(self, folder: str, after: str | None = None, upto: str | None = None) -> list[str]:
        """Names of complete files, below the folder, in their order."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(folder, recursive=True))
        names = sorted(f.path[len(folder) + 1 :] for f in found if f.type == fs.FileType.File and not any(part.startswith((".", "_")) for part in f.path[len(folder) + 1 :].split("/")))
        return [n for n in names if (after is None or n > after) and (upto is None or n <= upto)]

    def lines(self, part: Stretch) -> Iterator[tuple[str, str, str]]:
        for name in self.names(part.folder, part.after, part.upto):
            with self.files.open_input_stream(f"{part.folder}/{name}") as stream:
                rest = b""
                while block := stream.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    yield from ((part.ticker, name, line.decode()) for line in whole if line.strip())
                if rest.strip():
                    yield part.ticker, name, rest.decode()


class TableReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                named = {f.value}
            elif isinstance(f, In) and f.attribute == ("ticker",):
                named = set(f.value)
            else:
                yield f
                continue
            self.wanted = named if self.wanted is None else self.wanted & named

    def partitions(self) -> list[InputPartition]:
        known = Replies(self.path).tickers()
        return [Stretch(t, folder) for t, folder in sorted(known.items()) if self.wanted is None or t in self.wanted] or [Stretch("", "")]

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, str]]:
        return Replies(self.path).lines(partition) if partition.folder else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, files: int | None) -> None:
        self.path, self.files, self.last = path, files, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Goes on from the offset given last; a stream that starts again hears of its own by ``partitions`` or ``commit``."""
        replies = Replies(self.path)
        for ticker, folder in replies.tickers().items():
            new = replies.names(folder, self.last.get(ticker))
            if new:
                self.last[ticker] = new[-1 if self.files is None else min(self.files, len(new)) - 1]
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for ticker, name in end.items():
            self.last[ticker] = max(name, self.last.get(ticker, ""))
        known = Replies(self.path).tickers()
        return [Stretch(t, known[t], start.get(t), name) for t, name in sorted(end.items()) if start.get(t) != name]

    def commit(self, end: dict) -> None:
        for ticker, name in end.items():
            self.last[ticker] = max(name, self.last.get(ticker, ""))

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, str]]:
        return Replies(self.path).lines(partition)


class PolledReplies(DataSource):
    """Options: ``path``; for streams ``filesPerTrigger``, of each ticker (all, if it is not given)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        files = self.options.get("filesPerTrigger")
        return StreamReader(self.options["path"], None if files is None else int(files))


def use_polled(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets filters reach it."""
    spark.dataSource.register(PolledReplies)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
