"""A landed mailbox as a source: a listing of what it holds, and a history of what was added.

A folder, local or in any store that Arrow reaches, has `history/FIRST-LAST.jsonl` (the messages
added with history ids FIRST to LAST) and `snapshot/ID-PAGE.jsonl` (pages of a listing of the whole mailbox, made
when its latest history id was ID). Old history is taken away, as mail servers do, so that a cursor
can expire.

    spark.dataSource.register(Mailbox)
    spark.readStream.format("mailbox").load(path)      # with a cursor of its own
    spark.read.format("mailbox").load(path)            # the whole listing

The stream's offset is the last history id it has read; Spark keeps it in the checkpoint after each
batch. A batch reads the history since the cursor, a file a task. Without a cursor, or where
the history since has been taken away, it reads the listing, and then what was added after
it; that gives messages again that came before, which `ingest.mail` drops by its ledger. A listing older than
the history that is left would lose messages, and is an error. Only messages from `since` (a date, as an option)
on are listed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FIELDS = ["history_id", "message_id", "thread_id", "occurred_at", "sender", "subject", "body_text"]
SCHEMA = "history_id long, message_id string, thread_id string, occurred_at timestamp, sender string, subject string, body_text string"


@dataclass
class Piece(InputPartition):
    """A file, and the history ids that are taken from it."""

    path: str
    after: int
    until: int

    def __init__(self, path: str, after: int, until: int):
        self.path, self.after, self.until = path, after, until


class Folder:
    """The files of a mailbox by their names."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _numbered(self, kind: str) -> list[tuple[int, int, str]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{kind}", allow_not_found=True))
        named = [(f.base_name.removesuffix(".jsonl").split("-"), f.path) for f in found if f.base_name.endswith(".jsonl")]
        return sorted((int(a), int(b), path) for (a, b), path in named)

    @property
    def history(self) -> list[tuple[int, int, str]]:
        """(first, last, path), in order."""
        return self._numbered("history")

    @property
    def listing(self) -> tuple[int, list[str]]:
        """The latest listing: the history id when it was made, and its pages."""
        pages = self._numbered("snapshot")
        at = max((a for a, _, _ in pages), default=0)
        return at, [path for a, _, path in pages if a == at]

    def latest(self) -> int:
        return max([self.listing[0], *[last for _, last, _ in self.history]])

    def pieces(self, after: int, until: int) -> list[Piece]:
        """Files for the history ids over `after` up to `until`; the listing where no cursor
        or history leads there."""
        history = self.history
        at, pages = self.listing
        out: list[Piece] = []
        kept = min([first for first, _, _ in history], default=self.latest() + 1)
        if not after or after < kept - 1:
            if at < kept - 1:
                raise ValueError(f"the listing ends at {at} and the history begins at {kept}: messages between them are lost")
            out, after = [Piece(path, -1, until) for path in pages], at
        return out + [Piece(path, after, until) for first, last, path in history if last > after and first <= until]

    def rows(self, piece: Piece, since: str | None) -> Iterator[tuple]:
        least = datetime.fromisoformat(since) if since else None
        with self.fs.open_input_stream(piece.path) as file:
            for line in file.read().splitlines():
                m = json.loads(line)
                at = datetime.fromisoformat(m["occurred_at"])
                if piece.after < m["history_id"] <= piece.until and (piece.after >= 0 or least is None or at >= least):
                    yield tuple(at if f == "occurred_at" else m.get(f) for f in FIELDS)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.since = options["path"], options.get("since")

    def initialOffset(self) -> dict:
        return {"history": 0}

    def latestOffset(self) -> dict:
        return {"history": Folder(self.path).latest()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return Folder(self.path).pieces(start["history"], end["history"])

    def read(self, piece: Piece) -> Iterator[tuple]:
        return Folder(self.path).rows(piece, self.since)


class _Listing(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.since = options["path"], options.get("since")

    def partitions(self) -> list[Piece]:
        folder = Folder(self.path)
        return [Piece(path, -1, 1 << 62) for path in folder.listing[1]]

    def read(self, piece: Piece) -> Iterator[tuple]:
        # an empty mailbox is read as one piece that isn't any file
        return Folder(self.path).rows(piece, self.since) if isinstance(piece, Piece) else iter(())


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Listing(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
