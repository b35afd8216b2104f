"""An incremental mailbox source: messages after a UID, by batch or stream, read in parallel by byte ranges.

Registered as a Python data source `mailbox`.  The path is a JSON lines file
(uid, sender, subject, body; UIDs rise), as an export of an IMAP server gives,
in any store that Arrow's file systems reach and executors share.  The driver
asks for its size only: each partition reads the messages that begin in its
range of SPAN bytes.  A stream's offset is a place in the file, so its
checkpoint is the cursor; where the file has become shorter (the server has
given it a new validity), reading starts anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "uid bigint, sender string, subject string, body string"
SPAN = 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def size(path: str) -> int:
    system, name = opened(path)
    return max(0, system.get_file_info(name).size or 0)


def lines(path: str, begin: int, end: int) -> Iterator[bytes]:
    """Lines that begin at a place from `begin` up to `end`."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        file.seek(max(0, begin - 1))
        at, rest = max(0, begin - 1), b""
        skip = begin > 0  # up to the line end before the first line that begins here
        while True:
            block = file.read(1 << 20)
            rest += block
            while (stop := rest.find(b"\n")) >= 0 or (not block and rest):
                line = rest[: stop + 1] if stop >= 0 else rest
                if skip:
                    skip = False
                elif at >= end:
                    return
                else:
                    yield line
                at, rest = at + len(line), rest[len(line) :]
            if not block or (at >= end and not skip):
                return


class Bytes(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def ranges(begin: int, end: int, span: int) -> list[InputPartition]:
    return [Bytes(at, min(at + span, end)) for at in range(begin, end, span)]


def messages(options: dict, part: Bytes) -> Iterator[tuple]:
    """Messages of a range whose UID is larger than the asked one, of the asked sender and subject."""
    after, sender, subject = int(options.get("after", 0)), options.get("sender", ""), options.get("subject", "")
    for line in lines(options["path"], part.begin, part.end):
        m = json.loads(line) if line.strip() else {}
        if m and m["uid"] > after and sender in m["sender"] and subject in m["subject"]:
            yield m["uid"], m["sender"], m["subject"], m["body"]


class MailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return ranges(0, size(self.options["path"]), int(self.options.get("span", SPAN)))

    def read(self, partition: Bytes) -> Iterator[tuple]:
        yield from messages(self.options, partition)


class MailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """After the last whole line."""
        end = size(self.options["path"])
        at = max(0, end - SPAN)
        system, name = opened(self.options["path"])
        if not end:
            return {"at": 0}
        with system.open_input_file(name) as file:
            file.seek(at)
            return {"at": at + file.read(end - at).rfind(b"\n") + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin = start["at"] if start["at"] <= end["at"] else 0
        return ranges(begin, end["at"], int(self.options.get("span", SPAN)))

    def read(self, partition: Bytes) -> Iterator[tuple]:
        yield from messages(self.options, partition)


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MailReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return MailStream(dict(self.options))
