"""Mail: a stream of message files by mailbox and number, their parts as columns, and a sync loop that stops at a failure.

A mailbox is a folder `<path>/<mailbox>/<epoch>/<number>.eml` on a file system that all nodes mount. Numbers only grow; a new
epoch means that old numbers hold no more.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RAW = "mailbox string, epoch long, uid long, content binary"
ADDRESS = "array<struct<name:string,email:string>>"
PARTS = f"""internet_message_id string, thread_key string, subject string, sender_email string, sender_name string, recipients {ADDRESS}, cc {ADDRESS}, bcc {ADDRESS},
 sent_at timestamp, body_text string, body_html string, attachments array<struct<name:string,type:string,size:long>>, error string"""

#: Bytes of messages that are parsed before their parts leave the task's Python.
SLICE = 4_000_000
COLUMNS = "internet_message_id thread_key subject sender_email sender_name recipients cc bcc sent_at body_text body_html attachments error".split()


class EpochChanged(RuntimeError):
    """A mailbox has a new epoch: its cursor holds no more, and someone must decide what is read again."""


class SyncStopped(RuntimeError):
    """A message could not be read; all before it in its mailbox are stored."""


class Numbers(InputPartition):
    def __init__(self, mailbox: str, epoch: int, uids: list[int]):
        self.mailbox, self.epoch, self.uids = mailbox, epoch, uids


class MailFolder(DataSource):
    """Options: path, and per_task (messages a task reads, 500)."""

    @classmethod
    def name(cls) -> str:
        return "mailfolder"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MailReader(self.options["path"].removeprefix("file://"), int(self.options.get("per_task", 500)))


class MailReader(DataSourceStreamReader):
    """Offsets are {mailbox: [epoch, highest number read]}, so a restart reads on from the checkpoint's, and a batch that
    was not finished is read again with the numbers it had."""

    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def _uids(self, mailbox: str, epoch: int) -> list[int]:
        names = os.listdir(f"{self.path}/{mailbox}/{epoch}")
        return sorted(int(n[:-4]) for n in names if n.endswith(".eml") and n[:-4].isdigit())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for mailbox in sorted(os.listdir(self.path)):
            epochs = [int(e) for e in os.listdir(f"{self.path}/{mailbox}") if e.isdigit()]
            if epochs:
                found[mailbox] = [max(epochs), max(self._uids(mailbox, max(epochs)), default=0)]
        return found

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        out = []
        for mailbox, (epoch, last) in end.items():
            before, first = start.get(mailbox, [epoch, 0])
            if before != epoch:
                raise EpochChanged(f"{mailbox}: epoch {epoch} after {before}")
            new = [u for u in self._uids(mailbox, epoch) if first < u <= last]
            out += [Numbers(mailbox, epoch, new[i : i + self.per_task]) for i in range(0, len(new), self.per_task)]
        return out

    def read(self, partition: Numbers) -> Iterator[tuple]:
        for uid in partition.uids:
            with open(f"{self.path}/{partition.mailbox}/{partition.epoch}/{uid}.eml", "rb") as f:
                yield partition.mailbox, partition.epoch, uid, f.read()


def parts(raw: DataFrame, column: str = "content") -> DataFrame:
    """MIME bytes -> headers, addresses, both bodies and the attachments' names, types and sizes, in the place of `column`.

    The thread is the message's references, else what it answers, else its subject without re:, fw: and fwd:. A message
    without bytes, or one whose text can't be decoded, has an error and nulls. A task holds the parts of SLICE bytes of
    messages at a time, however many rows a batch has.
    """

    def parsed(contents: pd.Series) -> pd.DataFrame:
        import re
        from email import message_from_bytes
        from email.errors import HeaderParseError
        from email.header import decode_header, make_header
        from email.utils import getaddresses, parsedate_to_datetime

        def day(text):
            try:
                at = pd.Timestamp(parsedate_to_datetime(text))
            except (TypeError, ValueError):
                return None
            return at.tz_localize("UTC") if at.tzinfo is None else at.tz_convert("UTC")

        def unfold(value):
            return re.sub(r"\r?\n(?=[ \t])", "", str(value or ""))

        def decoded(value):
            """A header's text with its encoded words read; one that can't be read stays as it is."""
            text = unfold(value)
            if "=?" not in text:
                return text
            try:
                return str(make_header(decode_header(text)))
            except (HeaderParseError, LookupError, ValueError):
                return text

        def one(raw):
            if raw is None:
                return {"error": "no content"}
            m = message_from_bytes(raw)
            head = lambda name: decoded(m.get(name))
            people = lambda name: [{"name": decoded(n), "email": a} for n, a in getaddresses([unfold(m.get(name))]) if a]
            bodies, files = {}, []
            try:
                for part in (p for p in m.walk() if not p.is_multipart()):
                    kind = part.get_content_type()
                    if part.get_content_disposition() == "attachment":
                        files.append({"name": decoded(part.get_filename()), "type": kind, "size": len(part.get_payload(decode=True) or b"")})
                    elif kind in ("text/plain", "text/html") and not bodies.get(kind):
                        bodies[kind] = (part.get_payload(decode=True) or b"").decode(part.get_content_charset("ascii"), "replace")
            except (LookupError, ValueError) as e:
                return {"error": f"{type(e).__name__}: {e}"}
            sender, subject = (people("From") or [{"name": "", "email": ""}])[0], head("Subject")
            own = re.sub(r"^(\s*(re|fwd|fw):)+", "", subject, flags=re.I).strip().casefold()
            return {
                "internet_message_id": head("Message-ID"),
                "thread_key": head("References") or head("In-Reply-To") or own,
                "subject": subject,
                "sender_email": sender["email"],
                "sender_name": sender["name"],
                "recipients": people("To"),
                "cc": people("Cc"),
                "bcc": people("Bcc"),
                "sent_at": day(head("Date")),
                "body_text": bodies.get("text/plain", ""),
                "body_html": bodies.get("text/html", ""),
                "attachments": files,
            }

        out = pd.DataFrame([[m.get(c) for c in COLUMNS] for m in map(one, contents)], columns=COLUMNS, dtype=object)
        out["sent_at"] = pd.to_datetime(out["sent_at"], utc=True)
        return out

    most = SLICE

    @F.pandas_udf(PARTS)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            start = held = 0
            for i, raw in enumerate(contents):
                n = len(raw or b"")
                if i > start and held + n > most:
                    yield parsed(contents.iloc[start:i])
                    start, held = i, 0
                held += n
            yield parsed(contents.iloc[start:])

    others = [c for c in raw.columns if c != column]
    return raw.withColumn("_m", parse(column)).select(*others, "_m.*")


def sync(raw: DataFrame, path: str) -> DataFrame:
    """Store what a stream of RAW rows holds now, each message once; path is a shared folder of the sync's own.

    A message that can't be read stops the sync: those before it in its mailbox, and all of mailboxes without a failure, are
    stored, and the same batch is tried again next time. A batch replaces what it wrote before. Messages are written once:
    a batch without a failure is moved to its place, and only one with a failure is filtered and written again.
    """
    jvm = raw.sparkSession._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(raw.sparkSession._jsc.hadoopConfiguration())

    def store(rows: DataFrame, number: int) -> None:
        out, found = f"{path}/messages/batch={number}", f"{path}/parsed/batch={number}"
        parts(rows).write.mode("overwrite").parquet(found)
        parsed = rows.sparkSession.read.parquet(found)
        failed = parsed.where("error is not null").groupBy("mailbox").agg(F.min("uid").alias("_stop"))
        first = failed.orderBy("mailbox").first()
        if first is None:
            fs.delete(at(out), True)
            fs.mkdirs(at(f"{path}/messages"))
            if not fs.rename(at(found), at(out)):
                raise OSError(f"{found} can't be moved to {out}")
            return
        good = parsed.join(failed, "mailbox", "left").where("_stop is null or uid < _stop").drop("_stop")
        good.write.mode("overwrite").parquet(out)
        raise SyncStopped(f"{first['mailbox']}: message {first['_stop']}")

    query = raw.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return stored(raw, path)


def stored(raw: DataFrame, path: str) -> DataFrame:
    return raw.sparkSession.read.parquet(f"{path}/messages/batch=*").drop("error")


def progress(messages: DataFrame) -> DataFrame:
    """The cursor of each mailbox and how many messages came."""
    return messages.groupBy("mailbox", "epoch").agg(F.max("uid").alias("last_uid"), F.count("*").alias("n_imported"))
