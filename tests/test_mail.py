"""The mail source and its sync loop: restarts, failures, epochs, parts of messages."""

from email.message import EmailMessage

import pytest
from tallyspark.sources import mail


def message(number, thread=None, files=(), charset="utf-8"):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = "Mari Maasikas <mari@x.ee>", "a@y.ee, B <b@y.ee>", f"Re: FW: Töö {number}", f"<{number}@x>"
    m["Date"] = "Tue, 03 Mar 2026 10:00:00 +0200"
    if thread:
        m["References"] = thread
    m.set_content(f"tekst {number}\n")
    for name, data in files:
        m.add_attachment(data, maintype="application", subtype="pdf", filename=name)
    return m.as_bytes().replace(b'charset="utf-8"', f'charset="{charset}"'.encode())


def put(top, mailbox, epoch, uid, data):
    folder = top / mailbox / str(epoch)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{uid}.eml").write_bytes(data)


@pytest.fixture
def run(spark, tmp_path):
    spark.dataSource.register(mail.MailFolder)

    def go():
        raw = spark.readStream.format("mailfolder").option("path", str(tmp_path / "in")).option("per_task", 2).load()
        return mail.sync(raw, f"file://{tmp_path}/out")

    return go, tmp_path / "in"


def seen(df):
    return sorted((r.mailbox, r.uid) for r in df.collect())


def test_each_message_once(run):
    go, top = run
    for u in (1, 2, 5):
        put(top, "inbox", 7, u, message(u))
    put(top, "sent", 1, 1, message(9))
    assert seen(go()) == [("inbox", 1), ("inbox", 2), ("inbox", 5), ("sent", 1)]
    put(top, "inbox", 7, 6, message(6))
    both = go()
    assert seen(both) == [("inbox", 1), ("inbox", 2), ("inbox", 5), ("inbox", 6), ("sent", 1)]
    assert seen(go()) == seen(both)  # nothing new
    assert {(r.mailbox, r.epoch, r.last_uid, r.n_imported) for r in mail.progress(both).collect()} == {("inbox", 7, 6, 4), ("sent", 1, 1, 1)}


def test_a_failure_stops_and_is_tried_again(spark, run, tmp_path):
    go, top = run
    for u in range(1, 6):
        put(top, "inbox", 7, u, message(u, charset="no-such" if u == 4 else "utf-8"))
    put(top, "sent", 1, 8, message(8))
    with pytest.raises(Exception, match="inbox: message 4"):
        go()
    kept = spark.read.parquet(f"file://{tmp_path}/out/messages/batch=*")
    assert seen(kept) == [("inbox", 1), ("inbox", 2), ("inbox", 3), ("sent", 8)]
    put(top, "inbox", 7, 4, message(4))
    assert seen(go()) == [("inbox", u) for u in range(1, 6)] + [("sent", 8)]


def test_a_new_epoch_is_refused(run):
    go, top = run
    put(top, "inbox", 7, 1, message(1))
    go()
    put(top, "inbox", 8, 1, message(1))
    with pytest.raises(Exception, match="epoch 8 after 7"):
        go()


def test_parts(spark):
    plain = b"Subject: x\r\nIn-Reply-To: <p@x>\r\n\r\nhi"
    raw = [(1, message(1, "<a@x> <b@x>", [("arve.pdf", b"12345"), ("b.pdf", b"")])), (2, message(2)), (3, plain), (4, None), (5, b""), (6, message(6, charset="no-such"))]
    rows = {r.uid: r for r in mail.parts(spark.createDataFrame(raw, "uid long, content binary")).collect()}
    one = rows[1]
    assert (one.thread_key, one.sender_email, one.sender_name) == ("<a@x> <b@x>", "mari@x.ee", "Mari Maasikas")
    assert [tuple(a) for a in one.attachments] == [("arve.pdf", "application/pdf", 5), ("b.pdf", "application/pdf", 0)]
    assert [tuple(a) for a in one.recipients] == [("", "a@y.ee"), ("B", "b@y.ee")] and one.body_text == "tekst 1\n"
    assert str(one.sent_at) == "2026-03-03 08:00:00"
    assert rows[2].thread_key == "töö 2" and rows[2].attachments == []
    assert (rows[3].thread_key, rows[3].body_text, rows[3].sender_email, rows[3].sent_at) == ("<p@x>", "hi", "", None)
    assert rows[4].error == "no content" and rows[5].error is None and "no-such" in rows[6].error


def test_headers(spark):
    raw = b"From: =?utf-8?Q?M=C3=A4ri?= <m@x.ee>\r\nSubject: =?utf-8?B?w5Y=?=\r\n folded\r\nTo: a@y.ee,\r\n b@y.ee\r\nDate: never\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xf6"
    bad = b"Subject: =?no-such?B?w5Y=?=\r\n\r\n\xc3\xb6"
    one, two = sorted(mail.parts(spark.createDataFrame([(1, raw), (2, bad)], "uid long, content binary")).collect())
    assert (one.sender_name, one.sender_email, one.subject, one.thread_key) == ("Märi", "m@x.ee", "Ö folded", "ö folded")
    assert [a.email for a in one.recipients] == ["a@y.ee", "b@y.ee"] and one.sent_at is None and (one.body_text, one.body_html) == ("", "ö")
    assert two.subject == "=?no-such?B?w5Y=?=" and two.body_text == "��" and two.error is None


@pytest.mark.parametrize("most", [1, 2_000_000, 4_000_000])
def test_messages_are_parsed_in_slices(spark, monkeypatch, most):
    """Rows of a batch are dealt by their bytes; all come back in order, empty ones and none too."""
    monkeypatch.setattr(mail, "SLICE", most)
    big = b"Subject: s\r\n\r\n" + b"x" * 1_500_000
    rows = spark.createDataFrame([(k, None if k % 5 == 4 else b"Subject: %d\r\n\r\nb" % k if k % 2 else big) for k in range(12)], "uid long, content binary").coalesce(1)
    got = {r.uid: (r.subject, r.error, r.n) for r in mail.parts(rows).selectExpr("uid", "subject", "error", "length(body_text) AS n").collect()}
    assert got == {k: (None, "no content", None) if k % 5 == 4 else (str(k), None, 1) if k % 2 else ("s", None, 1_500_000) for k in range(12)}
    assert mail.parts(rows.limit(0)).count() == 0
