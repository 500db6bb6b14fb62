"""Content-addressed WARC archive: payload bytes once by verified SHA-256, exact record headers apart, records by joins."""

from __future__ import annotations

import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, remove, scratch, written

#: Payloads shorter than this are always stored as responses of their own.
REVISIT_FROM = 1000

#: Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"


_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\s]+")


def urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def header(page_id: int, url: str | None, n_bytes: int, sha1: str, sha256: str, refers_to: int | None) -> bytes:
    """The exact bytes of a record's header block, the closing empty line included. What can't stand in a header line (white
    space, control characters) is percent-encoded in the address, which X-URL then holds as it was."""
    target = urn(page_id)[1:-1] if url is None else _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    block = hashlib.sha256(b"").hexdigest() if refers_to is not None else sha256
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {target}",
        *([] if url in (None, target) else [f"X-URL: {json.dumps(url)}"]),
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha256:{block}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]),
        "Content-Type: text/html",
        f"X-Payload-Length: {n_bytes}",
        f"Content-Length: {n_bytes if refers_to is None else 0}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def url_of(head: dict[str, str]) -> str | None:
    """The address a record was written with."""
    if "X-URL" in head:
        return json.loads(head["X-URL"])
    return None if head["WARC-Target-URI"] == head["WARC-Record-ID"][1:-1] else head["WARC-Target-URI"]


def parse(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    assert version == "WARC/1.1" and head.endswith(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in lines if line)


def write_archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the two tables of the archive into the shared folder, and returns them as read back.

    payloads (sha256, stored): each distinct payload once, deflated. headers (page_id, sha256, header): one row per
    record. Of records with equal payloads of at least REVISIT_FROM bytes, the one with the largest page_id is the
    response, and the others are revisits that refer to it; rows that repeat that page_id too are responses alike.
    """
    spark = pages.sparkSession
    bound_batches(spark, 512)

    def digests(batches):
        for b in batches:
            data = [t.encode() for t in b["html"]]
            yield {
                "page_id": b["page_id"],
                "url": b["url"],
                "n_bytes": [len(x) for x in data],
                "sha1": [hashlib.sha1(x).hexdigest() for x in data],
                "sha256": [hashlib.sha256(x).digest() for x in data],
                "stored": [zlib.compress(x, 6) for x in data],
            }

    fields = "page_id long, url string, n_bytes long, sha1 string, sha256 binary, stored binary"
    staged = written(map_columns(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), fields, digests), "warc-staged")
    # Equal digests meet after a partial aggregation in each task, so a payload that a third of all pages share moves once a task.
    found = written(staged.groupBy("sha256").agg(F.first("stored").alias("stored"), F.max("page_id").alias("response_id"), F.max("n_bytes").alias("n_bytes")), "warc-payloads")
    responses = found.where(F.col("n_bytes") >= REVISIT_FROM).select("sha256", "response_id")
    records = staged.drop("stored").join(responses, "sha256", "left")
    refers = F.when(F.col("response_id") != F.col("page_id"), F.col("response_id")).alias("refers_to")

    def headers(batches):
        for b in batches:
            rows = zip(b["page_id"], b["url"], b["n_bytes"], b["sha1"], (x.hex() for x in b["sha256"]), b["refers_to"], strict=True)
            yield {"page_id": b["page_id"], "sha256": b["sha256"], "header": [header(*r) for r in rows]}

    kept = written(map_columns(records.select("page_id", "url", "n_bytes", "sha1", "sha256", refers), "page_id long, sha256 binary, header binary", headers), "warc-headers")
    remove(spark, staged)
    return found.select("sha256", "stored"), kept


def read_archive(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """page_id, header, payload of every record: each header meets the payload stored under its digest, which is verified. A
    record whose payload is missing, or has another digest, is an error."""
    joined = headers.join(payloads, "sha256", "left")

    def rebuild(batches):
        for b in batches:
            # A payload that many records of a batch share is inflated and verified once.
            known: dict[bytes, bytes] = {}
            for digest, stored in zip(b["sha256"], b["stored"], strict=True):
                if digest not in known:
                    if stored is None:
                        raise ValueError(f"no payload is stored under {digest.hex()}")
                    known[digest] = zlib.decompress(stored)
                    if hashlib.sha256(known[digest]).digest() != digest:
                        raise ValueError(f"the payload stored under {digest.hex()} has another digest")
            yield {"page_id": b["page_id"], "header": b["header"], "payload": [known[d] for d in b["sha256"]]}

    return map_columns(joined.select("page_id", "header", "sha256", "stored"), "page_id long, header binary, payload binary", rebuild)


def record_bytes(head: bytes, payload: bytes) -> bytes:
    """The record as it stands in a .warc file; a revisit's block is empty."""
    return head + (b"" if parse(head)["WARC-Type"] == "revisit" else payload) + b"\r\n\r\n"


def export_warc(payloads: DataFrame, headers: DataFrame, label: str = "warc-files") -> str:
    """Original records, one row a record in WARC bytes, as a table in the shared folder; its path."""

    def build(batches):
        for b in batches:
            yield {"page_id": b["page_id"], "record": [record_bytes(h, p) for h, p in zip(b["header"], b["payload"], strict=True)]}

    path = scratch(headers.sparkSession, label)
    map_columns(read_archive(payloads, headers), "page_id long, record binary", build).write.parquet(path)
    return path


def archived(pages: DataFrame) -> DataFrame:
    """Writes every page, reads the archive back, and reports each record from what was read.

    Null html is an empty payload (a response); equal pages are revisits of the largest page_id; a table without rows
    gives none; other columns of pages are left out.
    """
    payloads, headers = write_archive(pages)

    def report(batches):
        for b in batches:
            heads = [parse(h) for h in b["header"]]
            sha1 = [hashlib.sha1(p).hexdigest() for p in b["payload"]]
            for head, digest, payload in zip(heads, sha1, b["payload"], strict=True):
                if head["WARC-Payload-Digest"] != f"sha1:{digest}" or int(head["X-Payload-Length"]) != len(payload):
                    raise ValueError(f"{head['WARC-Record-ID']} doesn't fit its payload")
            yield {
                "page_id": b["page_id"],
                "payload_bytes": [len(p) for p in b["payload"]],
                "payload_digest": sha1,
                "record_type": [h["WARC-Type"] for h in heads],
                "refers_to": [int(r[len("<urn:page:") : -1]) if (r := h.get("WARC-Refers-To")) else None for h in heads],
            }

    return map_columns(read_archive(payloads, headers), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", report)
