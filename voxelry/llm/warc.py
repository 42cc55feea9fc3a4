"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

From each response two records are made. The metadata record describes it as JSON: HTTP status and headers, digests,
title, links. The conversion record holds the plain text of the page. Both name the response in WARC-Refers-To and each
other in WARC-Concurrent-To, carry its target URI, date and payload digest, and have digests and identifiers of their
own. Identifiers are derived from the response's identifier, the digest of its payload and the record type, so that a
repeated run gives the same records, rows of the same response share theirs, and other payloads under the same name do not.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.html import RAW, blocks, parse, walk

RESPONSE_COLUMNS = ["record_id", "target_uri", "warc_date", "http_headers", "payload"]
_RECORD = "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, RFC 9562


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_identifier(*names: str | None) -> str:
    """An identifier for a list of names; null and the empty name differ, and so do all lists."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps(names))}>"


def responses_of_pages(pages: DataFrame, warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Responses ``page_id, record_id, target_uri, warc_date, http_headers, payload`` from crawled ``pages(page_id, url, html)``.

    Identifiers follow from page_id, url and the digest of the page; null differs from empty, equal rows have equal
    identifiers. A null page has a null payload.
    """

    @F.pandas_udf("string")
    def identifier(ids: pd.Series, urls: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([record_identifier("response", *names) for names in zip(ids, urls, digests)], dtype=object)

    length = F.octet_length(F.coalesce("html", F.lit("")))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", identifier(F.col("page_id").cast("string"), F.col("url"), F.sha1("html")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(warc_date).alias("warc_date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def http_head(source: str | None) -> dict:
    """Status line and headers of a response as JSON values; repeated headers keep all their values."""
    lines = (source or "").replace("\r\n", "\n").strip("\n").split("\n")
    found: dict = {"Status-Line": lines[0].strip(), "Headers": {}}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found["Headers"].setdefault(name.strip(), []).append(value.strip())
    return found


def derivatives(record_id: str | None, target_uri: str | None, warc_date: str | None, http_headers: str | None, payload: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response, in the order of _RECORD."""
    named, record_id = record_id, record_id or ""
    body, head = (payload or "").encode("utf-8"), (http_headers or "").encode("utf-8")
    payload_digest, block_digest = digest(body), digest(head + body)
    root = parse(payload or "")
    title, links = None, []
    for node in walk(root):
        if node.tag == "title" and title is None:
            title = " ".join("".join(x for x in node.children if isinstance(x, str)).split())
        elif node.tag in ("a", "area", "link") and node.attributes.get("href"):
            links.append({"path": f"{node.tag.upper()}@/href", "url": node.attributes["href"]})
        elif node.tag in ("img", "script", "iframe", "source") and node.attributes.get("src"):
            links.append({"path": f"{node.tag.upper()}@/src", "url": node.attributes["src"]})
    text = "\n".join(blocks([root], lambda n: n.tag in RAW or n.tag == "head"))
    ids = {kind: record_identifier(kind, named, payload_digest) for kind in ("metadata", "conversion")}
    envelope = {
        "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": target_uri, "WARC-Date": warc_date, "WARC-Payload-Digest": payload_digest, "WARC-Block-Digest": block_digest, "Content-Length": str(len(head) + len(body))},
        "HTTP-Response-Metadata": http_head(http_headers) | {"Entity-Length": str(len(body)), "Entity-Digest": payload_digest, "HTML-Metadata": {"Title": title, "Links": links}},
        "Conversion": {"WARC-Record-ID": ids["conversion"], "Content-Length": str(len(text.encode("utf-8")))},
    }
    out = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False, separators=(",", ":"))), ("conversion", "text/plain", text)):
        data = block.encode("utf-8")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        out.append((kind, ids[kind], record_id, other, target_uri, warc_date, content_type, len(data), digest(data), payload_digest, http_headers, data))
    return out


def derive_records(responses: DataFrame) -> DataFrame:
    """Two records for each row of ``responses(record_id, target_uri, warc_date, http_headers, payload)``.

    All other columns of ``responses`` are kept in front, unless they have the name of a result column. Result:
    ``warc_type`` (metadata, conversion), ``record_id``, ``refers_to`` (the response), ``concurrent_to`` (the other
    derivative), ``target_uri``, ``warc_date``, ``content_type``, ``content_length``, ``block_digest``,
    ``source_payload_digest``, ``source_headers`` (the HTTP headers of the response as they were), ``block BINARY``.
    Null payloads and headers count as empty and give records of empty pages; null identifiers refer to the empty string,
    but their records' own identifiers differ from those of an empty one; null URIs and dates stay null. Repeated rows give
    repeated records; rows of one identifier with other payloads give records with other identifiers. A map over rows without a shuffle.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]
    others = [F.col(f"`{c}`") for c in responses.columns if c not in (*RESPONSE_COLUMNS, *names)]

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ') for x in _RECORD.split(', '))}>>")
    def records(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([[dict(zip(names, r)) for r in derivatives(*row)] for row in zip(*columns)], dtype=object)

    made = responses.select(*others, F.explode(records(*(F.col(c) for c in RESPONSE_COLUMNS))).alias("_record"))
    return made.select(*others, "_record.*")


def record_bytes(records: DataFrame) -> DataFrame:
    """Adds ``record BINARY``: the record as it stands in a WARC file, header lines, empty line, block and two line ends.

    Header lines whose value is null are left out.
    """
    line = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Concurrent-To", "concurrent_to"),
        line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"), line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"),
    )
    return records.withColumn("record", F.concat(F.concat(head, F.lit("\r\n\r\n")).cast("binary"), "block", F.lit("\r\n\r\n").cast("binary")))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes one file of concatenated records for each partition under ``path``, through Spark's text writer."""
    whole = F.decode("record", "UTF-8")
    text = record_bytes(records).select(F.substring(whole, F.lit(1), F.char_length(whole) - 2).alias("value"))
    text.write.option("lineSep", "\r\n").text(path)


__all__ = ["derivatives", "derive_records", "digest", "http_head", "record_bytes", "record_identifier", "responses_of_pages", "write_warc"]
