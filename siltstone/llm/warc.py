"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

`write_archives` makes them from a table of pages; `read_archives` decodes them frame by frame and checks every record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import mapped, pick, spread, stage
from siltstone.llm.files import opened, write_bytes

# fixed values: the frame that holds a dictionary, and the beginning of a Zstandard frame
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437

#: Payloads shorter than this are always stored themselves.
LEAST_REVISIT = 100
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, page_id long, refers_to_page long, payload binary, archive string, offset long"
CHUNK = 1 << 20


def record_id(page_id: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def render(page_id: int, url: str, payload: bytes, digest: str, length: int, first: int | None) -> bytes:
    """A record.  A revisit has the digest and length of its payload in headers, and no block."""
    kind = "response" if first is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(url.split()) or "urn:none"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-ID", str(page_id)),
        ("WARC-Payload-Length", str(length)),
    ]
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(first)}>"), ("WARC-Refers-To-Page-ID", str(first))]
    block = payload if first is None else b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A dictionary from the records of one archive, or, if they are too few to train one, the raw beginning of them."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"WARC/1.1\r\nWARC-Type: response\r\n" + b"".join(samples)[:1024]


class BadArchive(ValueError):
    pass


def frames(read, archive: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame.  `read(n)` gives up to n bytes; memory is that of one record and a chunk."""
    head = read(8)
    if not head:
        return
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise BadArchive(f"{archive}: no leading dictionary frame")
    n = struct.unpack("<I", head[4:])[0]
    raw = bytearray()
    while len(raw) < n and (got := read(n - len(raw))):
        raw += got
    if len(raw) < n:
        raise BadArchive(f"{archive}: the dictionary frame is cut off")
    raw = bytes(raw)
    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    at, rest = 8 + n, b""
    while True:
        rest = rest or read(CHUNK)
        if not rest:
            return
        frame, out, used = decompressor.decompressobj(), [], 0
        while not frame.eof:
            if not rest and not (rest := read(CHUNK)):
                raise BadArchive(f"{archive}: the frame at {at} is cut off")
            try:
                out.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise BadArchive(f"{archive}: the frame at {at}: {e}") from e
            left = frame.unused_data if frame.eof else b""
            used += len(rest) - len(left)
            rest = left
        yield at, b"".join(out)
        at += used


def parse(record: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; raises BadArchive unless lengths, type and digest are right."""
    head, sep, body = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not sep or version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"{where}: no WARC header")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"{where}: a header without a name: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"{where}: no {name}")
    if not headers["content-length"].isdigit():
        raise BadArchive(f"{where}: content-length {headers['content-length']!r}")
    n = int(headers["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: content-length {n}, but {len(body) - 4} bytes")
    block = body[:n]
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "revisit" and "warc-refers-to" not in headers:
        raise BadArchive(f"{where}: a revisit that refers to nothing")
    if kind == "response" and digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise BadArchive(f"{where}: the payload is not that of its digest")
    if (length := headers.get("warc-payload-length")) is not None and (not length.isdigit() or kind == "response" and int(length) != n):
        raise BadArchive(f"{where}: warc-payload-length {length!r}, but {n} bytes")
    return headers, block


def revisited(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, first: the smallest page with the same payload, else null.

    Only digests met twice or more are joined back, so most pages meet no partner; the join's sides are plain
    exchanges, so a payload that a third of the pages have is split by adaptive execution.
    """
    pages = pick(pages, page_id="long", url="string", html="string").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    firsts = pages.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    out = pages.join(stage(firsts, "firsts"), "digest", "left")
    return out.withColumn("first", F.when(F.col("first") != F.col("page_id"), F.col("first")))


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """A row (archive, records) for each archive written into `folder`; each Arrow batch of pages makes one.

    A null url or html is empty.  Of pages with one page_id and payload, all but one would revisit themselves; page_id is
    taken as a key.  A batch's size bounds memory.  A repeated task writes new names; only returned archives count.
    """

    def make():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "bytes", "first")], strict=True)
            records = [render(p, u, h.encode(), d, n, f) for p, u, h, d, n, f in rows]
            raw = train(records[:: max(1, len(records) // 200)])
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
            compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_checksum=True, write_content_size=True)
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            write_bytes(path, [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *[compressor.compress(r) for r in records]])
            return pa.record_batch([pa.array([path]), pa.array([len(records)], pa.int64())], ["archive", "records"])

        return each

    return mapped(revisited(pages), make, "archive string, records long")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in column `archive`, streamed frame by frame.

    Raises BadArchive for a missing dictionary frame, a frame cut off or damaged, a header missing or malformed, a wrong
    Content-Length, or a payload that isn't that of its digest.  An archive of no bytes has no records.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())

    def run(batches):
        def batch(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with opened(path) as f:
                    for at, record in frames(f.read, path):
                        h, block = parse(record, f"{path} at {at}")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or hashlib.sha256(block).hexdigest()
                        length = int(h.get("warc-payload-length", len(block)))
                        page, first = (int(x) if (x := h.get(k, "")).lstrip("-").isdigit() else None for k in ("warc-page-id", "warc-refers-to-page-id"))
                        rows.append((h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to", "").strip("<>") or None, digest, length, page, first, block if payloads else None, path, at))
                        held += len(block) if payloads else 500
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spread(archives.select("archive"), "archive").mapInArrow(run, RECORD)


def checked(records: DataFrame) -> DataFrame:
    """records; reading fails if a revisit refers to no response, or to one of another payload digest or length.

    The sides are plain exchanges, so a response to which very many records refer is split by adaptive execution.
    """
    found = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload_length").alias("_length")).dropDuplicates(["refers_to"])
    same = F.coalesce((F.col("_digest") == F.col("payload_digest")) & (F.col("_length") == F.col("payload_length")), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("BadArchive: the revisit "), "record_id", F.lit(" doesn't agree with "), F.coalesce("refers_to", F.lit("any record"))))
    revisits = records.filter("record_type = 'revisit'").join(found, "refers_to", "left").withColumn("record_type", F.when(same, F.col("record_type")).otherwise(bad.cast("string")))
    return records.filter("record_type <> 'revisit'").unionByName(revisits.select(records.columns))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages' archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is empty; pages of any length are stored, each in the memory of one task; an empty table gives no archive
    and no row; of equal payloads the smallest page_id is the response; repeated rows are all responses.
    """
    records = read_archives(stage(write_archives(pages, folder), "archives"), payloads=False)
    records = checked(stage(records.drop("payload", "target_uri"), "records"))
    return records.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
