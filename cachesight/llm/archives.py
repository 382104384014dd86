"""Legacy ARC archives to WARC.

ARC files (versions 1 and 2, one gzip member a record) are read by their version's header line and declared lengths.
Each record becomes a WARC/1.1 record with an identifier, a timestamp, a type and digests made from it. Payloads stay in
files: shuffles carry digests and places only.

Rows with null ids, addresses or payloads are written (null payload: empty); rows repeated under one id make repeated
records of one type. Files are written under a name of the attempt and then renamed, so a task can run again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import materialize, partitions, rows_frame, shared_dir, strings, table
from cachesight.llm.token_files import local_path

#: The header lines of the two versions of ARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for addresses
#: Bytes of an ARC file that one task turns into one WARC file.
SEGMENT = 4 << 20
LEVEL = 3
READ = 1 << 20
GZIP = b"\x1f\x8b"
#: The end of an HTTP head; older captures have bare newlines.
HEAD_END = re.compile(rb"\r?\n\r?\n")
#: By the number of hexadecimal digits.
CHECKSUMS = {32: "md5", 40: "sha1"}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(path: str, start: int = 0, read: int = READ) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a file from the one at ``start`` on; a file that is not compressed is one."""
    with open(path, "rb") as f:
        if f.read(2) != GZIP:
            f.seek(0)
            yield 0, f.read()
            return
        f.seek(start)
        at, rest = start, b""
        while True:
            z, out, used = zlib.decompressobj(31), [], 0
            while not z.eof:
                rest = rest or f.read(read)
                if not rest:
                    if used:
                        raise ValueError(f"{path}: the member at {at} is cut off")
                    return
                out.append(z.decompress(rest))
                used += len(rest) - len(z.unused_data)
                rest = z.unused_data
            yield at, b"".join(out)
            at += used


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 cachesight\n{ARC_FIELDS[version]}\n\n".encode()
    more = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes, name: str, offset: int) -> bytes:
    more = f" 200 {hashlib.sha1(body).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{more} {len(body)}\n".encode() + body + b"\n"


def parse_arc(content: bytes, version: int, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields by name, the block of the declared length and where it ends. An address may hold spaces, so fields count from the
    right. A block that differs from its declared checksum is an error."""
    begin = content.find(b"\n", at) + 1 or len(content)
    line = content[at:begin].rstrip(b"\r\n")
    names = ARC_FIELDS[version].split()
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"no ARC {version} header line: {line[:80]!r}")
    if (length := int(parts[-1])) > len(content) - begin:
        raise ValueError(f"declared length {length} exceeds the {len(content) - begin} bytes there")
    fields, block = dict(zip(names, parts, strict=True)), content[begin : begin + length]
    if (kind := CHECKSUMS.get(len(sum_ := fields.get("Checksum", "").lower()))) and re.fullmatch("[0-9a-f]+", sum_) and hashlib.new(kind, block).hexdigest() != sum_:
        raise ValueError(f"the block of {fields['URL']} has another checksum than declared")
    return fields, block, begin + length


def arc_version(content: bytes) -> int:
    """Of a file that begins so: the second line's first number."""
    return int(content.partition(b"\n")[2].split(b" ", 1)[0])


def arc_records(path: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset of the member, offset in it, fields, block) of each record but the file's own. A member holds one record or more:
    files are compressed by record, as a whole, or not at all."""
    version = 0
    for at, content in members(path):
        inner = 0
        while inner < len(content):
            if content[inner] in b"\r\n":
                inner += 1
                continue
            first, version = not version, version or arc_version(content[inner : inner + READ])
            fields, block, end = parse_arc(content, version, inner)
            if not first:
                yield at, inner, fields, block
            inner = end


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, its fields and the payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    end = m.end() if (m := HEAD_END.search(block)) else len(block)
    lines = block[:end].decode("utf-8", "replace").splitlines()
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return block[:end], fields, block[end:]


def _address(url, row) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if isinstance(url, str) and url else f"urn:x-row:{row}"


def _write_arcs(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path, part = local_path(folder), TaskContext.get().partitionId()
        os.makedirs(path, exist_ok=True)
        out, made = {}, []
        try:
            for b in batches:
                for row, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                    row = "" if pd.isna(row) else str(int(row))
                    version = 1 + int(row or 0) % 2
                    name = f"part-{part:06d}-v{version}.arc.gz"
                    if version not in out:
                        own = f"{path}/.{uuid.uuid4().hex}"
                        out[version] = open(own, "wb", buffering=1 << 20)  # noqa: SIM115
                        made.append((own, name))
                        out[version].write(_member(arc_header(version, name, date)))
                    payload = html.encode() if isinstance(html, str) else b""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Row: {row}\r\n\r\n".encode()
                    out[version].write(_member(arc_record(version, _address(url, row), "0.0.0.0", date, "text/html", head + payload, name, out[version].tell())))
        finally:
            for f in out.values():
                f.close()
        for own, name in made:
            os.replace(own, f"{path}/{name}")
        yield strings(name=[n for _, n in made])

    return run


def write_arcs(pages: DataFrame, folder: str, date: str = "20200101000000") -> DataFrame:
    """Rows (page_id, url, html) as ARC files, odd ids as version 2; returns the files' names."""
    return materialize(pages.select("page_id", "url", "html").mapInPandas(_write_arcs(folder, date), "name string"), "arc-names")


def _index(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["name"]:
                rows = []
                for at, inner, _, block in arc_records(f"{local_path(folder)}/{name}"):
                    _, fields, payload = split_http(block)
                    row = fields.get("X-Row", "")
                    rows.append((name, at, inner, int(row) if re.fullmatch(r"-?\d+", row) else None, sha1_base32(payload), len(payload)))
                    if len(rows) == 10_000:
                        yield rows_frame(rows, INDEX_COLUMNS, ["row"])
                        rows = []
                yield rows_frame(rows, INDEX_COLUMNS, ["row"])

    return run


INDEX_COLUMNS = ["name", "at", "inner", "row", "digest", "bytes"]


def index_arcs(names: DataFrame, folder: str) -> DataFrame:
    """Place, row, payload digest and length of each record."""
    return names.repartition(partitions(names.sparkSession), "name").mapInPandas(_index(folder), "name string, at long, inner long, row long, digest string, bytes long")


def plan_revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``first``: the smallest row with the same payload if that is another row, else null.

    The smallest row is found by an aggregation that shuffles one row a digest and task; a digest that many rows share is
    joined back by a join that Spark may split.
    """
    first = index.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("row").alias("first"))
    joined = index.hint("merge").join(first, "digest", "left")  # Spark knows the size of the list of files only
    return joined.withColumn("first", F.when(F.col("first") != F.col("row"), F.col("first")))


def _record_id(row, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'row:{row}:{digest}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def to_warc(arc: dict[str, str], block: bytes, row, digest: str, first) -> bytes:
    """The WARC record of an ARC record; ``first`` is the row that it repeats, if any."""
    d = arc["Archive-date"].ljust(14, "0")
    head, _, payload = split_http(block)
    kind = "resource" if not head else "response" if first is None else "revisit"
    if kind == "revisit":
        block = head
    fields = {"WARC-Type": kind, "WARC-Record-ID": _record_id(row, digest), "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "WARC-Target-URI": arc["URL"], "WARC-IP-Address": arc["IP-address"], "Content-Type": "application/http; msgtype=response" if head else arc["Content-type"]}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "X-Row": "" if row is None else str(row)}
    if kind == "revisit":
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(first, digest), "X-Refers-To-Row": str(first)}
    return warc_record(fields, block)


CONVERTED = ["name", "segment", "at", "inner", "row", "digest", "first"]


def _convert(arcs: str, folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, own, out, last, version = local_path(folder), "", None, None, 0
        source, here, content = None, -1, b""
        os.makedirs(path, exist_ok=True)
        names = []
        for b in batches:
            for name, segment, at, inner, row, digest, first in zip(*(b[c] for c in CONVERTED), strict=True):
                if (name, segment) != last:
                    if out:
                        out.close()
                        os.replace(own, f"{path}/{names[-1]}")
                    arc_path = f"{local_path(arcs)}/{name}"
                    version = arc_version(next(members(arc_path, read=4096))[1])
                    source, here = members(arc_path, int(at)), -1  # the segment is read once, in order
                    last, own = (name, segment), f"{path}/.{uuid.uuid4().hex}"
                    names.append(f"{name.removesuffix('.arc.gz')}-{segment:06d}.warc.gz")
                    out = open(own, "wb", buffering=1 << 20)  # noqa: SIM115
                    out.write(_member(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(names[-1], ""), "WARC-Filename": names[-1], "Content-Type": "application/warc-fields"}, b"software: cachesight\r\nformat: WARC File Format 1.1\r\n")))
                while here != at:
                    here, content = next(source)
                arc, block, _ = parse_arc(content, version, inner)
                out.write(_member(to_warc(arc, block, None if pd.isna(row) else int(row), digest, None if pd.isna(first) else int(first))))
        if out:
            out.close()
            os.replace(own, f"{path}/{names[-1]}")
        yield strings(name=names)

    return run


def write_warcs(plan: DataFrame, arcs: str, folder: str) -> DataFrame:
    """Write the planned records, a WARC file for each segment of an ARC file; returns the files' names."""
    rows = plan.withColumn("segment", F.floor(F.col("at") / SEGMENT).cast("int"))
    dealt = rows.repartition(partitions(plan.sparkSession), "name", "segment").sortWithinPartitions("name", "segment", "at", "inner")
    return materialize(dealt.select(*CONVERTED).mapInPandas(_convert(arcs, folder), "name string"), "warc-names")


def parse_warc(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


WARC_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string"


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in WARC_ROWS.split(", ")]
        for b in batches:
            for name in b["name"]:
                rows = []
                for _, content in members(f"{local_path(folder)}/{name}"):
                    f, block = parse_warc(content)
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    _, http, payload = split_http(block)
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    repeats = f["WARC-Type"] == "revisit"
                    if not repeats and sha1_base32(payload) != digest:
                        raise ValueError(f"{name}: the payload of {f['WARC-Record-ID']} has another digest")
                    size = int(http["Content-Length"]) if repeats else len(payload)
                    number = lambda x: int(x) if x else None
                    rows.append((number(f["X-Row"]), f["WARC-Target-URI"], size, digest, f["WARC-Type"], number(f.get("X-Refers-To-Row", "")), f["WARC-Record-ID"], f["WARC-Date"]))
                    if len(rows) == 10_000:
                        yield rows_frame(rows, columns, ["page_id", "refers_to"])
                        rows = []
                yield rows_frame(rows, columns, ["page_id", "refers_to"])

    return run


def read_warcs(names: DataFrame, folder: str) -> DataFrame:
    """A row for each response, resource or revisit; a revisit has its payload's length from the HTTP head that it keeps."""
    return names.repartition(partitions(names.sparkSession), "name").mapInPandas(_read(folder), WARC_ROWS)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    names = write_arcs(table(spark, sf_dir, "pages"), arcs)
    plan = plan_revisits(index_arcs(names, arcs))
    found = read_warcs(write_warcs(plan, arcs, warcs), warcs)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
