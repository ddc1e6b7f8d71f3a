"""Operator 6: WARC archives with one Zstandard frame per record and a shared dictionary.

An archive begins with a skippable frame that carries the dictionary; then
every record is a frame of its own.  Of records with equal payloads of at least
``min_bytes`` bytes, that with the largest page id is a ``response`` and the
others are ``revisit`` records that refer to it.

Tasks write archives of bounded size to a shared folder, whatever scheme its
path has, each under a temporary name first; the manifest lists the archives of
the tasks that succeeded, so a repeated task leaves at most files that nobody
reads.  The reader streams an archive, frame by frame, and raises on a wrong
magic number, a truncated frame, a missing header, or a length or digest that
does not fit.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import materialise, pick, shared_path

# fixed values of the formats
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 32 << 10
DICT_SAMPLES, DICT_SAMPLE_BYTES = 500, 32 << 10


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or, where there is too little to train on, the
    header text that all records share."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nHTTP/1.1 200 OK\r\n"


def record_id(page_id, url, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url if page_id is None else ""}\n{digest}')}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def build_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record: WARC header, HTTP header, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_b32(digest)}",
            f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, None, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """Check one record and return its fields; raises ValueError if anything does not fit."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:max(end, 0)].split(b"\r\n")
    if end < 0 or lines[0] != b"WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {raw[:40]!r}")
    h = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in h:
            raise ValueError(f"record without {name}")
    block = raw[end + 4:-4]
    if raw[-4:] != b"\r\n\r\n" or len(block) != int(h["content-length"]):
        raise ValueError(f"{h['warc-record-id']}: length {h['content-length']} does not fit")
    if "warc-block-digest" in h and h["warc-block-digest"] != _b32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"{h['warc-record-id']}: block digest does not fit")
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/"):
        raise ValueError(f"{h['warc-record-id']}: no HTTP header")
    http = _headers(block[:cut].split(b"\r\n")[1:])
    size, payload = int(http["content-length"]), block[cut + 4:]
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    if h["warc-type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{h['warc-record-id']}: payload does not fit its length and digest")
    elif h["warc-type"] != "revisit" or payload or "warc-refers-to" not in h:
        raise ValueError(f"{h['warc-record-id']}: bad {h['warc-type']} record")
    page = h.get("page-id")
    return {"record_id": h["warc-record-id"], "page_id": None if page is None else int(page), "url": h.get("warc-target-uri"),
            "record_type": h["warc-type"], "refers_to_id": h.get("warc-refers-to"), "payload_bytes": size,
            "payload_digest": digest, "payload": payload if h["warc-type"] == "response" else None}


def frames(stream, chunk: int = 1 << 16):
    """The decoded frames of an archive, one at a time."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    size = int.from_bytes(head[4:], "little")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("truncated dictionary frame")
    if int.from_bytes(raw[:4], "little") == FRAME:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = stream.read(chunk)
    while rest:
        one, out = reader.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("truncated record frame")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)
        rest = rest or stream.read(chunk)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, payload) -> also digest, kind, refers_to.  The
    payload's digest is found before the shuffle; equal payloads are counted by
    a partial aggregation, and only their largest id is joined back."""
    known = pages.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")})
    last = known.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(
        F.max("page_id").alias("keeper"))
    out = known.join(last, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                      F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record below ``folder``; returns the manifest:
    archive (path), n_records, n_bytes.

    A null html is an empty payload, a null url leaves the target header out, a
    null id leaves the id header out and never becomes the record that others
    refer to unless all ids of its payload are null (then all are responses).
    Rows that repeat id and payload give records that repeat their id.  Line
    breaks in a url are percent-encoded.  Extra columns are not read; an empty
    table gives no archives.  The dictionary is trained on at most
    DICT_SAMPLES payloads of at most DICT_SAMPLE_BYTES bytes.
    """
    spark = df.sparkSession
    pages = pick(df, page_id=id_col, url=url_col, payload=html_col).withColumn("payload", F.coalesce("payload", F.lit("")))
    # a share of the rows by hash, so that no task hands the driver more than its part of the sample
    share = min(1.0, 2 * DICT_SAMPLES / max(1, pages.count()))
    drawn = F.shiftrightunsigned(F.xxhash64("page_id", "url", F.lit(3)), 24) < int(share * (1 << 40))
    fits = (F.octet_length("payload") > 0) & (F.octet_length("payload") <= DICT_SAMPLE_BYTES)
    sample = pages.where(drawn & fits).select("payload").limit(DICT_SAMPLES).collect()
    dictionary = spark.sparkContext.broadcast(train_dictionary([r["payload"].encode() for r in sample]))

    def run(batches):
        import zstandard

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary.value),
                                          write_checksum=True)
        lead = zstandard.ZstdCompressor(level=9).compress(dictionary.value)
        lead = SKIPPABLE.to_bytes(4, "little") + len(lead).to_bytes(4, "little") + lead
        out, done, part, n, size = None, [], 0, 0, 0

        def close():
            out.close()
            fs.move(f"{name}-{part}.tmp", f"{name}-{part}.warc.zst")
            done.append((f"{name.rpartition('/')[2]}-{part}.warc.zst", n, size))

        try:
            for batch in batches:
                # a few rows at a time become Python objects
                for r in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
                    if out is None:
                        out, n, size = fs.open_output_stream(f"{name}-{part}.tmp"), 0, len(lead)
                        out.write(lead)
                    frame = writer.compress(build_record(r["page_id"], r["url"], r["payload"].encode(), r["digest"],
                                                         r["kind"], r["refers_to"], date))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    if size >= archive_bytes:
                        close()
                        out, part = None, part + 1
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([f"{folder}/{a}" for a, _, _ in done], pa.string()),
                                          "n_records": pa.array([x for _, x, _ in done], pa.int64()),
                                          "n_bytes": pa.array([x for _, _, x in done], pa.int64())})

    rows = with_revisits(pages, min_bytes).mapInArrow(run, "archive string, n_records long, n_bytes long")
    return materialise(rows, "warc-manifest")


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives: record_id, page_id, url, record_type,
    refers_to_id, payload_bytes, payload_digest, payload (null for a revisit, or
    if not asked for).  Fails on the first record or archive that does not fit."""
    fields = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
              ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("payload", pa.binary())]

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = filesystem(path)
                rows, size, n = [], 0, 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for raw in frames(stream):
                        r = parse_record(raw)
                        r["payload"] = r["payload"] if payload else None
                        rows.append(r)
                        size, n = size + len(raw), n + 1
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{path}: {n} records, {expected} in the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    schema = ("record_id string, page_id long, url string, record_type string, refers_to_id string, payload_bytes long, "
              "payload_digest string, payload binary")
    tasks = max(1, manifest.count())
    return manifest.select("archive", "n_records").repartition(tasks).mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_to: the page id of the response that a revisit names.
    Raises if a revisit names none, or one with another payload digest."""
    target = records.where("record_type = 'response'").select(
        F.col("record_id").alias("rid"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("rd")).dropDuplicates(["rid"])
    # only revisits are joined: the nulls of all other records would meet in one task
    out = records.where("refers_to_id IS NOT NULL").join(target, F.col("refers_to_id") == F.col("rid"), "left")
    wrong = F.col("rd").isNull() | (F.col("rd") != F.col("payload_digest"))
    problem = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("record_id"))).cast("long")
    out = out.withColumn("refers_to", F.when(wrong, problem).otherwise(F.col("refers_to"))).drop("rid", "rd")
    rest = records.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return out.unionByName(rest)


def archive_round_trip(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``df`` to archives and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url."""
    folder = folder or shared_path(df.sparkSession, "warc")
    records = read_warc(write_warc(df, folder, **options), payload=False)
    records = materialise(records, "warc-records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
