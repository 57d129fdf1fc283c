"""Deterministic sharded WARC writer, and a reader.

Records are sorted by (page_id, payload digest) over shards, ranges of that key
of about equal bytes; a shard is one task, its files are rolled by compressed
size.  The cuts follow from the table alone, so the files do not depend on how
Spark deals out the work.  Headers, ids and digests are derived from the content.
A task writes each file under a temporary name and reports it; the reports are
written as the manifest, and only then are the files renamed.  `finish_warc`
repeats that last step where it was broken off.  Of equal payloads, one record is
a response and the others revisit it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deal_ranges, materialize, release

DATE = "2024-01-01T00:00:00Z"
#: Bytes of a shard: a 64th of the table, within these bounds.
SHARD_BYTES = (1 << 18, 64 << 20)
#: What a record takes besides its payload, about.
RECORD_BYTES = 512
ROLL_BYTES = 16 << 20
LEAST_REVISIT = 100
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _store(path: str):
    """File system and path of a folder in any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, n: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{n}/{digest}')}>"


def _b32(hex_digest: str) -> str:
    return "sha256:" + base64.b32encode(bytes.fromhex(hex_digest)).decode().rstrip("=")


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value)


def record(page_id, n: int, url: str | None, html: bytes, digest: str, refers: int | None) -> bytes:
    """One record as a gzip member without time or name."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http + html if refers is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, n, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: {_b32(digest)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha256(block).hexdigest())}",
        f"X-Payload-Length: {len(html)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers, 0, digest)}", f"X-Refers-To-Page: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as z:
        z.write("\r\n".join(head).encode() + block + b"\r\n\r\n")
    return out.getvalue()


MANIFEST = ("file string, temporary string, shard bigint, records bigint, bytes bigint, sha256 string, "
            "first_page bigint, last_page bigint")


def _write(folder: str, roll_bytes: int):
    """Rows of whole shards sorted by (page_id, digest, ...): the note (refers_to) of a page
    and digest comes before the rows that it is about.  Records are numbered
    within page and digest, so what is referred to has number 0."""
    def run(batches):
        store, base = _store(folder)
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        out = None

        def close():
            nonlocal out
            stream, o, out = out["stream"], out, None
            stream.close()
            row = [o["file"], o["tmp"], o["shard"], o["n"], o["bytes"], o["sha"].hexdigest(), o["first"], o["last"]]
            return pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.array([x], pa.int64())
                                               for x in row], names)

        note, last, repeat, shard, roll = None, None, 0, None, 0
        for b in batches:
            htmls = b.column(b.schema.get_field_index("html"))
            for i, r in enumerate(b.drop_columns(["html"]).to_pylist()):
                if r["note"]:
                    note = (r["page_id"], r["digest"], r["refers_to"])
                    continue
                page, key = r["page_id"], (r["page_id"], r["digest"])
                repeat = repeat + 1 if key == last else 0
                last = key
                if out is not None and (r["shard"] != out["shard"] or out["bytes"] >= roll_bytes):
                    yield close()
                if out is None:
                    roll = roll + 1 if r["shard"] == shard else 0
                    shard = r["shard"]
                    name = f"part-{shard:08d}-{roll:05d}.warc.gz"
                    tmp = f"_tmp-{uuid.uuid4().hex}-{name}"
                    out = {"file": name, "tmp": tmp, "shard": shard, "n": 0, "bytes": 0, "sha": hashlib.sha256(),
                           "first": page, "last": page, "stream": store.open_output_stream(f"{base}/{tmp}", compression=None)}
                html = htmls[i].as_buffer().to_pybytes() if htmls[i].is_valid else b""
                digest = r["digest"].hex()
                refers = note[2] if note is not None and note[:2] == key else None
                if repeat and refers is None and len(html) >= LEAST_REVISIT:
                    refers = page  # a repeated row revisits its first copy, if it has an id
                data = record(page, repeat, r["url"], html, digest, refers)
                out["stream"].write(data)
                out["sha"].update(data)
                out["bytes"] += len(data)
                out["n"] += 1
                out["last"] = page
        if out is not None:
            yield close()
    return run


def _commit(folder: str):
    def run(batches):
        store, base = _store(folder)
        from pyarrow import fs

        for b in batches:
            for name, tmp in zip(b.column("file").to_pylist(), b.column("temporary").to_pylist(), strict=True):
                have = store.get_file_info([f"{base}/{tmp}", f"{base}/{name}"])
                if have[0].type == fs.FileType.File:
                    store.move(f"{base}/{tmp}", f"{base}/{name}")
                elif have[1].type != fs.FileType.File:
                    raise OSError(f"neither {tmp} nor {name} is there")
            yield pa.RecordBatch.from_arrays([b.column("file")], ["file"])
    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as WARC files into `folder`; returns the
    manifest (one row per file), which is also kept there as Parquet.

    Of records with equal payloads of at least 100 bytes, the one with the
    smallest page_id is the response.  Null html is an empty payload, a null url
    an empty target; null ids come first and, if no id shares their payload, are
    responses; repeated rows of one id and payload revisit its first copy, rows of
    one id with other payloads do not.  An id (or the null ids) that outweighs a
    shard is cut by payload digest; rows alike in id and payload are one chain of
    numbers and stay in one shard.  An empty table gives no files.  Other columns
    are not read.  A folder with a whole manifest is not written again: FileExistsError.

    One exchange moves the pages; what a page refers to travels with it as a
    narrow note."""
    from pyarrow import fs

    store, base = _store(folder)
    if store.get_file_info(f"{base}/_manifest/_SUCCESS").type == fs.FileType.File:
        raise FileExistsError(f"{folder} holds an archive; finish_warc() ends a commit that was broken off")
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("digest")
    every = materialize(pages.select("page_id", digest, F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("n")))
    narrow = every.where(F.col("n") >= LEAST_REVISIT)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")) \
        .where("c > 1").drop("c")
    notes = narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))) \
        .select("page_id", "digest", "refers_to").distinct()
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    weights = materialize(every.groupBy(key.alias("k")).agg(F.sum(F.col("n") + RECORD_BYTES).alias("w")))
    if shard_bytes is None:
        total = weights.agg(F.sum("w")).first()[0] or 0
        shard_bytes = max(SHARD_BYTES[0], min(SHARD_BYTES[1], total // 64))
    dealt, shards = deal_ranges(weights, shard_bytes)
    nothing = F.lit(None).cast("string")
    both = pages.select("page_id", digest, F.lit(False).alias("note"), F.lit(None).cast("bigint").alias("refers_to"),
                        "url", "html") \
        .unionByName(notes.select("page_id", "digest", F.lit(True).alias("note"), "refers_to",
                                  nothing.alias("url"), nothing.alias("html")))
    at = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("double") / float(1 << 32)
    both = dealt(both.withColumns({"k": key, "at": at})).drop("k", "at").withColumnRenamed("range", "shard")
    ordered = both.repartitionById(shards, "shard").sortWithinPartitions("page_id", "digest", F.desc("note"), "url")
    store.create_dir(base, recursive=True)
    ordered.mapInArrow(_write(folder, roll_bytes), MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    release(every, weights)
    return finish_warc(spark, folder)


def finish_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Renames what the manifest of `folder` lists and is not yet renamed, then
    deletes the temporary files that failed tasks left; returns the manifest.
    May be called any number of times.  Without a whole manifest: an error, as
    the files are to be written again."""
    from pyarrow import fs

    manifest = spark.read.parquet(f"{folder}/_manifest")
    manifest.mapInArrow(_commit(folder), "file string").write.format("noop").mode("overwrite").save()
    store, base = _store(folder)
    for info in store.get_file_info(fs.FileSelector(base)):
        if info.type == fs.FileType.File and info.base_name.startswith("_tmp-"):
            store.delete_file(info.path)
    return manifest


READ = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, sound boolean, file string")


def parse(data: bytes):
    """(headers, block) of each record of an archive's bytes."""
    z = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := z.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := z.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, z.read(int(head["content-length"]))


def _read(batches):
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names)

    number = lambda x: int(x) if x else None
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows = []
            for head, block in parse(data.as_py()):
                kind = head["warc-type"]
                b32 = head["warc-payload-digest"].removeprefix("sha256:")
                digest = base64.b32decode(b32 + "=" * (-len(b32) % 8)).hex()
                sound = _b32(hashlib.sha256(block).hexdigest()) == head["warc-block-digest"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    sound = sound and hashlib.sha256(payload).hexdigest() == digest \
                        and len(payload) == int(head["x-payload-length"])
                rows.append((number(head["x-page-id"]), head["warc-target-uri"], int(head["x-payload-length"]), digest,
                             kind, number(head.get("x-refers-to-page")), sound, path.rpartition("/")[2]))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's committed files, one row per record; `sound` says
    whether content, lengths and digests agree.  An empty archive gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    return files.select("path", "content").mapInArrow(_read, READ)

