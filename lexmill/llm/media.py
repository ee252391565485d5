"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has given bits zero, so a cut
depends on nearby content only and shared stretches give equal chunks.  The stored form of a
payload is its ordered chunk list (a manifest of digests and lengths) and the chunks it names.
Both are written: the lists as a table, and each distinct chunk once, compressed, in a Parquet
table bucketed by digest, so that reading joins the lists with it without moving a chunk before
it is needed.  Reading puts the chunks in order and verifies every digest and length.

Equal payloads have equal manifests, so reading reconstructs each distinct manifest once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import Mapper, columns_of, map_texts
from .runtime import bucketed, staged

MAGIC = b"CDC1"
#: Smallest and largest chunk in bytes; a cut needs CUT_BITS zero bits, so chunks have about
#: LEAST + 2**CUT_BITS bytes.
LEAST, MOST, CUT_BITS = 4096, 65536, 12
#: Effort of the compression of a chunk.
LEVEL = 19
UNIT = 64


def _gear() -> np.ndarray:
    """One fixed pseudo-random word for each byte value, from a digest of it."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % b).digest()[:4], "big") for b in range(256)], np.uint32)


_GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of gear(data[i - j]) << j for j < 32, by doubling the window five times."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            moved = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += moved
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: the first boundary at least LEAST after the last cut, MOST at latest."""
    if len(data) <= LEAST:
        return [len(data)]
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    while len(data) - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[i]) if i < len(marks) else len(data), at + MOST, len(data))
        out.append(end)
        at = end
    if at < len(data):
        out.append(len(data))
    return out


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def manifest_of(digests: list[bytes], lengths: list[int]) -> bytes:
    return MAGIC + struct.pack(">I", len(lengths)) + b"".join(struct.pack(">I", n) + d for n, d in zip(lengths, digests))


def parse_manifest(manifest: bytes) -> list[tuple[int, bytes]]:
    """(length, digest) of each chunk; ValueError unless it is a whole manifest."""
    if manifest[:4] != MAGIC or len(manifest) != 8 + 36 * (n := struct.unpack(">I", manifest[4:8])[0]):
        raise ValueError("not a chunk list")
    return [(struct.unpack(">I", manifest[8 + 36 * i : 12 + 36 * i])[0], manifest[12 + 36 * i : 44 + 36 * i]) for i in range(n)]


#: A digest in this share of the list entries or more is read by broadcast: at most 1 / HOT chunks
#: of at most MOST bytes each (13 MB), however large the store.
HOT = 0.005


@dataclass
class MediaStore:
    """Written tables: rows (id, n_bytes, media_id, n_chunks); lists (media_id, seq, digest, length,
    n_chunks), one set for each distinct manifest; chunks (digest, data), each digest once, compressed."""

    rows: DataFrame
    lists: DataFrame
    chunks: DataFrame


def _mapped(df: DataFrame, id_col: str, text_col: str, one: Callable[[int, list[bytes], list[bytes]], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``one`` makes of (bytes of the text, parts of its payload, their digests)."""

    def setup() -> Mapper:
        def mapper(texts: list[str | None]) -> tuple[list[int], list]:
            rows, out = [], []
            for i, text in enumerate(texts):
                data = payload_of(text)
                ends = cuts(data)
                parts = [data[a:b] for a, b in zip([0, *ends], ends)]
                found = one(len((text or "").encode("utf-8", "surrogatepass")), parts, [hashlib.sha256(p).digest() for p in parts])
                rows += [i] * len(found)
                out += found
            return rows, columns_of(out, len(schema.split(", ")))

        return mapper

    return map_texts(df, id_col, text_col, setup, schema)


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MediaStore:
    """Cut every payload and write the store: each distinct chunk and each distinct manifest once.

    A null text is an empty one: a payload of UNIT zero bytes.  Repeated rows share chunks
    and manifest.  Only the two columns are read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def listed(n: int, parts: list[bytes], digests: list[bytes]) -> list[tuple]:
        media = hashlib.sha256(manifest_of(digests, [len(p) for p in parts])).digest()
        return [(n, media, len(parts), k, d, len(p)) for k, (p, d) in enumerate(zip(parts, digests))]

    places = staged(_mapped(docs, "doc_id", "text", listed, "n_bytes long, media_id binary, n_chunks int, seq int, digest binary, length int"), "media-places")

    def packed(n: int, parts: list[bytes], digests: list[bytes]) -> list[tuple]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        return [(d, pack(p)) for p, d in zip(parts, digests)]

    data = _mapped(docs, "doc_id", "text", packed, "digest binary, data binary").select("digest", "data")
    once = data.groupBy("digest").agg(F.first("data").alias("data"))
    chunks = bucketed(once, "media-chunks", "digest", compression="none")
    rows = places.where("seq = 0").select(F.col("doc_id").alias(id_col), "n_bytes", "media_id", "n_chunks")
    lists = staged(places.select("media_id", "seq", "digest", "length", "n_chunks").distinct(), "media-lists")
    return MediaStore(rows, lists, chunks)


def _stored(store: MediaStore) -> DataFrame:
    """The list entries, each with its chunk as stored.  Chunks that very many lists share are
    broadcast; for the others the lists go to the chunks' buckets."""
    often = store.lists.groupBy("digest").count().where(F.col("count") >= F.lit(max(2.0, HOT * store.lists.count())))
    hot = [bytes(r.digest) for r in often.collect()]  # at most 1 / HOT digests
    if not hot:
        return store.lists.hint("shuffle_hash").join(store.chunks, "digest")
    shared = F.col("digest").isin(*map(F.lit, hot))
    few = store.lists.where(shared).join(F.broadcast(store.chunks.where(shared)), "digest")
    return few.unionByName(store.lists.where(~shared).hint("shuffle_hash").join(store.chunks, "digest"))


def _read_back(parts: list[tuple[int, bytes, int, bytes]]) -> tuple:
    """Verify and join the stored chunks of one medium: its digests and features."""
    parts, whole = sorted(parts, key=lambda p: p[0]), []
    unpack = zstandard.ZstdDecompressor().decompress
    manifest = manifest_of([p[1] for p in parts], [p[2] for p in parts])
    stored = hashlib.sha256(manifest)
    for k, (seq, digest, length, data) in enumerate(parts):
        part = unpack(data)
        if seq != k or len(part) != length or hashlib.sha256(part).digest() != digest:
            raise ValueError("a stored chunk doesn't match its list")
        whole.append(part)
        stored.update(data)
    payload = b"".join(whole)
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    feature = f"chunks={len(parts)};mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};peak={int(samples.max())}"
    return (hashlib.sha256(manifest).digest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
            len(manifest) + sum(len(p[3]) for p in parts), stored.hexdigest(), feature)


_MEDIA = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(store: MediaStore) -> DataFrame:
    """(media_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)
    of each distinct manifest, from its chunks as stored.

    The stored form is the manifest and its chunks in order: ``media_bytes`` counts and
    ``media_sha256`` hashes all of it.  A medium of one chunk is read where the join leaves it;
    only longer ones are brought together by their id.
    """
    joined = _stored(store)

    def single(batches):
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = [_read_back([x]) for x in zip(c["seq"], c["digest"], c["length"], c["data"])]
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=fields)

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(names, _read_back(list(zip(*(table.column(n).to_pylist() for n in ("seq", "digest", "length", "data")))))))], schema=fields)

    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _MEDIA.split(", ")])
    names = fields.names
    wanted = joined.select("media_id", "seq", "digest", "length", "data", "n_chunks")
    short = wanted.where("n_chunks = 1").mapInArrow(single, _MEDIA)
    long = wanted.where("n_chunks > 1").groupBy("media_id").applyInArrow(whole, _MEDIA)
    return short.unionByName(long)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, with the features of its payload as read back.  Equal texts have
    equal values; an empty table gives an empty result.

    A medium that very many rows share is a skewed key of the last join, whose rows are a few
    bytes; both of its sides are shuffled, so adaptive execution splits such a partition.
    """
    store = write_media(df, id_col, text_col)
    media = read_media(store)
    return store.rows.join(media, "media_id").drop("media_id", "n_chunks")
