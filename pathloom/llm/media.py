"""Media columns: texts as lossless FLAC streams, read back with checks.

Every document's payload (its UTF-8 bytes, padded with zeros to a positive
multiple of 64) is stored as 8-bit mono PCM. Frames of many documents are coded
together, a bounded number of samples at a time, so a long text costs no more
memory for its coding than a short one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, text_or_empty
from .flac import BLOCK, decode_frames, encode_frames, read_header, write_stream

UNIT = 64
CHUNK = 1 << 20


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def encode_streams(payloads: list[bytes], **options) -> list[bytes]:
    """One FLAC stream for each payload; sample = byte - 128."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    lengths = [[min(BLOCK, len(p) - a) for a in range(0, len(p), BLOCK)] for p in payloads]
    jobs = [(i, f, n) for i, row in enumerate(lengths) for f, n in enumerate(row)]
    start = 0
    while start < len(jobs):
        end, total = start, 0
        while end < len(jobs) and (end == start or total + jobs[end][2] <= CHUNK):
            total += jobs[end][2]
            end += 1
        some = jobs[start:end]
        raw = b"".join(payloads[i][f * BLOCK : f * BLOCK + n] for i, f, n in some)
        data, at = encode_frames((np.frombuffer(raw, dtype=np.uint8) ^ 0x80).view(np.int8), np.array([n for *_, n in some]), np.array([f for _, f, _ in some]), **options)
        cuts = at.tolist()
        for (i, _, _), a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
            frames[i].append(data[a:b])
        start = end
    return [write_stream(f, n, (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()) for f, n, p in zip(frames, lengths, payloads, strict=True)]


def decode_streams(streams: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """Payload and frames' sample offsets of each stream; ValueError on any
    damaged header, frame or audio."""
    heads = [read_header(s) for s in streams]
    pieces: list[list[bytes]] = [[] for _ in streams]
    offsets: list[list[int]] = [[] for _ in streams]
    jobs = []
    for i, h in enumerate(heads):
        if h.points is not None:
            ends = np.append(h.points[1][1:], len(streams[i]) - h.audio)
            jobs += [(i, h.audio + a, h.audio + b, s) for s, a, b in zip(h.points[0].tolist(), h.points[1].tolist(), ends.tolist(), strict=True)]
        elif h.total:
            jobs.append((i, h.audio, None, 0))
    while jobs:
        later, start = [], 0
        while start < len(jobs):
            end, total, parts, at = start, 0, [], []
            while end < len(jobs) and (end == start or total <= CHUNK):
                i, a, b, _ = jobs[end]
                part = streams[i][a:b] if b else streams[i][a : a + (1 << 18)]
                at.append(total)
                total += len(part)
                parts.append(part)
                end += 1
            got = decode_frames(b"".join(parts), np.array(at))
            if not got.ok.all():
                raise ValueError(f"stream {jobs[start + int(np.flatnonzero(~got.ok)[0])][0]}: a frame fails its checksum")
            pcm = (got.samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
            cut = np.concatenate([[0], np.cumsum(got.lengths)]).tolist()
            for k, (i, a, b, sample) in enumerate(jobs[start:end]):
                pieces[i].append(pcm[cut[k] : cut[k + 1]])
                offsets[i].append(sample)
                done = sample + int(got.lengths[k])
                if b is None and done < heads[i].total:
                    later.append((i, a + int(got.ends[k]) - at[k], None, done))
            start = end
        jobs = later
    out = []
    for i, (h, p) in enumerate(zip(heads, pieces, strict=True)):
        raw = b"".join(p)[: h.total]
        if len(raw) != h.total or h.md5 != bytes(16) and hashlib.md5((np.frombuffer(raw, dtype=np.uint8) ^ 0x80).tobytes()).digest() != h.md5:
            raise ValueError(f"stream {i}: the audio differs from its MD5")
        out.append((raw, offsets[i]))
    return out


def feature(raw: bytes) -> str:
    """Energy, peak and zero crossings of the audio."""
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) - 128
    return f"energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def stored_media(docs: DataFrame, *carried: str, text: str = "text", column: str = "media") -> DataFrame:
    """The carried columns and the FLAC stream of each text. Null is empty.

    Each row stands for itself: repeated rows are stored each, equal texts have
    equal streams, an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([m for some in _some(texts) for m in encode_streams([payload(t) for t in some])], pa.binary())

    return docs.select(*carried, encode(text_or_empty(text)).alias(column))


def _some(column: pa.Array, rows: int = 512):
    for start in range(0, len(column), rows):
        yield column.slice(start, rows).to_pylist()


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Rows (doc_id, block, sample_offset, n_samples, pcm) of FLAC streams: unsigned
    8-bit blocks that begin at their seekable sample offset. A null stream has
    no block; a damaged one raises ValueError."""
    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids, streams = part.column(0).to_pylist(), part.column(1).to_pylist()
                have = [i for i, s in enumerate(streams) if s is not None]
                rows = []
                for i, (raw, offsets) in zip(have, decode_streams([streams[i] for i in have]), strict=True):
                    ends = [*offsets[1:], len(raw)]
                    rows += [(ids[i], b, s, e - s, raw[s:e]) for b, (s, e) in enumerate(zip(offsets, ends, strict=True))]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.select(F.col(key).cast("long"), F.col(column)).mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def described(media: DataFrame, *carried: str, column: str = "media") -> DataFrame:
    """The carried columns and payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, n_blocks and last_offset (PCM blocks and
    the sample at which the last begins), all from the stored bytes read back.

    Each row stands for itself: repeated rows and equal streams give equal
    values, an empty table an empty result. A damaged stream raises ValueError.
    """
    ship(media.sparkSession)

    @F.arrow_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_offset long")
    def read(column: pa.Array) -> pa.Array:
        rows = []
        for streams in _some(column):
            for media, (raw, offsets) in zip(streams, decode_streams(streams), strict=True):
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(raw), len(offsets), int(offsets[-1])))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_offset"])

    return media.select(*carried, read(F.col(column)).alias("read")).select(*carried, "read.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"))
    return described(stored_media(docs, "doc_id", "n_bytes"), "doc_id", "n_bytes")
