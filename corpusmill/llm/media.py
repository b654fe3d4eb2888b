"""Media columns: telephony audio.

Codes of one byte are expanded by lookup tables (mu-law, A-law), IMA ADPCM blocks are decoded with
numpy step by step across all blocks at once, and the PCM is resampled and stored as WAV bytes.
Everything is integer arithmetic, so equal bytes give equal samples everywhere.

``encode_text`` stores any text as a mu-law WAV file of 8 kHz, one sample a byte; null is empty,
and the payload is padded with bytes 0 to a positive multiple of 64.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bytesets

RATE = 8000
BLOCK = 64
MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1

# The index steps of IMA ADPCM and its table of 89 step sizes.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code: inverted bits, a sign, a chord of 3 bits and a step of 4."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code: every second bit is inverted; chord 0 is linear."""
    code = np.arange(256) ^ 0x55
    step, chord = (code & 15) << 4, code >> 4 & 7
    size = np.where(chord == 0, step + 8, step + 264 << np.maximum(chord - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_MULAW, _ALAW = mulaw_table(), alaw_table()

#: For each (index, nibble): the signed difference, and the index that follows.
_NIBBLE = np.arange(16)
_SIZES = STEP_SIZES[:, None]
_DIFF = (_SIZES >> 3) + np.where(_NIBBLE & 4, _SIZES, 0) + np.where(_NIBBLE & 2, _SIZES >> 1, 0) + np.where(_NIBBLE & 1, _SIZES >> 2, 0)
_DIFF = np.where(_NIBBLE & 8, -_DIFF, _DIFF).astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + INDEX_STEPS[_NIBBLE & 7], 0, 88) * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks, ``(n, size)`` bytes, to ``(n, 2 * (size - 4) + 1)`` samples.

    A block starts with its first sample (16 bits), its index (over 88 counts as 88) and a spare
    byte; the rest are nibbles, low one first.
    """
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(size - 4):
        for half, nibble in ((1, codes[k] & 15), (2, codes[k] >> 4)):
            at = state + nibble
            value += _DIFF[at]
            np.clip(value, -32768, 32767, out=value)
            out[2 * k + half] = value
            state = _NEXT[at]
    return out.T


def resample_double(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; each run from ``starts`` holds its last sample."""
    after = np.empty_like(pcm)
    after[:-1] = pcm[1:]
    after[-1:] = pcm[-1:]
    last = np.append(starts[1:], len(pcm)) - 1
    after[last] = pcm[last]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def wav(kind: int, rate: int, bits: int, data: bytes, block: int = 1, more: bytes = b"") -> bytes:
    """A mono RIFF file around ``data``."""
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * bits // 8, block, bits) + more
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format code, rate, block size and data of a mono RIFF file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind, rate, block = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return kind, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def expand(kind: int, data: bytes, block: int = BLOCK) -> np.ndarray:
    """PCM samples of the data of a WAV file."""
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return _MULAW[raw]
    if kind == ALAW:
        return _ALAW[raw]
    if kind == ADPCM:
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if kind == PCM:
        return np.frombuffer(data[: len(data) & ~1], "<i2")
    raise ValueError(f"format {kind} isn't read")


def to_pcm16k(media: bytes) -> bytes:
    """Any of the formats, at 8 kHz, as a PCM WAV file of 16 kHz."""
    kind, rate, block, data = parse_wav(media)
    pcm = expand(kind, data, block)
    pcm = resample_double(pcm, np.zeros(1, np.int64)) if len(pcm) else pcm
    return wav(PCM, 2 * rate, 16, pcm.astype("<i2").tobytes(), 2)


def encode_text(raw: bytes) -> bytes:
    """The mu-law WAV file that holds ``raw`` and its padding."""
    return wav(MULAW, RATE, 8, raw + b"\0" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0))


def _features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """A string of integer features of each payload and its stored PCM, many at once."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    wide = np.frombuffer(b"".join(pcm), "<i2")
    mu, al = wide[0::2], _ALAW[raw]  # every second sample of the PCM is one of the payload's own
    ad = decode_adpcm(raw.reshape(-1, BLOCK))
    per = ad.shape[1]
    flips = np.zeros(len(mu), np.int64)
    flips[1:] = (mu[1:] ^ mu[:-1]) < 0
    flips[starts] = 0
    energy = np.add.reduceat(np.square(mu.astype(np.int64)), starts)
    a_energy = np.add.reduceat(np.abs(al.astype(np.int64)), starts)
    crossings = np.add.reduceat(flips, starts)
    high, low = np.maximum.reduceat(mu, starts), np.minimum.reduceat(mu, starts)
    out = []
    for k, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        blocks = zlib.crc32(np.ascontiguousarray(ad[at // BLOCK : (at + n) // BLOCK]).data)
        out.append(f"mulaw:energy={energy[k]},cross={crossings[k]},max={high[k]},min={low[k]};alaw:abs={a_energy[k]};pcm16k:n={2 * n},crc={zlib.crc32(pcm[k]):08x};adpcm:n={n // BLOCK * per},crc={blocks:08x}")
    return out


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in bytesets.texts(batch.column(1)):
            media = [encode_text(t.data[a:b].tobytes()) for a, b in zip(t.starts.tolist(), t.ends.tolist(), strict=True)]
            ids = batch.column(0).slice(int(t.rows[0]), len(t.rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(t.ends - t.starts), pa.array(media, pa.binary()), pa.array([to_pcm16k(m) for m in media], pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])


def text_media(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as media columns: ``doc_id, n_bytes, media`` (mu-law) and ``pcm`` (16 kHz).

    Every row is stored by itself, whatever its id; null and empty texts are 64 bytes 0.  A text's PCM
    has four times its bytes and must fit one value, so texts end at half a GB.
    """
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary, pcm binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * bytesets.CHUNK, "right")))
            part = batch.slice(at, to - at)
            at = to
            media = part.column(2).to_pylist()
            payloads = [parse_wav(m)[3] for m in media]
            rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()) for p, m in zip(payloads, media, strict=True)]
            feature = _features(payloads, [parse_wav(m)[3] for m in part.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c)) for c in zip(*rows, strict=True)], pa.array(feature)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(media: DataFrame) -> DataFrame:
    """The columns of :data:`SCHEMA` from the stored columns of :func:`text_media`, read back."""
    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(_digests, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
