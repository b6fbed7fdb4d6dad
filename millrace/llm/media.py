"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV files, expanded with numpy and stored as resampled 16-bit PCM.

Mu-law and A-law samples expand by lookup tables. ADPCM blocks are independent, so the decoder takes one nibble
of every block of a batch at a time; its two state updates are table lookups too. Expanded audio is resampled by
an integer polyphase filter, from any rate to any (a narrower filter where the rate falls), and stored as PCM WAV.

As a media column for texts: the UTF-8 bytes, padded with spaces to a positive multiple of 192, are the codes of
such a file (an ADPCM block carries 192 of them); the crc of the bytes picks the codec, so equal texts give equal
files. The stored file is parsed again, the codes come back unchanged, and the PCM file of it is described too.

Defined results: a null text counts as empty and is stored as 192 spaces; long texts are resampled in chunks;
repeated rows and null ids go through as they are; bytes that are no known WAV file, or of a sampling rate outside
RATES, decode to null; a file without samples decodes to one without samples; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from math import ceil, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, documents

RATE, RATE_OUT, UNIT = 8000, 16000, 192
#: Sampling rates that are read, in Hz.
RATES = range(1000, 384_001)
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 17}

# The step sizes and index moves of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype("<i2")


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, size = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, size + 8, size + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype("<i2")


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By (step index * 16 + code): what the predictor gains, and the next step index * 16."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None]
    gain = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    follow = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES * 2)[None], 0, len(STEPS) - 1)
    return np.where(code & 8, -gain, gain).ravel().astype(np.int32), (follow * 16).ravel().astype(np.int32)


MULAW, ALAW = _mulaw_table(), _alaw_table()
GAIN, FOLLOW = _adpcm_tables()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Rows are blocks (4 header bytes, then codes, low nibble first); returns a row of samples for each."""
    head = np.ascontiguousarray(blocks[:, :4])
    level = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(codes) + 1, len(blocks)), "<i2")
    out[0] = level
    for k, byte in enumerate(codes):
        for half, code in ((1, byte & 15), (2, byte >> 4)):
            at = state + code
            level += GAIN[at]
            np.clip(level, -32768, 32767, out=level)
            state = FOLLOW[at]
            out[2 * k + half] = level
    return np.ascontiguousarray(out.T)


def wrap(payload: bytes, codec: str) -> bytes:
    """A WAV file whose codes are payload (for ADPCM a multiple of UNIT bytes)."""
    if codec == "adpcm":
        data = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        data[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        body, per = data.tobytes(), 2 * UNIT + 1
        form = struct.pack("<HHIIHHHH", 17, 1, RATE, RATE * (UNIT + 4) // per, UNIT + 4, 4, 2, per)
        samples = len(data) * per
    else:
        body, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", CODECS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", body)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def pcm_file(samples: np.ndarray, rate: int = RATE_OUT) -> bytes:
    body = samples.astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(form) + 8 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, int, np.ndarray] | None:
    """Codec, rate and data of a telephony WAV file; ADPCM data as rows of blocks. None if it is no such file."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            data = np.frombuffer(media, np.uint8, min(n, len(media) - at - 8), at + 8)
        at += 8 + n + (n & 1)
    codec = next((k for k, v in CODECS.items() if form and v == form[0]), None)
    if codec is None or data is None or form[1] != 1 or form[2] not in RATES:
        return None
    if codec == "adpcm":
        if form[4] <= 4:
            return None
        data = data[: len(data) // form[4] * form[4]].reshape(-1, form[4])
    return codec, form[2], data


def payload_of(codec: str, data: np.ndarray) -> bytes:
    return (data[:, 4:] if codec == "adpcm" else data).tobytes()


def expand(codec: str, data: np.ndarray) -> np.ndarray:
    if codec == "adpcm":
        return adpcm_blocks(data).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[data]


def _filter(up: int, down: int = 1) -> np.ndarray:
    """Integer phases of a windowed sinc, each summing to 2 ** 14; row p interpolates p / up of the way to the next sample."""
    band = min(1.0, up / down)  # what is left of the band
    taps = 2 * ceil(4 / band)
    k = np.arange(taps) - (taps // 2 - 1)
    t = k[None] - np.arange(up)[:, None] / up
    h = np.sinc(t * band) * np.cos(np.pi * t / (taps + 2)) ** 2
    h = np.rint(h / h.sum(1, keepdims=True) * (1 << 14)).astype(np.int64)
    h[np.arange(up), np.abs(h).argmax(1)] += (1 << 14) - h.sum(1)
    return h


def resample(samples: np.ndarray, rate: int, rate_out: int = RATE_OUT, chunk: int = 1 << 19):
    """Yields the samples at rate_out, chunk by chunk: sample j lies j * rate / rate_out input samples from the start, as long as that is before the last one's end."""
    if rate not in RATES or rate_out not in RATES:
        raise ValueError(f"sampling rates go from {RATES[0]} to {RATES[-1]} Hz")
    common = gcd(rate, rate_out)
    up, down = rate_out // common, rate // common
    h = _filter(up, down)
    taps = h.shape[1]
    fits = np.abs(h).sum(1).max() <= 1 << 15  # then sums of samples times taps stay within 31 bits
    h = h.astype(np.int32) if fits else h
    before, after = taps // 2 - 1, taps // 2
    total = -(-len(samples) * up // down)
    step = max(1, chunk // down) * up  # outputs of a chunk begin at an input sample
    for first in range(0, total, step):
        last = min(total, first + step)
        a, b = first * down // up, min(len(samples), (last - 1) * down // up + 1)
        part = np.pad(samples[max(0, a - before) : b + after].astype(h.dtype), (max(0, before - a), max(0, b + after - len(samples))), "edge")
        if down == 1:
            out = np.empty((b - a, up), h.dtype)
            for p in range(up):
                out[:, p] = sum((part[j : j + b - a] * h[p, j] for j in range(taps) if h[p, j]), np.full(b - a, 1 << 13, h.dtype)) >> 14
        else:
            at = np.arange(first, last, dtype=np.int64) * down
            place, phase = at // up - a, at % up
            out = np.full(last - first, 1 << 13, h.dtype)
            for j in range(taps):
                out += part[place + j] * h[phase, j]
            out >>= 14
        yield np.clip(out, -32768, 32767).astype("<i2").ravel()


def features(codec: str, samples: np.ndarray, pcm: np.ndarray) -> str:
    """Codec, length, root mean square, peak and sign changes of the audio; length and crc32 of the resampled PCM."""
    n = len(samples)
    wide = samples.astype(np.int64)
    rms, peak = isqrt(int(np.dot(wide, wide)) // max(n, 1)), int(np.abs(wide).max(initial=0))
    turns = int(np.count_nonzero(np.signbit(samples[1:]) != np.signbit(samples[:-1])))
    return f"{codec};n={n};rms={rms};peak={peak};turns={turns};out={len(pcm)};pcm={zlib.crc32(pcm.tobytes()):08x}"


def resampled(samples: np.ndarray, rate: int, rate_out: int = RATE_OUT) -> np.ndarray:
    return np.concatenate([*resample(samples, rate, rate_out), np.zeros(0, "<i2")])


def text_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def codec_for(payload: bytes) -> str:
    return list(CODECS)[zlib.crc32(payload) % len(CODECS)]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a telephony file."""

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads = [text_payload(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in payloads], pa.int64()), pa.array([wrap(p, codec_for(p)) for _, p in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(_texts(docs, id_col, text_col), store, "doc_id long, n_bytes long, media binary")


def decode_media(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate_out: int = RATE_OUT) -> DataFrame:
    """doc_id, pcm: each telephony file as a resampled PCM file, or null. ADPCM blocks of a batch decode together."""

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [parse(m) for m in batch.column("media").to_pylist()]
        pcm = [None if x is None else pcm_file(resampled(s, x[1], rate_out), rate_out) for x, s in zip(parsed, _expanded(parsed), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pcm, pa.binary())], ["doc_id", "pcm"])

    return arrow_map(files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), decode, "doc_id long, pcm binary", "media")


def _expanded(parsed: list) -> list[np.ndarray | None]:
    """Samples of each parsed file; ADPCM files of one block size are decoded in one go, a few thousand blocks at a time."""
    out: list = [None if x is None else expand(x[0], x[2]) if x[0] != "adpcm" else None for x in parsed]
    for width in {x[2].shape[1] for x in parsed if x is not None and x[0] == "adpcm"}:
        own = [k for k, x in enumerate(parsed) if x is not None and x[0] == "adpcm" and x[2].shape[1] == width]
        blocks = np.concatenate([parsed[k][2] for k in own])
        samples = np.concatenate([adpcm_blocks(blocks[a : a + 4096]) for a in range(0, len(blocks), 4096)] or [np.zeros((0, 2 * width - 7), "<i2")])
        at = 0
        for k in own:
            n = len(parsed[k][2])
            out[k] = samples[at : at + n].ravel()
            at += n
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, parses the stored file again, stores its audio as PCM, and describes all three, in one pass."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_payload(t) for t in batch.column("text").to_pylist()]
        media = [wrap(p, codec_for(p)) for _, p in texts]
        parsed = [parse(m) for m in media]
        rows = []
        for doc_id, (n, _), m, (codec, rate, data), samples in zip(batch.column("doc_id").to_pylist(), texts, media, parsed, _expanded(parsed), strict=True):
            back, pcm = payload_of(codec, data), resampled(samples, rate)
            file = pcm_file(pcm)
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(codec, samples, pcm), len(file), hashlib.sha256(file).hexdigest()))
        kinds = [x.split() for x in _DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return arrow_map(_texts(docs, id_col, text_col), digest, _DIGESTS)


def op8(spark, sf_dir):
    return media_digests(documents(spark, sf_dir))
