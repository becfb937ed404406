"""Media columns: AVI files of motion-JPEG frames in a binary column.

A payload is stored as 8-bit grey samples, 64 to a row, in frames of the lossless JPEG process (SOF3, predictor 1,
one restart interval a row), each an intra frame of a RIFF AVI file with an index.  Reading parses the RIFF lists and
the index, decodes every frame, and finds shots where the histogram difference of two frames exceeds a bound that
adapts to the differences before it.  Rows of samples are independent, so a batch decodes all its rows together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernels import slices, text_buffer

WIDTH = 64
#: Bits of the Huffman code of each difference category 0 to 8, of one table for all files.
CODE_BITS = (4, 4, 3, 3, 3, 3, 4, 3, 5)


@dataclass(frozen=True)
class ShotRules:
    """A cut: the difference (0 to 1) is over `floor` and over mean + `spread` standard deviations since the last cut."""

    rows_a_frame: int = 32
    frames_a_second: int = 25
    floor: float = 0.15
    spread: float = 2.0
    bins: int = 16


def _codes() -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(code by category, bits by category, categories in code order), canonical."""
    order = sorted(range(9), key=lambda c: (CODE_BITS[c], c))
    codes, code, last = np.zeros(9, np.uint32), 0, CODE_BITS[order[0]]
    for c in order:
        code <<= CODE_BITS[c] - last
        last = CODE_BITS[c]
        codes[c] = code
        code += 1
    return codes, np.array(CODE_BITS, np.uint32), order


_CODE, _BITS, _ORDER = _codes()
_CATEGORY = np.array([0] + [int(v).bit_length() for v in range(1, 256)])
_D = np.arange(-255, 256)
_DC = _CATEGORY[abs(_D)]
#: By difference + 255: the code with its extra bits, and how many bits that is.
_SYMBOL = (_CODE[_DC].astype(np.uint64) << _DC.astype(np.uint64)) | np.where(_D >= 0, _D, _D + (1 << _DC) - 1).astype(np.uint64)
_LENGTH = (_BITS[_DC] + _DC).astype(np.int64)


def _pack_rows(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded, byte-stuffed bits of each row of samples (rows x 64)."""
    rows = len(samples)
    left = np.concatenate([np.full((rows, 1), 128, np.int16), samples[:, :-1].astype(np.int16)], 1)
    at = (samples.astype(np.int16) - left + 255).ravel()
    value, length = _SYMBOL[at], _LENGTH[at]
    ends = np.cumsum(length.reshape(rows, WIDTH), 1)
    size = (ends[:, -1] + 7) // 8
    begin = np.cumsum(size) - size
    start = (ends - length.reshape(rows, WIDTH) + begin[:, None] * 8).ravel()
    total = int(size.sum())
    # each symbol (at most 16 bits) lies in 4 bytes from its first; sums of disjoint bits are exact
    word = value << (32 - (start & 7) - length).astype(np.uint64)
    out = np.zeros(total + 4, np.uint64)
    first = start >> 3
    for k in range(3):
        out += np.bincount(first + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(float), minlength=total + 4)[: total + 4].astype(np.uint64)
    out = out[:total]
    spare = (size * 8 - ends[:, -1]).astype(np.uint64)
    out[begin + size - 1] += (np.uint64(1) << spare) - np.uint64(1)  # filled with ones
    data = out.astype(np.uint8)
    stuffed = np.flatnonzero(data == 255)
    full = np.insert(data, stuffed + 1, 0) if len(stuffed) else data
    cut = begin + np.searchsorted(stuffed, begin)
    blob = full.tobytes()
    edges = [*cut.tolist(), len(blob)]
    return [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_TABLE = b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + bytes(sum(b == n for b in CODE_BITS) for n in range(1, 17)) + bytes(_ORDER)


def _frame(rows: list[bytes]) -> bytes:
    """One lossless JPEG image of the rows."""
    head = b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, len(rows), WIDTH, 1, 1, 0x11, 0) + _TABLE
    head += b"\xff\xdd" + struct.pack(">HH", 4, WIDTH) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 1, 0, 0)
    body = [rows[0]]
    for i, r in enumerate(rows[1:]):
        body += [b"\xff", bytes([0xD0 + i % 8]), r]
    return head + b"".join(body) + b"\xff\xd9"


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _avi(frames: list[bytes], height: int, payload: int, rules: ShotRules) -> bytes:
    micros = 1_000_000 // rules.frames_a_second
    most = max(map(len, frames))
    avih = struct.pack("<14I", micros, most * rules.frames_a_second, 0, 0x10, len(frames), 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rules.frames_a_second, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % payload)
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
        movi.append(c)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def encode_payloads(data: np.ndarray, offsets: np.ndarray, rules: ShotRules = ShotRules()) -> list[bytes]:
    """An AVI file for each document; its payload is the bytes with zeros up to a positive multiple of 64."""
    size = np.diff(offsets)
    rows = np.maximum(1, -(-size // WIDTH))
    frames = -(-rows // rules.rows_a_frame)
    height = -(-rows // frames)
    need = frames * height  # rows with those that fill the last frame
    begin = np.cumsum(need) - need
    flat = np.zeros(int(need.sum()) * WIDTH, np.uint8)
    flat[np.arange(len(data)) + np.repeat(begin * WIDTH - offsets[:-1], size)] = data
    coded = _pack_rows(flat.reshape(-1, WIDTH))
    out = []
    for b, n, h, r in zip(begin.tolist(), frames.tolist(), height.tolist(), rows.tolist(), strict=True):
        out.append(_avi([_frame(coded[b + k * h : b + (k + 1) * h]) for k in range(n)], h, r * WIDTH, rules))
    return out


def _lists(data: bytes, at: int, end: int):
    """(name, first byte, end) of the RIFF chunks between two places."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], int, int | None, float]:
    """((first byte, end) of each intra frame by the index, height, payload bytes (None: all), frames a second)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, height, payload, rate = 0, [], 0, None, 1.0
    for name, a, b in _lists(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[a : a + 4]
        if name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(a, b, 16)]
        elif name == b"LIST" and kind == b"movi":
            movi = a
        elif name == b"LIST" and kind == b"INFO":
            payload = next((int(data[x:y].rstrip(b"\0").split(b"=")[1]) for n, x, y in _lists(data, a + 4, b) if n == b"ICMT" and data[x : x + 8] == b"payload="), None)
        elif name == b"LIST" and kind == b"hdrl":
            for n, x, _ in _lists(data, a + 4, b):
                if n == b"avih":
                    head = struct.unpack_from("<14I", data, x)
                    height, rate = head[9], 1e6 / head[0]
    return [(movi + at + 8, movi + at + 8 + n) for name, flags, at, n in index if name == b"00dc" and flags & 0x10], height, payload, rate


@lru_cache(maxsize=64)
def _header(head: bytes) -> tuple[int, int, bytes]:
    """(rows, samples a row, Huffman table) of the segments of a frame, from SOI to the scan's own header.

    ValueError for anything but the lossless process with one component of 8 bits, predictor 1 and a restart a row.
    """
    at, sof, table, restart, scan = 2, None, None, 0, None
    while at < len(head):
        kind, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if kind == 0xC4:
            if body[0] or table or len(body) != 17 + sum(body[1:17]):
                raise ValueError("not one Huffman table with number 0")
            table = body[1:]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            scan = body
        elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
            sof = (kind, *struct.unpack_from(">BHHB", body))
        at += 2 + size
    if head[:2] != b"\xff\xd8" or sof is None or sof[:2] != (0xC3, 8) or sof[4] != 1:
        raise ValueError("not a lossless JPEG image of one component of 8 bits")
    if scan is None or table is None or scan[0] != 1 or scan[3] != 1 or scan[5] != 0 or restart != sof[3]:
        raise ValueError("not a scan with predictor 1, no shift, and a restart for each row")
    return sof[2], sof[3], table


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: difference and bits taken (0 for bits that no code begins)."""
    diff, bits = np.zeros(65536, np.int16), np.zeros(65536, np.uint8)
    code, at = 0, 16
    for n in range(1, 17):
        for category in table[at : at + table[n - 1]]:
            if category > 8 or n + category > 16:
                raise ValueError("a code of more than 16 bits or a difference of more than 8")
            for extra in range(1 << category):
                value = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
                first = (code << category | extra) << (16 - n - category)
                diff[first : first + (1 << (16 - n - category))] = value
                bits[first : first + (1 << (16 - n - category))] = n + category
            code += 1
        at += table[n - 1]
        code <<= 1
    return diff, bits


def _decoded(parts: list[bytes], width: int, table: bytes) -> np.ndarray:
    """(rows x width) samples of scans of one table, each row of which ends with a restart marker."""
    next_diff, next_bits = _lookup(table)
    scan = np.frombuffer(b"".join(parts), np.uint8)
    after = np.concatenate([scan[1:], [0]])
    full = scan == 255
    marker = full & (after >= 0xD0) & (after <= 0xD7)
    drop = marker | np.concatenate([[False], full[:-1]])  # markers, and the zero stuffed after 255
    kept = scan[~drop]
    shift = np.cumsum(drop)
    ends = np.flatnonzero(marker)
    ends = ends - (shift[ends] - 1)
    begin = np.concatenate([[0], ends[:-1]])
    padded = np.concatenate([kept, np.zeros(4, np.uint8)]).astype(np.uint32)
    word = (padded[:-3] << np.uint32(16)) | (padded[1:-2] << np.uint32(8)) | padded[2:-1]
    out = np.zeros((width, len(begin)), np.uint8)
    position, value = begin * 8, np.full(len(begin), 128, np.int16)
    for k in range(width):
        ahead = (word[np.minimum(position >> 3, len(word) - 1)] >> (8 - (position & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        value = value + next_diff[ahead]
        position = position + next_bits[ahead]
        out[k] = value
    if (position > ends * 8).any():
        raise ValueError("a row is cut off")
    return np.ascontiguousarray(out.T)


def decode_files(files: list[bytes]) -> list[tuple[np.ndarray, int | None, float]]:
    """(samples as frames x rows x samples a row, payload bytes, frames a second) of each file, by its own sizes and
    tables; files of one size and table are decoded together.  ValueError for files of another process."""
    groups: dict[tuple[int, bytes], list[bytes]] = {}
    plans = []
    for data in files:
        places, height, payload, rate = parse_avi(data)
        kind = None
        for a, b in places:
            at = a + 2
            while data[at + 1] != 0xDA:  # segments up to the scan
                at += 2 + struct.unpack_from(">H", data, at + 2)[0]
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
            rows, width, table = _header(data[a:at])
            if rows != height or kind not in (None, (width, table)):
                raise ValueError("frames of different sizes or tables")
            kind = (width, table)
            group = groups.setdefault(kind, [])
            group.append(data[at : b - 2] + b"\xff\xd0")  # each row ends with a marker
        plans.append((kind, len(places), height, payload, rate))
    samples = {k: _decoded(parts, *k) for k, parts in groups.items()}
    starts: dict = dict.fromkeys(groups, 0)
    out = []
    for kind, n, height, payload, rate in plans:
        if kind is None:
            out.append((np.zeros((0, height, 1), np.uint8), payload, rate))
            continue
        row = starts[kind]
        starts[kind] = row + n * height
        out.append((samples[kind][row : row + n * height].reshape(n, height, -1), payload, rate))
    return out


def shots(frames: np.ndarray, rate: float, rules: ShotRules = ShotRules()) -> list[tuple[int, int, float, float]]:
    """(first frame, end frame, from second, to second) of the clips of frames (frames x height x 64)."""
    n = len(frames)
    level = (frames >> (8 - (rules.bins - 1).bit_length())).reshape(n, -1).astype(np.int64)
    counts = np.bincount((level + np.arange(n)[:, None] * rules.bins).ravel(), minlength=n * rules.bins).reshape(n, rules.bins)
    apart = np.abs(np.diff(counts, axis=0)).sum(1) / (2.0 * level.shape[1])
    cuts, total, square, seen = [0], 0.0, 0.0, 0
    for k, d in enumerate(apart.tolist(), 1):
        mean = total / seen if seen else 0.0
        bound = mean + rules.spread * max(0.0, square / seen - mean * mean) ** 0.5 if seen else 0.0
        if d > rules.floor and d > bound:
            cuts.append(k)
            total, square, seen = 0.0, 0.0, 0
        else:
            total, square, seen = total + d, square + d * d, seen + 1
    return [(a, b, a / rate, b / rate) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ShotRules = ShotRules()) -> DataFrame:
    """doc_id, n_bytes, media (the AVI file).  A null text is empty and gives one frame of zeros; equal texts give equal
    files; rows without an id and repeated rows are rows like others, and an empty table gives an empty one.  A text is
    taken whole (about 40 bytes of memory a byte of the longest); other columns aren't looked at."""

    def make(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, places in slices(data, offsets):
                files = encode_payloads(part, places, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(places)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return rows.mapInArrow(make, "doc_id bigint, n_bytes bigint, media binary")


def _grouped(column: pa.Array, limit: int = 1 << 21):
    """Runs of rows of a binary column of about `limit` bytes."""
    files, size, at = [], 0, 0
    for i, x in enumerate(column):
        files.append(x.as_py())
        size += len(files[-1] or b"")
        if size >= limit:
            yield at, files
            files, size, at = [], 0, i + 1
    if files:
        yield at, files


def _decoded_or_not(files: list[bytes | None]) -> list[tuple[tuple | None, str | None]]:
    """(what decode_files() gives, None) of each file, or (None, the reason) where it can't be decoded."""
    try:
        return [(x, None) if len(x[0]) else (None, "no frames") for x in decode_files(files)]
    except (ValueError, IndexError, TypeError, struct.error) as e:
        if len(files) == 1:
            return [(None, "no file" if files[0] is None else f"{type(e).__name__}: {e}")]
    return [_decoded_or_not([x])[0] for x in files]  # the good ones of the run by themselves


def decode_media(df: DataFrame, rules: ShotRules = ShotRules()) -> DataFrame:
    """doc_id, n_bytes, and from the stored bytes alone: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (frames, shots and mean sample), clips (one row of frames and seconds for each shot), error.

    A null media, a cut file or one of another process has null features and the reason in error (media_bytes and
    media_sha256 are those of what is there); error is null for all others.  An empty table gives an empty one; repeated
    rows and rows without an id are rows like others.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<first:int,end:int,from_s:double,to_s:double>>, error string"
    clip = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("from_s", pa.float64()), ("to_s", pa.float64())]))

    def read(batches):
        for batch in batches:
            for at, files in _grouped(batch.column(2)):
                rows = []
                for data, (decoded, error) in zip(files, _decoded_or_not(files), strict=True):
                    if decoded is None:
                        rows.append((None, None, None, *((None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())), None, None, error))
                        continue
                    body, payload, rate = decoded
                    n, height, _ = body.shape
                    raw = body.tobytes()[:payload]
                    found = shots(body, rate, rules)
                    mean = int(body.sum(dtype=np.int64)) * 1000 // max(1, len(raw))
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={n};height={height};shots={len(found)};cuts={'+'.join(str(f[0]) for f in found[1:])};mean={mean}", [dict(zip(("first", "end", "from_s", "to_s"), f, strict=True)) for f in found], None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.string())
                ids = [batch.column(k).slice(at, len(files)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """doc_id, clip, first, end, from_s, to_s: a row for each clip of each file."""
    return decoded.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
