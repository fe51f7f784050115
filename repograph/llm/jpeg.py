"""Media columns: baseline JPEG written, parsed and Huffman-decoded in numpy.

``encode_payload`` stores bytes losslessly in a one-component baseline JPEG: each byte, taken as
signed, is a quantised coefficient (the quantisation table is all ones), 64 bytes are a block.
Runs of zero bytes become zero runs and end-of-block codes.  Huffman codes have 1 to 12 bits, the
frequent sizes of text the shortest; every eight blocks are a restart interval.

``decode`` reads any baseline JPEG of one interleaved scan: markers, quantisation and Huffman
tables, sampling factors, restart intervals.  Restart intervals do not depend on each other, so
``decode_many`` decodes those of many images side by side: a step takes one Huffman code and its
value from each of them, whatever the tables.  Where only a few are left, as in an image without
restarts, a plain loop takes one code at a time.  ``thumbnail`` is the luminance image of DC terms
only, one pixel a block.

Defined results of the column operators: a null text is empty; the payload of an empty text is one
block of zeros; equal texts give equal values; repeated rows give a row each; null ids stay null;
a table without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

LARGEST_SIDE, RESTART = 8191, 8
CHUNK = 256  # intervals coded at once
LANES = 12  # with fewer intervals the plain loop is faster
SLICE_BYTES = 4 << 20
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
BATCH_BYTES = 4 << 20


# -- tables ---------------------------------------------------------------------------------


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table given as in a DHT segment."""
    out, code, at = [], 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lengths(kind: int) -> dict[int, int]:
    """Code length of each symbol of the writer's own tables: kind 0 for DC differences, 1 for AC."""
    if kind == 0:
        return dict.fromkeys(range(9), 4)
    own = {7: 1, 6: 2, 0x00: 6}  # letters, then digits and punctuation, then end of block
    own |= {size: 5 for size in (1, 2, 3, 4, 5, 8)}
    return own | {run << 4 | size: 12 for run in range(1, 16) for size in range(1, 9)} | {0xF0: 12}


@functools.lru_cache(1)
def own_tables() -> dict[int, tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Of DC (0) and AC (1): counts and symbols as in a DHT segment, code and length by symbol."""
    found = {}
    for kind in (0, 1):
        by_symbol = lengths(kind)
        symbols = sorted(by_symbol, key=lambda s: (by_symbol[s], s))
        counts = [sum(1 for s in symbols if by_symbol[s] == length) for length in range(1, 17)]
        codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
        for symbol, code, length in canonical(counts, symbols):
            codes[symbol], sizes[symbol] = code, length
        found[kind] = counts, symbols, codes, sizes
    return found


@functools.lru_cache(64)
def look_up(counts: bytes, symbols: bytes, ac: bool) -> np.ndarray:
    """By the next 16 bits: code length, bits of the value (from bit 5), zeros before it (9), places taken (16).

    A code that is in no table has a run that leads out of any block.
    """
    flat = np.full(1 << 16, 64 << 9 | 1 << 16, np.uint64)
    for symbol, code, length in canonical(list(counts), list(symbols)):
        run, size = symbol >> 4, symbol & 15
        if not ac:
            run, places = (64, 1) if run else (0, 1)
        elif size or run == 15:
            places = run + 1
        else:
            run, places = 0, 64
        flat[code << (16 - length) : (code + 1) << (16 - length)] = length | size << 5 | run << 9 | places << 16
    return flat


# -- writing --------------------------------------------------------------------------------


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def encode_payload(payload: bytes) -> bytes:
    """A JPEG of the payload, a positive multiple of 64 bytes; the comment holds its number of blocks."""
    return encode_many([payload])[0]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """``encode_payload`` of each, their blocks coded together."""
    shapes, grids = [], []
    for payload in payloads:
        n = len(payload) // 64
        wide = max(int(np.ceil(np.sqrt(n))), -(-n // LARGEST_SIDE))
        high = -(-n // wide)
        shapes.append((n, wide, high))
        grids += [payload, bytes(64 * (wide * high - n))]
    blocks = np.frombuffer(b"".join(grids), np.int8).reshape(-1, 64)
    marks = [np.r_[-1, np.arange(-(-wide * high // RESTART) - 1) % 8] for _, wide, high in shapes]
    starts, at = [], 0
    for (_, wide, high), mark in zip(shapes, marks):
        starts.append(at + RESTART * np.arange(len(mark)))
        at += wide * high
    starts, bounds = np.concatenate(starts), np.cumsum([0, *(len(m) for m in marks)])
    mark, ends = np.concatenate(marks), np.r_[starts[1:], at]
    parts, sizes = [], []
    for i in range(0, len(starts), CHUNK):
        first, last = starts[i], ends[min(i + CHUNK, len(ends)) - 1]
        part, size = code_intervals(blocks[first:last], starts[i : i + CHUNK] - first, mark[i : i + CHUNK])
        parts.append(part)
        sizes.append(size)
    scan, sizes = np.concatenate(parts).tobytes(), np.r_[0, np.cumsum(np.concatenate(sizes))]
    return [b"".join([*header(*shape), scan[sizes[i] : sizes[j]], b"\xff\xd9"]) for shape, i, j in zip(shapes, bounds, bounds[1:])]


def header(n: int, wide: int, high: int) -> list[bytes]:
    tables = b"".join(segment(0xC4, bytes([kind << 4, *counts, *symbols])) for kind, (counts, symbols, _, _) in own_tables().items())
    return [b"\xff\xd8", segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"), segment(0xFE, b"blocks=%d" % n), segment(0xDB, bytes([0, *[1] * 64])), segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)), tables, segment(0xDD, struct.pack(">H", RESTART)), segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))]


def code_intervals(blocks: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of restart intervals that begin at some blocks, and how many bytes each takes.

    An interval with a mark of 0 to 7 follows the restart marker of that number.
    """
    _, _, dc_code, dc_length = own_tables()[0]
    _, _, ac_code, ac_length = own_tables()[1]
    values = blocks.astype(np.int32)
    values[1:, 0] -= blocks[:-1, 0]
    values[starts, 0] = blocks[starts, 0]
    size = np.frexp(np.abs(values).astype(np.float32))[1].astype(np.uint64)
    low = np.where(values < 0, values + (1 << size.astype(np.int32)) - 1, values).astype(np.uint64)
    set_ = values[:, 1:] != 0
    place = np.where(set_, np.arange(1, 64, dtype=np.int32), 0)
    before = np.maximum.accumulate(place, axis=1)
    run = np.zeros_like(place)
    run[:, 1:] = before[:, :-1]
    run = np.arange(63, dtype=np.int32) - run
    last, skips = before[:, -1], (run >> 4).astype(np.uint64)
    symbol = (run & 15) << 4 | size[:, 1:].astype(np.int32)
    # A place for each coefficient, one for the end of block and one that fills the last byte of an interval.
    bits, length = np.zeros((len(blocks), 66), np.uint64), np.zeros((len(blocks), 66), np.uint64)
    bits[:, 0], length[:, 0] = dc_code[size[:, 0].astype(np.int32)] << size[:, 0] | low[:, 0], dc_length[size[:, 0].astype(np.int32)] + size[:, 0]
    own = ac_length[symbol] + size[:, 1:]
    far = ac_code[0xF0] * (1 + (skips > 1) * (np.uint64(1) << ac_length[0xF0]) + (skips > 2) * (np.uint64(1) << 2 * ac_length[0xF0])) * (skips > 0)
    bits[:, 1:64] = (far << own | ac_code[symbol] << size[:, 1:] | low[:, 1:]) * set_
    length[:, 1:64] = (own + skips * ac_length[0xF0]) * set_
    bits[:, 64], length[:, 64] = ac_code[0] * (last < 63), ac_length[0] * (last < 63)
    total = np.add.reduceat(length.sum(axis=1), starts).astype(np.int64)
    ends, short = np.r_[starts[1:], len(blocks)] - 1, -total % 8
    bits[ends, 65], length[ends, 65] = (1 << short) - 1, short
    used = length > 0
    bits, length = bits[used], length[used]
    wide, kind = (32, ">u4") if length.max() <= 32 else (64, ">u8")
    rows = np.unpackbits((bits << (wide - length)).astype(kind).view(np.uint8).reshape(len(bits), wide // 8), axis=1)
    coded = np.packbits(rows[np.arange(wide, dtype=np.uint8) < length.astype(np.uint8)[:, None]])
    # Bytes of ones are followed by a zero; a marker stands before each interval that has one.
    interval, full = (total + short) // 8, coded == 0xFF
    marked = np.cumsum(mark >= 0)
    at = np.arange(len(coded)) + np.cumsum(full) - full + 2 * np.repeat(marked, interval)
    stuffed = np.add.reduceat(full.astype(np.int64), np.cumsum(interval) - interval)
    out = np.zeros(len(coded) + int(full.sum()) + 2 * int(marked[-1]), np.uint8)
    out[at] = coded
    sizes = interval + stuffed + 2 * (mark >= 0)
    begin = (np.cumsum(sizes) - sizes)[mark >= 0]
    out[begin], out[begin + 1] = 0xFF, 0xD0 + mark[mark >= 0]
    return out, sizes


# -- reading --------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0
    wide: int = 0
    high: int = 0
    blocks: np.ndarray | None = None  # (blocks, 64) in zigzag order, quantised


@dataclass
class Image:
    width: int
    height: int
    components: list
    quant: dict
    comment: bytes


@dataclass
class Scan:
    """Entropy-coded bytes without stuffing and markers, and where each restart interval lies in them."""

    parts: list
    tables: dict  # (class, number): counts and symbols
    wide: int  # MCUs
    high: int
    restart: int  # MCUs of an interval
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def units(self) -> tuple:
        """The tables of each block of an MCU, in order."""
        return tuple((*self.tables[0, p.dc], *self.tables[1, p.ac]) for p in self.parts for _ in range(p.across * p.down))


def decode(data: bytes) -> Image:
    """The quantised coefficients of a baseline JPEG."""
    return decode_many([data])[0]


def decode_many(files: list[bytes]) -> list[Image]:
    """``decode`` of each, those of the same tables and sampling side by side."""
    parsed, alike = [parse(data) for data in files], {}
    for _, scan in parsed:
        if scan:
            alike.setdefault(scan.units(), []).append(scan)
    for units, scans in alike.items():
        read_scans(scans, units)
    return [image for image, _ in parsed]


def parse(data: bytes) -> tuple[Image, Scan | None]:
    """The image without its coefficients, and the scan that holds them."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, tables, parts, restart, comment, size, scan = 2, {}, {}, [], 0, b"", (0, 0), None
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            break
        (length,) = struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            size = struct.unpack(">HH", body[1:5])[::-1]
            parts = [Component(i, s >> 4, s & 15, q) for i, s, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(body[5]))]
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("baseline JPEG only")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            for ident, which in (body[1 + 2 * k : 3 + 2 * k] for k in range(body[0])):
                c = next(p for p in parts if p.ident == ident)
                c.dc, c.ac = which >> 4, which & 15
            if body[0] != len(parts):
                raise ValueError("one interleaved scan only")
            scan, at = find_scan(data, at, size, parts, tables, restart)
    return Image(*size, parts, quant, comment), scan


def find_scan(data: bytes, at: int, size, parts, tables, restart: int) -> tuple[Scan, int]:
    """The scan that begins at a place, and where the marker after it begins."""
    across, down = max(p.across for p in parts), max(p.down for p in parts)
    if len(parts) == 1:
        parts[0].across = parts[0].down = across = down = 1
    wide, high = -(-size[0] // (8 * across)), -(-size[1] // (8 * down))
    coded = np.frombuffer(data, np.uint8, offset=at)
    ones = np.flatnonzero(coded[:-1] == 0xFF)
    after = coded[ones + 1]
    restarts = (after >= 0xD0) & (after <= 0xD7)
    others = np.flatnonzero((after != 0) & ~restarts)
    if len(others):
        end = int(ones[others[0]])
        ones, restarts = ones[: others[0]], restarts[: others[0]]
    else:
        end = len(coded)
    stays = np.ones(end, bool)
    stays[ones + 1] = False  # a stuffed zero or the second byte of a marker
    marks = ones[restarts]
    stays[marks] = False
    raw = coded[:end][stays]
    cuts = marks - np.searchsorted(ones, marks) - np.arange(len(marks))
    return Scan(parts, dict(tables), wide, high, restart or wide * high, raw, np.r_[0, cuts], np.r_[cuts, len(raw)]), at + end


def read_scans(scans: list[Scan], units: tuple) -> None:
    """Decode scans of the same tables and sampling; fills in the blocks of their components."""
    totals = np.array([s.wide * s.high * len(units) for s in scans])
    steps = [s.restart * len(units) for s in scans]
    firsts = np.cumsum(totals) - totals
    for s, total, step in zip(scans, totals, steps):
        if len(s.starts) != max(1, -(-total // step)):
            raise ValueError("restart markers are missing")
    lane = np.concatenate([first + step * np.arange(len(s.starts)) for s, first, step in zip(scans, firsts, steps)])
    blocks = np.concatenate([np.minimum(step, total - step * np.arange(len(s.starts))) for s, total, step in zip(scans, totals, steps)])
    offsets = np.cumsum([0, *(len(s.raw) for s in scans)])
    starts = np.concatenate([s.starts + o for s, o in zip(scans, offsets)])
    ends = np.concatenate([s.ends + o for s, o in zip(scans, offsets)])
    raw = np.concatenate([s.raw for s in scans])
    out = np.zeros((int(totals.sum()), 64), np.int32)
    first = 0
    while first < len(lane):  # bounds the words of 64 bits that a slice takes
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, side="right")))
        begin = int(starts[first])
        part = raw[begin : int(ends[last - 1])]
        read = read_side_by_side if last - first >= LANES else read_one_by_one
        read(part, starts[first:last] - begin, ends[first:last] - begin, lane[first:last], blocks[first:last], units, out)
        first = last
    for s, start, total in zip(scans, firsts, totals):
        place(s, out[start : start + total], len(units))


def place(scan: Scan, coded: np.ndarray, n_units: int) -> None:
    """Sum the DC differences of each interval and bring the blocks from the scan's order to rows."""
    mcus, at = coded.reshape(scan.high * scan.wide, n_units, 64), 0
    for p in scan.parts:
        mine = mcus[:, at : at + p.across * p.down]
        at += p.across * p.down
        dc = mine[:, :, 0].ravel()
        step = min(scan.restart * p.across * p.down, max(1, len(dc)))
        held = np.zeros(-(-len(dc) // step) * step, np.int32)
        held[: len(dc)] = dc
        mine[:, :, 0] = held.reshape(-1, step).cumsum(axis=1).ravel()[: len(dc)].reshape(mine.shape[:2])
        p.wide, p.high = scan.wide * p.across, scan.high * p.down
        p.blocks = mine.reshape(scan.high, scan.wide, p.down, p.across, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def read_side_by_side(raw, starts, ends, lane, blocks, units, out) -> None:
    """Restart intervals in step: each round takes the next code and value of every one that is not at its end.

    ``lane`` is the first block of each interval in ``out``, ``blocks`` how many it has; DC terms stay differences.
    """
    looks = [look_up(*unit[2 * i : 2 * i + 2], bool(i)) for unit in units for i in (0, 1)]
    table, U = np.concatenate(looks), np.uint64
    words = np.zeros(len(raw) + 1, U)
    held = np.r_[raw, np.full(5, 0xFF, np.uint8)]
    for i in range(5):
        words |= held[i : i + len(words)].astype(U) << U(56 - 8 * i)
    half = np.array([0, *(1 << s for s in range(15))], np.int64)
    less = np.array([(1 << s) - 1 for s in range(16)], np.int64)
    flat = out.reshape(-1)
    pos, base, k = starts.astype(U) * U(8), lane.astype(U) * U(64), np.zeros(len(lane), U)
    end, left, unit = ends.astype(U) * U(8), blocks.astype(np.int64), np.zeros(len(lane), np.int64)
    begun = left > 0
    pos, base, k, end, left, unit = (x[begun] for x in (pos, base, k, end, left, unit))
    while len(pos):
        bits = words.take((pos >> U(3)).view(np.int64), mode="clip") << (pos & U(7))
        which = ((unit << 1) + (k > 0)) << 16
        entry = table.take((bits >> U(48)).view(np.int64) + which)
        length, size = entry & U(31), entry >> U(5) & U(15)
        value = ((bits << length) >> U(1) >> (U(63) - size)).view(np.int64)
        size_at = size.view(np.int64)
        value -= less.take(size_at) * (value < half.take(size_at))
        spot = k + (entry >> U(9) & U(127))
        if spot.max() > 63:
            raise ValueError("a code that is in no table, or a run beyond its block")
        flat[(base + spot).view(np.int64)] = value
        pos += length + size
        k += entry >> U(16)
        done = k > U(63)
        if done.any():
            over = np.flatnonzero(done)
            k[over] = 0
            base[over] += U(64)
            left[over] -= 1
            unit[over] = (unit[over] + 1) % len(units)
            if not left[over].all():
                if (pos[left == 0] > end[left == 0]).any():
                    raise ValueError("the scan ends early")
                more = left > 0
                pos, base, k, end, left, unit = (x[more] for x in (pos, base, k, end, left, unit))


def read_one_by_one(raw, starts, ends, lane, blocks, units, out) -> None:
    """The same, a code at a time, by tables over the next 16 bits."""
    looks = [[look_up(*unit[2 * i : 2 * i + 2], bool(i)).tolist() for i in (0, 1)] for unit in units]
    for start, end, first, n in zip(starts.tolist(), ends.tolist(), lane.tolist(), blocks.tolist()):
        data, held, n_bits, at = raw[start:end].tobytes(), 0, 0, 0
        for i in range(n):
            tables, k, values = looks[i % len(units)], 0, [0] * 64
            while k < 64:
                while n_bits < 32:
                    held, at, n_bits = held << 8 | (data[at] if at < len(data) else 0xFF), at + 1, n_bits + 8
                entry = tables[k > 0][held >> n_bits - 16 & 0xFFFF]
                length, size, spot = entry & 31, entry >> 5 & 15, k + (entry >> 9 & 127)
                if spot > 63:
                    raise ValueError("a code that is in no table, or a run beyond its block")
                n_bits -= length + size
                value = held >> n_bits & (1 << size) - 1
                values[spot] = value if not size or value >> size - 1 else value - (1 << size) + 1
                held &= (1 << n_bits) - 1
                k += entry >> 16
            out[first + i] = values
        if at - n_bits // 8 > len(data):
            raise ValueError("the scan ends early")


def thumbnail(image: Image) -> np.ndarray:
    """Luminance from DC terms: a pixel for each block, without the blocks that only fill up an MCU."""
    part = image.components[0]
    pixels = part.blocks[:, 0].reshape(part.high, part.wide) * int(image.quant[part.quant][0])
    across, down = max(p.across for p in image.components), max(p.down for p in image.components)
    wide, high = -(-image.width * part.across // (8 * across)), -(-image.height * part.down // (8 * down))
    return np.clip((pixels[:high, :wide] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid are lighter than the mean; then a checksum of the pixels."""
    rows, cols = (np.arange(8) * n // 8 for n in pixels.shape)
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    sums[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    ends = [np.maximum((np.arange(8) + 1) * n // 8, start + 1) for n, start in zip(pixels.shape, (rows, cols))]
    cells = sums[ends[0]][:, ends[1]] - sums[rows][:, ends[1]] - sums[ends[0]][:, cols] + sums[rows][:, cols]
    areas = (ends[0] - rows)[:, None] * (ends[1] - cols)[None, :]
    lighter = cells * pixels.size > areas * int(sums[-1, -1])
    return f"{int.from_bytes(np.packbits(lighter.ravel()).tobytes(), 'big'):016x}:{zlib.crc32(pixels.tobytes()):08x}"


def stored_payload(image: Image) -> bytes:
    """The bytes that ``encode_payload`` put into the coefficients."""
    n = int(image.comment.removeprefix(b"blocks="))
    values = image.components[0].blocks[:n]
    return values.astype(np.int8).tobytes()


# -- columns --------------------------------------------------------------------------------


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and a media column that stores it."""
    support.ready(docs.sparkSession)

    def task(batches):
        for batch in batches:
            ids, data, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                data.append(text.as_py().encode())
                held += len(data[-1])
                if held > BATCH_BYTES:
                    yield batch_of(ids, data)
                    ids, data, held = [], [], 0
            if ids:
                yield batch_of(ids, data)

    def batch_of(ids, data):
        media = encode_many([padded(x) for x in data])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(task, MEDIA)


def features(media: DataFrame) -> DataFrame:
    """Reads each media value back: the payload's digests, dimensions and thumbnail hash."""
    support.ready(media.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def task(batches):
        for batch in batches:
            some, held = [], 0
            for doc_id, n_bytes, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                some.append((doc_id, n_bytes, stored.as_py()))
                held += len(some[-1][2])
                if held > BATCH_BYTES:
                    yield batch_of(some)
                    some, held = [], 0
            if some:
                yield batch_of(some)

    def batch_of(some):
        rows = [[] for _ in kinds]
        for (doc_id, n_bytes, data), image in zip(some, decode_many([data for _, _, data in some])):
            payload = stored_payload(image)
            feature = f"{image.width}x{image.height}:{thumbnail_hash(thumbnail(image))}"
            for x, y in zip(rows, (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, image.width, image.height)):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)

    return media.mapInArrow(task, FEATURES)
