"""ZIP files by ranged reads: the directory at their end, and single members by their offset."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zipfile import BadZipFile

#: (offset, length) -> bytes; fewer only at the end.
ReadAt = Callable[[int, int], bytes]

# Fixed values of the format: signatures, sizes of records without their variable parts, methods, and the mark for
# "look into the long form".
END, END_LONG, END_LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END_LONG_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
STORED, DEFLATED, BZIP2, LZMA = 0, 8, 12, 14
LONG_FORM = 0xFFFFFFFF
LONG_EXTRA = 1
ENCRYPTED, UTF8_NAME = 1, 0x800
MOST_COMMENT = 0xFFFF

PAGE = 1 << 20
PIECE = 4 << 20


class Entry(NamedTuple):
    """A member as the directory describes it; offset is where its local header stands."""

    idx: int
    name: str
    file_size: int
    external_attr: int
    offset: int
    packed_size: int
    method: int
    crc: int
    flags: int


def directory_place(read_at: ReadAt, size: int) -> tuple[int, int, int]:
    """(offset of the directory, its bytes, what is to be added to offsets in it), from the last bytes of the file."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT - END_LONG_SIZE - LOCATOR_SIZE)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < END_SIZE:
        raise BadZipFile("no end record")
    length, offset = struct.unpack("<2I", tail[at + 12 : at + 20])
    end = tail_at + at
    if at >= LOCATOR_SIZE and tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] == END_LOCATOR:
        end -= LOCATOR_SIZE + END_LONG_SIZE
        record = read_at(end, END_LONG_SIZE)
        if record[:4] != END_LONG:
            # It may have been moved with bytes put before the archive, or hold more than its usual fields.
            end = struct.unpack("<Q", tail[at - LOCATOR_SIZE + 8 : at - LOCATOR_SIZE + 16])[0]
            record = read_at(end, END_LONG_SIZE)
        if record[:4] != END_LONG:
            raise BadZipFile("no long end record")
        length, offset = struct.unpack("<2Q", record[40:56])
    start = end - length
    if start < 0 or start < offset:
        raise BadZipFile("directory lies outside of the file")
    return start, length, start - offset


def entries(read_at: ReadAt, size: int) -> Iterator[Entry]:
    """Members in directory order; the directory is read a page at a time, the members are not."""
    start, length, shift = directory_place(read_at, size)
    held, at, idx = b"", 0, 0
    while at < length:
        def need(n: int) -> None:
            nonlocal held
            while len(held) < n:
                page = read_at(start + at + len(held), min(PAGE, length - at - len(held)))
                if not page:
                    raise BadZipFile("directory ends early")
                held += page

        need(ENTRY_SIZE)
        if held[:4] != ENTRY:
            raise BadZipFile("damaged directory")
        flags, method = struct.unpack("<2H", held[8:12])
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack("<3I3H", held[16:34])
        attr, offset = struct.unpack("<2I", held[38:46])
        total = ENTRY_SIZE + n_name + n_extra + n_comment
        need(total)
        name = held[ENTRY_SIZE : ENTRY_SIZE + n_name].decode("utf-8" if flags & UTF8_NAME else "cp437").split("\0")[0]
        plain, packed, offset = _long_values(held[ENTRY_SIZE + n_name : ENTRY_SIZE + n_name + n_extra], plain, packed, offset)
        yield Entry(idx, name, plain, attr, offset + shift, packed, method, crc, flags)
        held, at, idx = held[total:], at + total, idx + 1


def _long_values(extra: bytes, *values: int) -> list[int]:
    """Values with those of the long form put in where the short one has no room."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<2H", extra[at : at + 4])
        if kind == LONG_EXTRA:
            field = at + 4
            for k, v in enumerate(out):
                if v == LONG_FORM:
                    if field + 8 > at + 4 + n:
                        raise BadZipFile("damaged long form")
                    out[k] = struct.unpack("<Q", extra[field : field + 8])[0]
                    field += 8
        at += 4 + n
    return out


def checked_entries(read_at: ReadAt, size: int) -> Iterator[Entry]:
    """Like entries, but a damaged directory fails before the first member: it is gone through twice, never held."""
    for _ in entries(read_at, size):
        pass
    yield from entries(read_at, size)


def member_pieces(read_at: ReadAt, offset: int, packed_size: int, method: int, crc: int, flags: int, file_size: int) -> Iterator[bytes]:
    """A member's bytes, a few megabytes at a time; after the last one its size and checksum are compared."""
    if flags & ENCRYPTED:
        raise BadZipFile("member is encrypted")
    head = read_at(offset, LOCAL_SIZE)
    if head[:4] != LOCAL or len(head) < LOCAL_SIZE:
        raise BadZipFile("no member at its offset")
    at = offset + LOCAL_SIZE + sum(struct.unpack("<2H", head[26:30]))
    end, check, size = at + packed_size, 0, 0
    inflate = _decoder(method)
    while at < end:
        packed = read_at(at, min(PIECE, end - at))
        if not packed:
            raise BadZipFile("member ends early")
        at += len(packed)
        for piece in inflate(packed):
            check, size = zlib.crc32(piece, check), size + len(piece)
            yield piece
    if (check, size) != (crc, file_size):
        raise BadZipFile("checksum or size of the member differs")


def _decoder(method: int) -> Callable[[bytes], Iterator[bytes]]:
    if method == STORED:
        return lambda packed: iter((packed,))
    if method == DEFLATED:
        state = zlib.decompressobj(-zlib.MAX_WBITS)

        def inflate(packed: bytes) -> Iterator[bytes]:
            while packed and not state.eof:
                yield state.decompress(packed, PIECE)
                packed = state.unconsumed_tail

        return inflate
    if method == BZIP2:
        bzip = bz2.BZ2Decompressor()
        return lambda packed: _bounded(bzip, packed)
    if method == LZMA:
        held, made = b"", None

        def unpack(packed: bytes) -> Iterator[bytes]:
            nonlocal held, made
            if made is None:
                held += packed
                if len(held) < 9:
                    return
                made, packed = _lzma(held[4:9]), held[9:]
            yield from _bounded(made, packed)

        return unpack
    raise BadZipFile(f"compression method {method} is not known")


def _bounded(state: bz2.BZ2Decompressor | lzma.LZMADecompressor, packed: bytes) -> Iterator[bytes]:
    while not state.eof:
        piece = state.decompress(packed, PIECE)
        packed = b""
        if piece:
            yield piece
        if state.needs_input or (not piece and not state.needs_input):
            return


def _lzma(properties: bytes) -> lzma.LZMADecompressor:
    rest, lc = divmod(properties[0], 9)
    pb, lp = divmod(rest, 5)
    chain = [{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb, "dict_size": struct.unpack("<I", properties[1:5])[0]}]
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain)
