"""Stored ZIP members: a writer, and a reader that works by ranges of the file.

The reader finds the end-of-central-directory record, follows the ZIP64 locator
where sizes or counts ask for it, parses the central directory, and gives the
range of the file where each stored member's bytes lie. Nothing is extracted.
Layouts follow the published ZIP application note.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_MOST16, _MOST32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    stored: int  # bytes in the file
    size: int
    header: int  # where its local header begins


def package(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """The pieces of a ZIP file with stored members; ``zip64`` writes ZIP64 fields even where they aren't needed."""
    at, central = 0, []
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        large = zip64 or n >= _MOST32 or at >= _MOST32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if large else b""
        short = _MOST32 if large else n
        head = struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if large else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(more), 0, 0, 0, 0, _MOST32 if large else at) + raw + more)
        yield head
        yield data
        at += len(head) + n
    listing = b"".join(central)
    yield listing
    count, end = len(members), at + len(listing)
    if zip64 or count >= _MOST16 or at >= _MOST32 or len(listing) >= _MOST32:
        yield struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, count, count, len(listing), at)
        yield struct.pack("<IIQI", _LOCATOR, 0, end, 1)
        yield struct.pack("<IHHHHIIH", _END, _MOST16, _MOST16, _MOST16, _MOST16, _MOST32, _MOST32, 0)
    else:
        yield struct.pack("<IHHHHIIH", _END, 0, 0, count, count, len(listing), at, 0)


def directory(read: Callable[[int, int], bytes], length: int) -> dict[str, Member]:
    """The members of a ZIP file of ``length`` bytes; ``read(at, n)`` gives n of its bytes."""
    tail_at = max(0, length - 22 - _MOST16)
    tail = read(tail_at, length - tail_at)
    k = len(tail)
    while True:
        k = tail.rfind(struct.pack("<I", _END), 0, k)
        if k < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        if len(tail) - k >= 22 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] <= len(tail):
            break
    count, size, at = struct.unpack_from("<HII", tail, k + 10)
    if _MOST16 == count or _MOST32 in (size, at):
        mark, _, where, _ = struct.unpack("<IIQI", read(tail_at + k - 20, 20))
        if mark != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        mark, *_, count, size, at = struct.unpack("<IQHHIIQQQQ", read(where, 56))
        if mark != _END64:
            raise ValueError("no ZIP64 end of central directory")
    listing, i, found = read(at, size), 0, {}
    for _ in range(count):
        mark, _, _, _, method, _, _, crc, stored, full, n, extra, comment, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", listing, i)
        if mark != _CENTRAL:
            raise ValueError("a damaged central directory")
        name = listing[i + 46 : i + 46 + n].decode()
        fields = listing[i + 46 + n : i + 46 + n + extra]
        while len(fields) >= 4:
            kind, m = struct.unpack_from("<HH", fields)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{m // 8}Q", fields, 4))
                full = next(values) if full == _MOST32 else full
                stored = next(values) if stored == _MOST32 else stored
                header = next(values) if header == _MOST32 else header
            fields = fields[4 + m :]
        found[name] = Member(name, method, crc, stored, full, header)
        i += 46 + n + extra + comment
    return found


def data_at(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} isn't stored")
    mark, n, extra = struct.unpack("<I22xHH", read(member.header, 30))
    if mark != _LOCAL:
        raise ValueError("a damaged local header")
    return member.header + 30 + n + extra
