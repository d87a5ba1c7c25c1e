"""The package gate: a ZIP container is read only if its two directories agree and every byte checks out."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from dataclasses import dataclass, field

MAX_ARCHIVE = MAX_TOTAL = 1 << 30
MAX_ENTRIES = 10_000
MAX_PART = 16 << 20

_END, _CENTRAL, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
UTF8_FLAG, ENCRYPTED_FLAG, STORED, DEFLATED, UNICODE_PATH = 0x800, 1, 0, 8, 0x7075


class PackageError(ValueError):
    """What is wrong with a package, as text for its reader."""


@dataclass
class Entry:
    idx: int
    name: str
    raw_name: bytes
    flags: int
    method: int
    crc: int
    csize: int
    usize: int
    offset: int
    is_dir: bool
    data_at: int = 0


@dataclass
class Package:
    content: bytes
    entries: dict[str, Entry] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.entries]

    def part(self, name: str, limit: int | None = MAX_PART) -> bytes:
        """The bytes of one entry; only entries that are asked for are kept."""
        if (e := self.entries.get(name)) is None or e.is_dir:
            raise PackageError(f"the document package is missing {name}")
        if limit is not None and e.usize > limit:
            raise PackageError(f"the package metadata entry {name} is too large")
        return b"".join(self._inflated(e))

    def get(self, name: str) -> bytes | None:
        return self.part(name) if name in self.entries else None

    def verify(self) -> Package:
        """Inflates every entry in steps, against its declared size and checksum, keeping nothing."""
        for e in self.entries.values():
            if not e.is_dir:
                for _ in self._inflated(e):
                    pass
        return self

    def _inflated(self, e: Entry):
        data = memoryview(self.content)[e.data_at : e.data_at + e.csize]
        size = crc = 0
        if e.method == STORED:
            if e.csize != e.usize:
                raise PackageError(f"the stored size of {e.name} does not match its declared size")
            steps = (bytes(data[k : k + 65536]) for k in range(0, len(data), 65536))
        else:
            steps = _steps(data, e)
        for step in steps:
            size += len(step)
            if size > e.usize:
                raise PackageError(f"{e.name} expands beyond the size declared in the ZIP directory")
            crc = zlib.crc32(step, crc)
            yield step
        if size != e.usize:
            raise PackageError(f"the uncompressed size of {e.name} is inconsistent")
        if crc != e.crc:
            raise PackageError(f"the checksum of {e.name} is invalid")


def _steps(data: memoryview, e: Entry):
    engine = zlib.decompressobj(-15)
    rest = data
    try:
        while not engine.eof:
            step = engine.decompress(rest, 65536)
            rest = engine.unconsumed_tail
            if step:
                yield step
            elif not rest:
                break
    except zlib.error:
        raise PackageError(f"the compressed data for {e.name} is invalid") from None
    if not engine.eof or engine.unused_data:
        raise PackageError(f"the compressed data for {e.name} is invalid")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise PackageError(message)


def _extra_fields(extra: bytes):
    at = 0
    while at < len(extra):
        _need(at + 4 <= len(extra), "a ZIP entry has a malformed extra field")
        kind, size = struct.unpack_from("<HH", extra, at)
        _need(at + 4 + size <= len(extra), "a ZIP entry has a malformed extra field")
        yield kind, extra[at + 4 : at + 4 + size]
        at += 4 + size


def _readings(raw: bytes, flags: int, extra: bytes) -> tuple[str, str]:
    """(plain, effective) names: by the flag, and by the Unicode path field where it is valid for the raw name."""
    if flags & UTF8_FLAG:
        try:
            plain = raw.decode()
        except UnicodeDecodeError:
            raise PackageError("a ZIP entry declares a UTF-8 name but is not valid UTF-8") from None
    else:
        plain = raw.decode("cp437")
    effective = plain
    for kind, body in _extra_fields(extra):
        if kind != UNICODE_PATH:
            continue
        _need(len(body) >= 5, "a ZIP entry has a malformed Unicode path field")
        _need(body[0] == 1, "a ZIP entry uses an unsupported Unicode path version")
        if struct.unpack_from("<L", body, 1)[0] == zlib.crc32(raw):
            try:
                effective = body[5:].decode()
            except UnicodeDecodeError:
                raise PackageError("a ZIP entry has an unreadable Unicode path field") from None
    return plain, effective


def _safe(name: str) -> bool:
    parts = name.removesuffix("/").split("/")
    return bool(name) and "\\" not in name and "\0" not in name and all(p not in ("", ".", "..") and ":" not in p for p in parts)


def _folded(name: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name.removesuffix("/")).casefold())


def _end_record(content: bytes) -> tuple[int, tuple]:
    for at in range(len(content) - _END.size, max(-1, len(content) - _END.size - 65536), -1):
        if content.startswith(b"PK\x05\x06", at):
            record = _END.unpack_from(content, at)
            if at + _END.size + record[7] == len(content):
                return at, record
    raise PackageError("the ZIP central directory is missing")


def open_package(content: bytes) -> Package:
    """The entries of a ZIP package by effective name; raises PackageError for the first rule that is broken.

    Names have two readings (by flag, by Unicode path field); both must be safe, agree about being a directory, and
    be unique without case and normalisation.
    """
    _need(len(content) <= MAX_ARCHIVE, "the package exceeds the supported archive-size limit")
    end, (_, disk, first_disk, here, count, size, start, _) = _end_record(content)
    _need(disk == first_disk == 0 and here == count, "multi-disk ZIP packages are not supported")
    zip64 = count == 0xFFFF or 0xFFFFFFFF in (size, start) or content[end - 20 : end - 16] == b"PK\x06\x07"
    _need(not zip64, "ZIP64 packages are not supported")
    _need(count <= MAX_ENTRIES, "the package contains too many ZIP entries")
    _need(start + size == end, "the ZIP central directory is invalid")

    package, at, total = Package(content), start, 0
    seen: tuple[dict, dict] = ({}, {})
    for idx in range(count):
        ok = at + _CENTRAL.size <= end and content.startswith(b"PK\x01\x02", at)
        _need(ok, "the ZIP central directory contains an invalid entry")
        (_, made_by, _, flags, method, _, _, crc, csize, usize, n, x, c, disk, _, attrs, offset) = _CENTRAL.unpack_from(content, at)
        _need(0xFFFFFFFF not in (csize, usize, offset) and disk != 0xFFFF, "ZIP64 entries are not supported")
        _need(at + _CENTRAL.size + n + x + c <= end, "a ZIP entry has an invalid length")
        _need(not flags & ENCRYPTED_FLAG, "encrypted ZIP entries are not supported")
        _need(method in (STORED, DEFLATED), "a ZIP entry uses an unsupported compression method")
        raw = content[at + _CENTRAL.size : at + _CENTRAL.size + n]
        extra = content[at + _CENTRAL.size + n : at + _CENTRAL.size + n + x]
        at += _CENTRAL.size + n + x + c

        readings = _readings(raw, flags, extra)
        for name in readings:
            _need(_safe(name), "the ZIP package contains an unsafe entry path")
        plain, name = readings
        _need(plain.endswith("/") == name.endswith("/"), "a ZIP entry and its Unicode path field disagree about being a directory")
        for reading, known in zip((name, plain), seen):
            key = _folded(reading)
            _need(key not in known, f"the ZIP package contains a duplicate entry: {reading}")
            known[key] = True
        _need((attrs >> 16) & 0xF000 != 0xA000, "symbolic links are not allowed in document packages")
        is_dir = name.endswith("/")
        _need(not is_dir or csize == usize == 0, f"a ZIP directory entry declares content: {name}")
        total += usize
        _need(total <= MAX_TOTAL, "the ZIP package expands beyond the supported size limit")

        entry = Entry(idx, name, raw, flags, method, crc, csize, usize, offset, is_dir)
        entry.data_at = _local_data(content, entry, start)
        package.entries[name] = entry
    _need(at == end, "the ZIP central directory size is inconsistent")
    return package


def _local_data(content: bytes, e: Entry, limit: int) -> int:
    """Where an entry's data starts; its local header must tell the same story as the directory."""
    ok = e.offset + _LOCAL.size <= limit and content.startswith(b"PK\x03\x04", e.offset)
    _need(ok, f"the local ZIP header for {e.name} is invalid")
    (_, _, flags, method, _, _, _, _, _, n, x) = _LOCAL.unpack_from(content, e.offset)
    names = e.offset + _LOCAL.size
    data = names + n + x
    same = flags == e.flags and method == e.method and content[names : names + n] == e.raw_name and data + e.csize <= limit
    _need(same, f"the local ZIP entry for {e.name} is inconsistent")
    _, effective = _readings(e.raw_name, flags, content[names + n : data])
    _need(effective == e.name, f"the local ZIP header for {e.name} declares a different Unicode path")
    return data
