"""OLE compound files: streams by name, every chain walked within bounds."""

from __future__ import annotations

import struct

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
MAX_STREAM = 1 << 30


class CompoundError(ValueError):
    pass


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise CompoundError(message)


class CompoundFile:
    """streams: (name, kind, first sector, size) of each directory entry that is in use."""

    def __init__(self, data: bytes):
        _need(len(data) >= 512 and data.startswith(SIGNATURE), "the OLE compound-document header is invalid")
        major, order, shift, mini_shift = struct.unpack_from("<4H", data, 26)
        _need(order == 0xFFFE, "the OLE compound-document header is invalid")
        _need((major, shift) in ((3, 9), (4, 12)) and mini_shift == 6, "the OLE sector layout is unsupported")
        n_fat, first_dir, _, cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<8L", data, 44)
        _need(cutoff == 4096, "the OLE file size or mini-stream cutoff is invalid")
        self.data, self.size, self.cutoff = data, 1 << shift, cutoff
        fat_sectors = [s for s in struct.unpack_from("<109L", data, 76) if s < DIFAT]
        seen, at = set(), first_difat
        while at < DIFAT and len(seen) < n_difat:
            _need(at not in seen, "the OLE DIFAT chain is invalid")
            seen.add(at)
            *more, at = struct.unpack(f"<{self.size // 4}L", self.sector(at))
            fat_sectors += [s for s in more if s < DIFAT]
        _need(len(fat_sectors) >= n_fat, "the OLE FAT sector list is incomplete")
        self.fat: list[int] = []
        for s in fat_sectors[:n_fat]:
            self.fat += struct.unpack(f"<{self.size // 4}L", self.sector(s))
        directory = self.chain(first_dir)
        _need(len(directory) >= 128, "the OLE directory stream is truncated")
        self.streams = []
        for at in range(0, len(directory) - 127, 128):
            entry = directory[at : at + 128]
            length, kind = struct.unpack_from("<HB", entry, 64)
            if kind == 0:
                continue
            _need(2 <= length <= 64 and length % 2 == 0, "an OLE directory name is invalid")
            first, size = struct.unpack_from("<LQ", entry, 116)
            size &= 0xFFFFFFFF if major == 3 else (1 << 64) - 1
            _need(size <= MAX_STREAM, "an OLE stream exceeds the supported size limit")
            self.streams.append((entry[: length - 2].decode("utf-16-le", "replace"), kind, first, size))
        root = next((s for s in self.streams if s[1] == 5), None)
        _need(root is not None, "the OLE root directory is missing")
        self.mini = self.chain(root[2])[: root[3]] if root[3] else b""
        raw = self.chain(first_mini) if first_mini < DIFAT else b""
        self.mini_fat = struct.unpack(f"<{len(raw) // 4}L", raw)

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        _need(at + self.size <= len(self.data), "an OLE sector lies outside the file")
        return self.data[at : at + self.size]

    def chain(self, first: int) -> bytes:
        out, seen, at = [], set(), first
        while at != END:
            _need(at < len(self.fat) and at not in seen, "an OLE sector chain is invalid")
            seen.add(at)
            out.append(self.sector(at))
            at = self.fat[at]
        return b"".join(out)

    def read(self, first: int, size: int) -> bytes:
        if size >= self.cutoff:
            got = self.chain(first)
            _need(len(got) >= size, "an OLE stream is shorter than declared")
            return got[:size]
        out, seen, at = [], set(), first
        while size and at != END:
            _need(at < len(self.mini_fat) and at not in seen, "an OLE mini-sector chain is invalid")
            _need((at + 1) * 64 <= len(self.mini) + 63, "an OLE mini-sector lies outside the mini stream")
            seen.add(at)
            out.append(self.mini[at * 64 : at * 64 + 64])
            at = self.mini_fat[at]
        got = b"".join(out)
        _need(len(got) >= size, "an OLE mini stream is shorter than declared")
        return got[:size]

    def stream(self, *names: str) -> bytes | None:
        """The first of the named streams, without regard to case."""
        for name in names:
            for own, kind, first, size in self.streams:
                if kind == 2 and own.lower() == name.lower():
                    return self.read(first, size)
        return None

    def has(self, *names: str) -> bool:
        return any(own.lower() in {n.lower() for n in names} for own, *_ in self.streams)
