"""Adapters: what tells a format from others and reads it; and a registry of them, in which each format has one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

from docloom.sources import cfb
from docloom.sources.xmltree import XmlError
from docloom.sources.zipgate import Package, PackageError, open_package


@dataclass(frozen=True)
class Format:
    """A format that an adapter offers: the only place where its extensions, container, tools and priority are declared."""

    name: str
    extensions: tuple[str, ...]
    priority: int
    container: str = "file"
    requires: tuple[str, ...] = ()


@dataclass
class Detection:
    """kind: match, invalid or none. parsed: what the adapter has read and convert() needs."""

    kind: str = "none"
    format: str | None = None
    priority: int = 0
    reason: str | None = None
    warnings: list[str] = field(default_factory=list)
    parsed: object = None


class Probe:
    """A document's bytes. What several adapters need of it is looked at when it is first asked for, and once."""

    def __init__(self, path: str, content: bytes, wanted: str | None):
        self.path, self.content = path, content
        #: The format of the path's extension. It is no evidence; it only tells a broken document from a strange one.
        self.wanted = wanted

    @cached_property
    def is_zip(self) -> bool:
        return self.content[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")

    @cached_property
    def _opened(self) -> tuple[Package | None, str | None]:
        if not self.is_zip:
            return None, None
        try:
            return open_package(self.content).verify(), None
        except (PackageError, XmlError) as e:
            return None, str(e)

    @property
    def package(self) -> Package | None:
        return self._opened[0]

    @property
    def package_error(self) -> str | None:
        return self._opened[1]

    @cached_property
    def mimetype(self) -> str | None:
        data = self.package.get("mimetype") if self.package else None
        return data.decode("utf-8", "replace").strip() if data is not None else None

    @cached_property
    def _compound(self) -> tuple[cfb.CompoundFile | None, str | None]:
        if not self.content.startswith(cfb.SIGNATURE):
            return None, None
        try:
            return cfb.CompoundFile(self.content), None
        except cfb.CompoundError as e:
            return None, str(e)

    @property
    def compound(self) -> cfb.CompoundFile | None:
        return self._compound[0]

    @property
    def compound_error(self) -> str | None:
        return self._compound[1]


class Adapter(Protocol):
    """What a format from outside has to offer. Adapters travel to the tasks, so they must be picklable."""

    formats: tuple[Format, ...]

    def detect(self, probe: Probe) -> Detection:
        """A match with its format, priority and expected warnings; invalid with the reason; or none."""

    def convert(self, probe: Probe, found: Detection, result, rendering: str):
        """The result, filled in: markdown and assets, or an error."""


class Registry:
    """Adapters in the order in which they are asked. Two that offer one format, or one extension, are refused."""

    def __init__(self, adapters: Iterable[Adapter]):
        self.adapters = tuple(adapters)
        self.formats: dict[str, Format] = {}
        self.extensions: dict[str, str] = {}
        for adapter in self.adapters:
            for f in adapter.formats:
                if f.name in self.formats:
                    raise ValueError(f"More than one adapter handles {f.name}")
                self.formats[f.name] = f
                for e in f.extensions:
                    if self.extensions.setdefault(e, f.name) != f.name:
                        raise ValueError(f"More than one format has the extension {e}")

    def with_adapter(self, adapter: Adapter) -> Registry:
        """A registry with one more adapter, which is asked last."""
        return Registry((*self.adapters, adapter))

    def place(self, fmt: str) -> int:
        """The number, from 0, of the adapter that handles a format."""
        return next(n for n, a in enumerate(self.adapters) if any(f.name == fmt for f in a.formats))

    def probe(self, path: str, content: bytes) -> Probe:
        name = path.rstrip("/").rpartition("/")[2]
        return Probe(path, content, self.extensions.get(name.rpartition(".")[2].lower()) if "." in name else None)

    def detect(self, probe: Probe) -> list[Detection]:
        """What each adapter says, in their order."""
        return [a.detect(probe) for a in self.adapters]
