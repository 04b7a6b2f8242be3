"""Options of diff and patch operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.codecs import ALIASES, COMPRESS
from .functions.formats import ENCODE, STEP_BYTES
from .operators.pairs import FINDERS


@dataclass(frozen=True)
class DiffOptions:
    """How to make a diff: container, compressor, matcher and sizes."""

    kind: str = "steps"
    packing: str = "zlib"
    finder: str = "block"
    block_size: int = 64
    step_bytes: int = STEP_BYTES
    checksum: str = "sha256"
    ignore_old: str = ""
    ignore_new: str = ""
    refuse_equal: bool = False
    verify: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ENCODE:
            raise ValueError(f"no container {self.kind!r}")
        if ALIASES.get(self.packing, self.packing) not in COMPRESS:
            raise ValueError(f"no compressor {self.packing!r}")
        if self.finder not in FINDERS:
            raise ValueError(f"no matcher {self.finder!r}")
        if self.block_size < 4 or self.step_bytes < 1:
            raise ValueError("block sizes start at 4 bytes, steps at 1")


@dataclass(frozen=True)
class PatchOptions:
    """What to check when a diff is applied."""

    check_old: bool = True
    check_new: bool = True
    ignore_extra: bool = True


def block_size_for(old_size: int, wanted: int) -> int:
    """A block size that leaves a small old stream some 64 blocks, 4 or more."""
    part = -(-max(1, old_size) // 64)
    return max(4, min(wanted, -(-part // 64) * 64))


def block_size_of(old_size: Column, wanted: int) -> Column:
    """:func:`block_size_for` of a LONG column."""
    part = F.ceil(F.greatest(old_size, F.lit(1)) / 64)
    return F.greatest(F.lit(4), F.least(F.lit(wanted), F.ceil(part / 64) * 64)).cast("long")


def parse_size(text: str) -> int:
    """Bytes of a number with an optional k, m or g (times 1024)."""
    factor = {"k": 10, "m": 20, "g": 30}.get(text[-1:].lower())
    number = text[:-1] if factor else text
    if not number.isdigit():
        raise ValueError(f"no size: {text!r}")
    return int(number) << (factor or 0)
