"""Images and limits that the codecs share."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: The largest side, number of channels and bytes of an image.
SIDE, CHANNELS, BYTES = 65_535, 32, 2 << 30


class Unsupported(ValueError):
    """The file is of a kind, or uses a part of it, that isn't read here."""


class Damaged(ValueError):
    """The file breaks its format's rules."""


@dataclass
class Image:
    """Samples of a raster, interleaved and row by row; 16-bit samples are big-endian."""

    width: int
    height: int
    channels: int
    data: bytes
    bits: int = 8
    color_space: str = "RGB"
    dpi_x: int = 300
    dpi_y: int = 300
    alpha: bool = False
    icc: bytes | None = None
    spots: list[str] = field(default_factory=list)

    def __post_init__(self):
        check_size(self.width, self.height, self.channels, self.bits)
        need = self.width * self.height * self.channels * self.bits // 8
        if len(self.data) < need:
            raise Damaged(f"{len(self.data)} bytes of {need}")
        self.data = bytes(self.data[:need])
        self.dpi_x, self.dpi_y = (d if d and d > 0 else 300 for d in (self.dpi_x, self.dpi_y))

    def array(self) -> np.ndarray:
        """(height, width, channels)."""
        kind = np.uint8 if self.bits == 8 else np.dtype(">u2")
        return np.frombuffer(self.data, kind).reshape(self.height, self.width, self.channels)


def check_size(width: int, height: int, channels: int = 1, bits: int = 8) -> None:
    if not (0 < width <= SIDE and 0 < height <= SIDE and 0 < channels <= CHANNELS):
        raise Damaged(f"an image of {width} x {height} x {channels}")
    if width * height * channels * bits // 8 > BYTES:
        raise Damaged("an image of more than 2 GiB")


SPACES = {1: "GRAY", 2: "GRAY", 3: "RGB", 4: "RGB"}
