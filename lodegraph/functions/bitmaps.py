"""Compressed bitmaps over dense integer codes: one container per 65,536 codes."""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
SPARSE = 4096


class Bitmap:
    """Containers hold sorted 16-bit offsets while they are few, else packed bits."""

    def __init__(self, boxes: dict[int, np.ndarray] | None = None):
        self.boxes = boxes or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        high = codes // SPAN
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] // SPAN): cls._pack((part % SPAN).astype(np.uint16)) for part in np.split(codes, cuts) if len(part)})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= SPARSE:
            return low
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _low(box: np.ndarray) -> np.ndarray:
        return box if box.dtype == np.uint16 else np.flatnonzero(np.unpackbits(box)).astype(np.uint16)

    @staticmethod
    def _bits(box: np.ndarray) -> np.ndarray:
        if box.dtype == np.uint8:
            return box
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[box] = 1
        return np.packbits(bits)

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for k, a in self.boxes.items():
            b = other.boxes.get(k)
            if b is None:
                out[k] = a
            elif a.dtype == np.uint16:
                rest = a[(self._bits(b)[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 == 0]
                if len(rest):
                    out[k] = rest
            else:
                rest = a & ~self._bits(b)
                if rest.any():
                    low = self._low(rest)
                    out[k] = low if len(low) <= SPARSE else rest
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        parts = [k * SPAN + self._low(b).astype(np.int64) for k, b in sorted(self.boxes.items())]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
