"""Extents of media containers, from the headers of their elements alone.

Every format is a reader that looks at one offset and says how long the element there is, or that
there is none. A container is the unbroken run of valid elements; since an element is never empty
and must end inside the image, the walk always ends and never leaves the image.
"""

from __future__ import annotations

from collections.abc import Callable

#: Element ids of Matroska (EBML), bytes as written, and filler words of disk images.
EBML_TOP = {0x1A45DFA3, 0x18538067, 0xEC, 0xBF}
EBML_SEGMENT = {
    0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367,
    0xEC, 0xBF,
}
EBML_CLUSTER = {0xE7, 0xA7, 0xAB, 0xA3, 0xA0, 0xAF, 0x5854, 0xEC, 0xBF}
FILLER = {b"\xb9\xb9\xb9\xb9", b"\x00\x00\x00\x00", b"\xff\xff\xff\xff"}
FLV_TAGS = {8, 9, 18}

Bytes = Callable[[int, int], bytes]
#: (offset, first element of the container?) -> length of the element, 0 if there is none.
Header = Callable[[int, bool], int]


class Window:
    """Reads of a file through one buffered window, for many small neighbouring reads."""

    def __init__(self, read_at: Bytes, width: int = 1 << 16):
        self.read_at, self.width = read_at, width
        self.start, self.data = 0, b""

    def __call__(self, offset: int, n: int) -> bytes:
        if not (self.start <= offset and offset + n <= self.start + len(self.data)):
            self.start, self.data = offset, self.read_at(offset, max(n, self.width))
        at = offset - self.start
        return self.data[at : at + n]


def run_of_elements(header: Header, start: int, size: int) -> tuple[int, int]:
    """End and number of the valid elements that follow each other from `start`."""
    end, count = start, 0
    while end < size:
        length = header(end, count == 0)
        if not 0 < length <= size - end:
            break
        end, count = end + length, count + 1
    return end, count


def box_header(at: Bytes, size: int) -> Header:
    """ISO base media boxes: 32-bit length and name, a 64-bit length if the first is 1.

    Length 0 reaches to the end of the image, and is believed of the first box only: behind other
    boxes a zero word is filler.
    """

    def length(offset: int, first: bool) -> int:
        head = at(offset, 16)
        name = head[4:8].decode("latin1")
        if len(name) < 4 or not all(c.isalnum() or c in " _-" for c in name):
            return 0
        if not first and head[:4] in FILLER:
            return 0
        short = int.from_bytes(head[:4], "big")
        if short == 0:
            return size - offset
        if short == 1:
            wide = int.from_bytes(head[8:16], "big")
            return wide if len(head) == 16 and wide >= 16 else 0
        return short if short >= 8 else 0

    return length


def flv_tag(at: Bytes, size: int) -> Header:
    """The back pointer before an FLV tag, the tag's header and its data."""

    def length(offset: int, first: bool) -> int:
        head = at(offset, 8)
        if len(head) < 8 or head[4] not in FLV_TAGS or (not first and head[:4] in FILLER):
            return 0
        return 4 + 11 + int.from_bytes(head[5:8], "big")

    return length


def _vint(data: bytes, keep_mark: bool) -> tuple[int, int]:
    """Value and width of an EBML number; width 0 if there is none. All ones is -1."""
    if not data or data[0] == 0:
        return 0, 0
    width = 9 - data[0].bit_length()
    if len(data) < width:
        return 0, 0
    value = int.from_bytes(data[:width], "big")
    if keep_mark:
        return value, width
    value -= 1 << (7 * width)
    return (-1 if value == (1 << (7 * width)) - 1 else value), width


def ebml_element(at: Bytes, size: int, known: set[int] | None = None) -> Header:
    """EBML elements of known ids; one of unknown length lasts as long as its children do."""
    known = EBML_TOP if known is None else known
    inside = {0x18538067: EBML_SEGMENT, 0x1F43B675: EBML_CLUSTER}

    def length(offset: int, first: bool) -> int:
        head = at(offset, 12)
        name, wide = _vint(head, keep_mark=True)
        if not wide or wide > 4 or name not in known:
            return 0
        body, more = _vint(head[wide:], keep_mark=False)
        if not more:
            return 0
        start = offset + wide + more
        if body >= 0:
            # a recording that was cut off ends with the image
            return min(start + body, size) - offset
        if name not in inside:
            return 0
        end, _ = run_of_elements(ebml_element(at, size, inside[name]), start, size)
        return end - offset

    return length


def extent(kind: str, at: Bytes, marker: int, size: int) -> tuple[int, int, int]:
    """Start, end and number of elements of the container whose marker is at `marker`."""
    if kind == "mp4":
        start = marker - 4
        return (start, *run_of_elements(box_header(at, size), start, size))
    if kind == "flv":
        # the header tells its own length, 9 in all files of version 1
        told = at(marker + 5, 4)
        body = marker + (int.from_bytes(told, "big") if len(told) == 4 else 9)
        if not marker + 9 <= body <= size:
            return marker, marker, 0
        return (marker, *run_of_elements(flv_tag(at, size), body, size))
    return (marker, *run_of_elements(ebml_element(at, size), marker, size))
