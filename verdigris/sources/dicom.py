"""Header tags of DICOM files, read up to the pixels, in plain Python: enough for grouping and choosing series."""

from __future__ import annotations

import struct

#: The tags that series are grouped and judged by, their names here, and whether they are text, numbers or unsigned shorts.
TAGS = {
    (0x0008, 0x0008): ("image_type", "text"),
    (0x0008, 0x0032): ("acquisition_time", "text"),
    (0x0008, 0x0060): ("modality", "text"),
    (0x0008, 0x103E): ("series_description", "text"),
    (0x0018, 0x0010): ("contrast", "text"),
    (0x0018, 0x0020): ("scanning_sequence", "text"),
    (0x0018, 0x0024): ("sequence_name", "text"),
    (0x0018, 0x0050): ("slice_thickness", "number"),
    (0x0018, 0x0081): ("echo_time", "number"),
    (0x0018, 0x1030): ("protocol_name", "text"),
    (0x0020, 0x000D): ("study_uid", "text"),
    (0x0020, 0x000E): ("series_uid", "text"),
    (0x0020, 0x0011): ("series_number", "number"),
    (0x0020, 0x0013): ("instance_number", "number"),
    (0x0020, 0x0032): ("image_position", "numbers"),
    (0x0020, 0x0037): ("image_orientation", "numbers"),
    (0x0028, 0x0010): ("rows", "short"),
    (0x0028, 0x0011): ("columns", "short"),
    (0x0028, 0x0030): ("pixel_spacing", "numbers"),
}
SCHEMA = "image_type string, acquisition_time string, modality string, series_description string, contrast string, scanning_sequence string, sequence_name string, slice_thickness double, echo_time double, protocol_name string, study_uid string, series_uid string, series_number double, instance_number double, image_position array<double>, image_orientation array<double>, rows int, columns int, pixel_spacing array<double>"
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
_IMPLICIT = b"1.2.840.10008.1.2"
_UNDEFINED = 0xFFFFFFFF


def _value(raw: bytes, kind: str) -> object:
    if kind == "short":
        return struct.unpack("<H", raw[:2])[0] if len(raw) >= 2 else None
    text = raw.decode("latin-1").strip("\0 ")
    if kind == "text":
        return text or None
    try:
        numbers = [float(x) for x in text.split("\\")] if text else []
    except ValueError:
        return None
    return (numbers or None) if kind == "numbers" else (numbers[0] if numbers else None)


def header(content: bytes) -> dict | None:
    """The known tags of a little-endian file, null if it is none. Sequences are stepped over; reading ends before the pixels."""
    if len(content) < 132 or content[128:132] != b"DICM":
        return None
    at, implicit, depth, out = 132, False, 0, {}
    syntax = b""
    while at + 8 <= len(content):
        group, element = struct.unpack_from("<HH", content, at)
        if group > 0x0002 and depth == 0 and syntax.rstrip(b"\0 ") == _IMPLICIT:
            implicit = True
        if group == 0xFFFE:  # items and their ends have no type
            size = struct.unpack_from("<I", content, at + 4)[0]
            at += 8
            depth += {0xE000: size == _UNDEFINED, 0xE00D: -1, 0xE0DD: -1}.get(element, 0)
            if element == 0xE000 and size != _UNDEFINED:
                at += size
            continue
        if (group, element) == (0x7FE0, 0x0010):
            break
        kind = content[at + 4 : at + 6]
        if implicit and group > 0x0002:
            size, at = struct.unpack_from("<I", content, at + 4)[0], at + 8
        elif kind in _LONG:
            size, at = struct.unpack_from("<I", content, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", content, at + 6)[0], at + 8
        if size == _UNDEFINED:
            depth += 1
            continue
        if (group, element) == (0x0002, 0x0010):
            syntax = content[at : at + size]
        if depth == 0 and (group, element) in TAGS:
            name, form = TAGS[group, element]
            out[name] = _value(content[at : at + size], form)
        at += size
    return out
