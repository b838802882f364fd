"""Decoders of detector frames and headers, for use inside Arrow maps: bytes in, arrays and settings out."""

from __future__ import annotations

import configparser
import re
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np


def tiff(raw: bytes) -> np.ndarray:
    """The first image of a baseline TIFF: grey, strips, uncompressed or deflate, 8 to 64 bits."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    kinds = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in kinds:
            continue
        size = n * struct.calcsize(kinds[kind])
        place = at + 10 + 12 * i
        if size > 4:
            place = struct.unpack(order + "I", raw[place : place + 4])[0]
        tags[tag] = list(struct.unpack(order + str(n) + kinds[kind], raw[place : place + size]))
    width, height = tags[256][0], tags[257][0]
    packed = tags.get(259, [1])[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packed} isn't supported")
    data = b"".join(zlib.decompress(raw[o : o + n]) if packed != 1 else raw[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    dtype = np.dtype({1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(tags.get(258, [8])[0] // 8)).newbyteorder(order)
    return np.frombuffer(data, dtype, width * height).reshape(height, width)


def tiff_bytes(image: np.ndarray) -> bytes:
    """A little-endian one-strip TIFF of a 2-D array."""
    image = np.ascontiguousarray(image)
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    data = image.astype(image.dtype.newbyteorder("<")).tobytes()
    entries = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, image.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(data)), (339, 3, kind)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


def raw_frame(raw: bytes, shape: tuple[int, int], dtype: str = "<u2", flip: bool = False) -> np.ndarray:
    image = np.frombuffer(raw, dtype, shape[0] * shape[1]).reshape(shape)
    return image[::-1] if flip else image


def xim(raw: bytes, pixels: bool = True) -> tuple[np.ndarray | None, dict]:
    """(image, properties) of a compressed detector frame; without ``pixels`` they are skipped and the image is None.

    After the header come the first row and one pixel in full, then differences of 1, 2 or 4 bytes whose sizes two
    bits each tell. A difference adds to left + above - above left, so that a row is a running sum of the differences
    plus the row above.
    """
    at = 8
    _, width, height, _, _, packed = struct.unpack("<6i", raw[at : at + 24])
    at += 24
    image = None
    if not pixels:
        if packed:
            at += 4 + struct.unpack("<i", raw[at : at + 4])[0]
        at += 4 + struct.unpack("<i", raw[at : at + 4])[0] + 4 * bool(packed)
    elif packed:
        n = struct.unpack("<i", raw[at : at + 4])[0]
        table = np.frombuffer(raw, np.uint8, n, at + 4)
        at += 4 + n + 4
        sizes = np.stack([table >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()[: width * height - width - 1]
        head = np.frombuffer(raw, "<i4", width + 1, at).astype(np.int64)
        at += 4 * (width + 1)
        length = 1 << sizes.astype(np.int64)
        ends = np.cumsum(length)
        place = at + ends - length
        buffer = np.frombuffer(raw, np.uint8)
        diff = np.zeros(len(sizes), np.int64)
        for code, kind in ((0, "<i1"), (1, "<i2"), (2, "<i4")):
            pick = np.flatnonzero(sizes == code)
            size = 1 << code
            diff[pick] = buffer[place[pick, None] + np.arange(size)].copy().view(kind).ravel()
        at += int(ends[-1]) if len(ends) else 0
        at += 4
        image = np.zeros((height, width), np.int64)
        image[0] = head[:width]
        image[1, 0] = head[width]
        # With d the mixed difference, each row's step against the row above is a running sum along the row.
        steps = np.zeros((height, width), np.int64)
        steps.ravel()[width + 1 :] = diff
        for r in range(1, height):
            if r == 1:
                steps[1, 0] = image[1, 0] - image[0, 0]
                image[1] = image[0] + np.cumsum(steps[1])
            else:
                # The first pixel's neighbours are the last ones of the rows before.
                left, above, corner = image[r - 1, -1], image[r - 1, 0], image[r - 2, -1]
                steps[r, 0] += left + above - corner - image[r - 1, 0]
                image[r] = image[r - 1] + np.cumsum(steps[r])
    else:
        n = struct.unpack("<i", raw[at : at + 4])[0]
        image = np.frombuffer(raw, "<i4", width * height, at + 4).reshape(height, width).astype(np.int64)
        at += 4 + n
    bins = struct.unpack("<i", raw[at : at + 4])[0]
    at += 4 + 4 * bins
    properties: dict = {}
    if at + 4 <= len(raw):
        count = struct.unpack("<i", raw[at : at + 4])[0]
        at += 4
        for _ in range(count):
            n = struct.unpack("<i", raw[at : at + 4])[0]
            name = raw[at + 4 : at + 4 + n].decode("utf-8", "replace")
            kind = struct.unpack("<i", raw[at + 4 + n : at + 8 + n])[0]
            at += 8 + n
            if kind in (0, 1):
                properties[name] = struct.unpack("<i" if kind == 0 else "<d", raw[at : at + (4 if kind == 0 else 8)])[0]
                at += 4 if kind == 0 else 8
            else:
                n = struct.unpack("<i", raw[at : at + 4])[0]
                body = raw[at + 4 : at + 4 + n]
                properties[name] = body.decode("utf-8", "replace") if kind == 2 else np.frombuffer(body, "<f8" if kind == 4 else "<i4").tolist()
                at += 4 + n
    return image, properties


def meta_image(raw: bytes) -> tuple[np.ndarray, dict]:
    """(volume, header) of a MetaImage file that holds its own data."""
    header: dict[str, str] = {}
    at = 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        key, _, value = raw[at:end].decode("ascii", "replace").partition("=")
        header[key.strip()] = value.strip()
        at = end + 1
        if key.strip() == "ElementDataFile":
            break
    dtype = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}[header["ElementType"]]
    order = ">" if header.get("BinaryDataByteOrderMSB", "False").lower() == "true" else "<"
    size = [int(x) for x in header["DimSize"].split()]
    body = zlib.decompress(raw[at:]) if header.get("CompressedData", "False").lower() == "true" else raw[at:]
    return np.frombuffer(body, order + dtype, int(np.prod(size))).reshape(size[::-1]), header


def ini(text: str) -> dict[str, dict[str, str]]:
    """Sections of an INI-like header; keys in lower case, repeated keys keep the last value."""
    parser = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True)
    parser.read_string(text.lstrip("﻿"))
    return {s: dict(parser.items(s)) for s in parser.sections()}


def tab_header(text: str) -> dict[str, str]:
    """Name and value of each line that a tab or an equals sign splits."""
    return {k.strip(): v.strip() for line in text.splitlines() for k, s, v in [re.split(r"(\t+|=)", line, maxsplit=1) if re.search(r"\t|=", line) else ("", "", "")] if s}


def xml_values(text: str) -> dict[str, str]:
    """Texts of the leaves of an XML header by their path without namespaces; the first of several counts."""
    out: dict[str, str] = {}

    def walk(e: ET.Element, path: str) -> None:
        here = f"{path}/{e.tag.rpartition('}')[2]}".lstrip("/")
        for k, v in e.attrib.items():
            out.setdefault(f"{here}@{k.rpartition('}')[2]}", v)
        if len(e) == 0:
            out.setdefault(here, (e.text or "").strip())
        for child in e:
            walk(child, here)

    walk(ET.fromstring(text), "")
    return out
