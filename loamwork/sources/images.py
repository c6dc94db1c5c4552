"""What image files say of themselves: the tags that cameras write, read in one Arrow pass over whole files.

A TIFF directory is a count and entries of twelve bytes (tag, kind, count, value or its place); JPEG and PNG files carry such a block in a segment of their own.
Whatever points outside the block or is cut off is left out, and the rest still counts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.operators.guards import rows_of

# Numbers and names of tags, by the directory they stand in.
_MAIN = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x8769: "ExifIFD", 0x8825: "GPSIFD",
}
_PHOTO = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "PhotographicSensitivity", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension",
    0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA405: "FocalLengthIn35mmFilm", 0xA433: "LensMake", 0xA434: "LensModel",
}
_PLACE = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
# Letter of each kind of value for ``struct``; rationals are pairs.
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
_LONGEST = 200

FACTS = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("taken_at", "string"), ("camera", "string"), ("orientation", "long"), ("lat", "double"), ("lon", "double"), ("alt", "double"))]}
).add("tags", T.MapType(T.StringType(), T.StringType()))


def tag_block(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG, PNG or TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(2, size)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _directory(block: bytes, order: str, at: int, names: dict[int, str]) -> Iterator[tuple[str, list]]:
    if not 8 <= at <= len(block) - 2:
        return
    (n,) = struct.unpack_from(order + "H", block, at)
    for k in range(at + 2, min(at + 2 + 12 * n, len(block) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", block, k)
        letter = _KINDS.get(kind)
        if tag not in names or not letter:
            continue
        size = count * struct.calcsize("=" + letter)
        place = k + 8 if size <= 4 else struct.unpack_from(order + "I", block, k + 8)[0]
        if place + size > len(block):
            continue
        if letter == "s":
            yield names[tag], [block[place : place + size].split(b"\0")[0].decode("utf-8", "replace").strip()]
            continue
        found = struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", block, place)
        # a rational without a denominator has no value
        yield names[tag], [a / b if b else None for a, b in zip(found[::2], found[1::2], strict=True)] if len(letter) == 2 else list(found)


def _degrees(found: dict[str, list], name: str, negative: str) -> float | None:
    parts = found.get(name, [])
    if len(parts) < 3 or None in parts[:3]:
        return None
    size = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -size if found.get(name + "Ref") == [negative] else size


def facts_of(data: bytes | None) -> dict | None:
    """taken_at, camera, orientation, lat, lon, alt and all known tags as text; null for a file without tags."""
    block = tag_block(data or b"")
    if not block or block[:4] not in (b"II*\0", b"MM\0*") or len(block) < 8:
        return None
    order = "<" if block[:1] == b"I" else ">"
    found: dict[str, list] = dict(_directory(block, order, struct.unpack_from(order + "I", block, 4)[0], _MAIN))
    for pointer, names in (("ExifIFD", _PHOTO), ("GPSIFD", _PLACE)):
        for at in found.pop(pointer, [])[:1]:
            found |= dict(_directory(block, order, at, names))
    if not found:
        return None
    first = lambda name: found[name][0] if found.get(name) else None
    taken = first("DateTimeOriginal")
    if taken:
        taken = taken.replace(":", "-", 2).replace(" ", "T", 1) + (first("OffsetTimeOriginal") or "")
    lat, lon = _degrees(found, "GPSLatitude", "S"), _degrees(found, "GPSLongitude", "W")
    placed = lat is not None and lon is not None
    number = lambda x: "" if x is None else x if isinstance(x, str) else f"{x:g}"
    tags = {name: ", ".join(map(number, values))[:_LONGEST] for name, values in sorted(found.items())}
    camera = " ".join(x for x in (first("Make"), first("Model")) if x) or None
    return {"taken_at": taken or None, "camera": camera, "orientation": first("Orientation"), "lat": lat if placed else None, "lon": lon if placed else None, "alt": first("GPSAltitude") if placed else None, "tags": tags}


def image_files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,tif,tiff}") -> DataFrame:
    """(id, path, data) of whole image files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.sha2("content", 256).alias("id"), "path", F.col("content").alias("data"))


def image_facts(files: DataFrame) -> DataFrame:
    """(id, path, taken_at, camera, orientation, lat, lon, alt, tags) of images (id, path, data) that carry tags; the others give no row."""
    return rows_of(files, ["id", "path"], ["data"], FACTS, lambda d: [(*list(f.values())[:-1], list(f["tags"].items()))] if (f := facts_of(d)) else [])
