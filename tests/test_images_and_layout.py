"""Tags of made images, and where rows of laid-out tables lie."""

import os
import struct

import pytest

from loamwork.sources.images import facts_of, image_facts, image_files
from loamwork.sources.layout import append_log, log_window, replace_partitions, write_laid_out


def made_block(order):
    """A TIFF block in either byte order, with a picture directory, a camera's and a place."""
    o = "<" if order == "II" else ">"
    tail, base = b"", 8 + (2 + 12 * 5 + 4) + (2 + 12 * 4 + 4) + (2 + 12 * 6 + 4)

    def entry(tag, kind, count, raw):
        nonlocal tail
        if len(raw) <= 4:
            return struct.pack(o + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        at = base + len(tail)
        tail += raw
        return struct.pack(o + "HHII", tag, kind, count, at)

    text = lambda tag, s: entry(tag, 2, len(s) + 1, s.encode() + b"\0")
    ratio = lambda tag, *v: entry(tag, 5, len(v), b"".join(struct.pack(o + "II", a, b) for a, b in v))
    short = lambda tag, n: entry(tag, 3, 1, struct.pack(o + "H", n))
    long = lambda tag, n: entry(tag, 4, 1, struct.pack(o + "I", n))
    photo, place = 8 + 66, 8 + 66 + 54
    main = [text(0x10F, "Acme"), text(0x110, "One II"), short(0x112, 6), long(0x8769, photo), long(0x8825, place)]
    own = [text(0x9003, "2026:08:09 14:12:03"), text(0x9011, "+02:00"), ratio(0x829D, (28, 10)), ratio(0x829A, (1, 0))]
    where = [text(1, "S"), ratio(2, (33, 1), (30, 1), (0, 1)), text(3, "W"), ratio(4, (70, 1), (45, 1), (36, 1)), ratio(6, (5205, 10)), text(29, "2026:08:09")]
    out = order.encode() + struct.pack(o + "HI", 42, 8)
    for of in (main, own, where):
        out += struct.pack(o + "H", len(of)) + b"".join(of) + b"\0" * 4
    assert len(out) == base
    return out + tail


def jpeg(block):
    app0 = b"\xff\xe0" + (16).to_bytes(2, "big") + b"JFIF".ljust(14, b"\0")
    return b"\xff\xd8" + app0 + b"\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + b"\xff\xda\0\0data\xff\xd9"


@pytest.mark.parametrize("order", ["II", "MM"])
def test_tags_of_both_byte_orders(order):
    block = made_block(order)
    png = b"\x89PNG\r\n\x1a\n" + (0).to_bytes(4, "big") + b"IHDR" + b"\0" * 4 + len(block).to_bytes(4, "big") + b"eXIf" + block + b"\0" * 4
    for data in (block, jpeg(block), png):
        f = facts_of(data)
        assert (f["taken_at"], f["camera"], f["orientation"]) == ("2026-08-09T14:12:03+02:00", "Acme One II", 6)
        assert (f["lat"], round(f["lon"], 6), f["alt"]) == (-33.5, -70.76, 520.5)
        assert f["tags"]["FNumber"] == "2.8" and f["tags"]["ExposureTime"] == "" and f["tags"]["GPSLatitude"] == "33, 30, 0"


def test_cut_off_and_untagged_images():
    block = made_block("MM")
    assert all(facts_of(x) is None for x in (None, b"", b"GIF89a", jpeg(b"nothing"), b"\xff\xd8\xff\xd9", block[:8], b"II*\0" + b"\xff" * 40))
    for n in range(len(block)):  # never an error, and what is whole stays
        f = facts_of(jpeg(block[:n]))
        assert f is None or set(f) == {"taken_at", "camera", "orientation", "lat", "lon", "alt", "tags"}
    f = facts_of(block[: 8 + 66])
    assert f["orientation"] == 6 and f["lat"] is None and f["taken_at"] is None
    loop = block[:8] + struct.pack(">H", 1) + struct.pack(">HHII", 0x8769, 4, 1, 8) + b"\0" * 8  # a directory that names itself
    assert facts_of(loop) is None


def test_image_files(spark, tmp_path):
    os.mkdir(f"{tmp_path}/deep")
    for name, data in (("a.jpg", jpeg(made_block("II"))), ("deep/b.tif", made_block("MM")), ("c.png", b"\x89PNG\r\n\x1a\n"), ("d.txt", made_block("MM"))):
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    files = image_files(spark, f"file://{tmp_path}")
    assert files.count() == 3
    got = {os.path.basename(r.path): r for r in image_facts(files).collect()}
    assert set(got) == {"a.jpg", "b.tif"} and got["a.jpg"].tags["Make"] == "Acme" and got["b.tif"].lat == -33.5
    assert image_facts(files.where("false")).collect() == []


def test_filters_prune_folders_and_others_keep_their_files(spark, tmp_path):
    folder = f"{tmp_path}/points"
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hidden' ELSE 'active' END AS status", "id % 5 AS kind", "id * 7 % 1000 AS at")
    write_laid_out(rows, folder, ["status", "kind"], "at")
    read = spark.read.parquet(folder)
    plan = read.where("status = 'active' AND kind = 2 AND at < 50")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan and "(status" in plan and "LessThan(at,50)" in plan
    files = lambda: {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(folder) for p in [os.path.join(d, n) for n in names if n.endswith(".parquet")]}
    before = files()
    replace_partitions(spark.createDataFrame([(5000, 1, "active", 2)], "id long, at long, status string, kind long"), folder, ["status", "kind"])
    after = files()
    changed = {os.path.dirname(p) for p in set(before) ^ set(after)}
    assert {os.path.basename(os.path.dirname(p)) + "/" + os.path.basename(p) for p in changed} == {"status=active/kind=2"}
    assert [r.id for r in spark.read.parquet(folder).where("status = 'active' AND kind = 2").collect()] == [5000] and spark.read.parquet(folder).where("kind <> 2").count() == 800


def test_log_windows_read_their_days(spark, tmp_path):
    folder = f"{tmp_path}/log"
    for k in range(2):
        append_log(spark.range(k * 50, k * 50 + 50).selectExpr("id", "id * 10000 AS at"), folder)
    got = log_window(spark, folder, 200_000, 400_000)
    assert sorted(r.id for r in got.collect()) == list(range(20, 40)) and got.columns == ["id", "at"]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()
