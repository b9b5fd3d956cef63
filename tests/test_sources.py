import io
import json
import struct
import zlib

import numpy as np
import pytest

from rdspark.operators import curation as cu, packets as pk
from rdspark.sources import images, manifests, packets as sp, rawvideo as rv
from test_pixels import rows


# ------------------------------------------------------------------ raw video


def test_raw_video_file(spark, tmp_path):
    data, _ = rows(spark, 7, 8, 4)
    raw = b"".join(p.tobytes() for f in data for p in f)
    (tmp_path / "clip.yuv").write_bytes(raw + b"\0" * 20)      # a tail inside the luma ends the stream
    df = rv.read_raw_video(spark, str(tmp_path / "clip"), 8, 4).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in df] == list(range(7)) and {r["sequence"] for r in df} == {"clip"}
    assert all(bytes(r[f"p{k}"]) == data[i][k].tobytes() for i, r in enumerate(df) for k in range(3))
    assert spark.read.format("yuv420").option("width", 8).option("height", 4).load(str(tmp_path / "clip.yuv")).count() == 7
    some = rv.read_raw_video(spark, str(tmp_path / "clip.yuv"), 8, 4, skip_frame=2, max_frames=3).orderBy("frame_idx").collect()
    assert [bytes(r["p0"]) for r in some] == [data[i][0].tobytes() for i in (2, 3, 4)] and some[0]["frame_idx"] == 0
    assert rv.read_raw_video(spark, str(tmp_path / "clip.yuv"), 8, 4, skip_frame=9).count() == 0
    (tmp_path / "bad.yuv").write_bytes(raw + b"\0" * 40)
    with pytest.raises(Exception, match="inside the chroma"):
        rv.read_raw_video(spark, str(tmp_path / "bad.yuv"), 8, 4).count()
    with pytest.raises(Exception):
        rv.read_raw_video(spark, str(tmp_path / "none"), 8, 4).count()


def test_long_video_is_split(spark, tmp_path, monkeypatch):
    data, df = rows(spark, 40, 8, 4)
    monkeypatch.setattr(rv, "SPLIT_BYTES", 48 * 7)
    reader = rv._Reader({"path": str(tmp_path / "v"), "width": "8", "height": "4"})
    rv.write_raw_video(df, str(tmp_path / "v"), segment_frames=16)
    assert sorted(p.name for p in (tmp_path / "v" / "s").iterdir()) == [f"seg-{i:012d}.yuv" for i in (0, 16, 32)]
    parts = reader.partitions()
    assert len(parts) == 8 and sum(r[-1] for p in parts for r in p.ranges) == 40
    joined = b"".join(p.read_bytes() for p in sorted((tmp_path / "v" / "s").iterdir()))
    assert joined == b"".join(p.tobytes() for f in data for p in f)
    back = rv.read_raw_video(spark, str(tmp_path / "v"), 8, 4).orderBy("frame_idx").collect()
    assert [bytes(r["p2"]) for r in back] == [f[2].tobytes() for f in data]


@pytest.mark.parametrize("layout,depth", [("444", 8), ("rgb", 12), ("420", 10)])
def test_layouts(spark, tmp_path, layout, depth):
    data, df = rows(spark, 5, 8, 4, depth=depth, layout=layout)
    rv.write_raw_video(df, str(tmp_path / "v"))
    back = rv.read_raw_video(spark, str(tmp_path / "v"), 8, 4, layout=layout, bit_depth=depth).orderBy("frame_idx").collect()
    assert [[bytes(r[f"p{k}"]) for k in range(3)] for r in back] == [[p.tobytes() for p in f] for f in data]


def test_gaps_are_refused(spark, tmp_path):
    _, df = rows(spark, 5, 8, 4)
    with pytest.raises(Exception, match="gap or a repeat"):
        rv.write_raw_video(df.filter("frame_idx <> 2"), str(tmp_path / "v"))
    with pytest.raises(ValueError):
        rv.plane_sizes(8, 4, "422", 8)


# ------------------------------------------------------------------ packets


def length(n, dialect):
    if dialect == "sps_qp":
        return struct.pack(">H", n) if n <= 32767 else struct.pack(">I", n | 1 << 31)
    return bytes([n]) if n < 128 else struct.pack(">H", n | 0x8000) if n < 16384 else struct.pack(">I", n | 0xC0000000)


SIZES = [0, 1, 127, 128, 16383, 16384, 32767, 32768, 70000]


def build(dialect):
    out = bytes([0x05]) + length(1080, dialect) + length(1920, dialect)
    out += {"current": b"", "sps_flags": bytes([0b101]), "sps_qp": bytes([(33 << 2) + 2])}[dialect]
    for i, n in enumerate(SIZES):
        out += bytes([(0x10 if i == 0 else 0x20) + 5])
        out += {"current": bytes([40 + i, (i << 1) + i % 2]), "sps_flags": bytes([40 + i]), "sps_qp": b""}[dialect]
        out += length(n, dialect) + bytes([i]) * n
    return out


@pytest.mark.parametrize("dialect", ["current", "sps_flags", "sps_qp"])
def test_units(spark, tmp_path, dialect):
    content = build(dialect)
    (tmp_path / "a.bin").write_bytes(content)
    (tmp_path / "a.json").write_text("{}")
    got = sp.read_packets(spark, str(tmp_path), dialect, payload=True).orderBy("unit_no").collect()
    assert [r["nal_type"] for r in got] == [0, 1] + [2] * (len(SIZES) - 1) and {r["sps_id"] for r in got} == {5}
    assert (got[0]["height"], got[0]["width"]) == (1080, 1920)
    assert [r["payload_len"] for r in got[1:]] == SIZES
    assert [bytes(r["payload"]) for r in got[1:]] == [bytes([i]) * n for i, n in enumerate(SIZES)]
    assert sum(r["unit_bytes"] for r in got) == len(content)
    assert all(content[r["byte_offset"]] & 15 == 5 for r in got)
    if dialect == "current":
        assert [(r["qp"], r["ec_part"], r["reset"]) for r in got[1:]] == [(40 + i, i, i % 2) for i in range(len(SIZES))]
    if dialect == "sps_flags":
        assert (got[0]["ec_part"], got[0]["use_ada_i"], got[1]["qp"]) == (1, 1, 40)
    if dialect == "sps_qp":
        assert (got[0]["qp"], got[0]["fa_idx"]) == (33, 2)


def test_multi_frame_units(spark):
    content = bytes([0x01]) + length(4, "sps_qp") * 2 + bytes([0]) + bytes([0x32, 0x12, 0x30]) + length(4, "sps_qp") + b"abcd"
    df = spark.createDataFrame([("s", bytearray(content))], "stream string, content binary")
    got = sp.parse_packets(df, dialect="sps_qp").orderBy("unit_no")
    assert got.collect()[1]["sps_ids"] == [1, 2, 3] and got.collect()[1]["frame_num"] == 3
    frames = pk.coded_frames(got.filter("nal_type = 3")).orderBy("unit_pos").collect()
    assert [(r["unit_pos"], r["sps_id"]) for r in frames] == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(sp.BadStream):
        list(sp.iter_units(io.BytesIO(content), len(content), "current"))


def test_broken_streams():
    content = build("current")
    for cut in (1, 3, len(content) - 1):
        with pytest.raises(sp.BadStream):
            list(sp.iter_units(io.BytesIO(content[:cut]), cut))
    with pytest.raises(ValueError):
        list(sp.iter_units(io.BytesIO(b""), 0, "other"))


# ------------------------------------------------------------------ pictures and manifests


def png(path, rgb):
    h, w, _ = rgb.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_png_sequences(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 255, (6, 4, 5, 3)).astype(np.uint8)
    for i in range(6):
        png(tmp_path / "in" / "short" / f"im{i + 1}.png", rgb[i])
        if i != 3:
            png(tmp_path / "in" / "long" / f"im{i + 1:05d}.png", rgb[i])
    png(tmp_path / "in" / "long" / "im4.png", rgb[0])     # the other rule's name does not count
    got = images.split_bgr(images.read_png_frames(spark, str(tmp_path / "in" / "*"), 5, 4)).orderBy("sequence", "frame_idx").collect()
    assert [(r["sequence"], r["frame_idx"]) for r in got] == [("long", i) for i in range(3)] + [("short", i) for i in range(6)]
    assert all(bytes(r[f"p{k}"]) == rgb[r["frame_idx"], :, :, k].tobytes() for r in got for k in range(3))
    assert [r["name"] for r in images.list_images(spark, str(tmp_path / "in" / "short"), ".png").collect()] == [f"im{i}.png" for i in range(1, 7)]
    with pytest.raises(Exception, match="unexpected picture size"):
        images.read_png_frames(spark, str(tmp_path / "in" / "*"), 6, 4).collect()
    png(tmp_path / "odd" / "x" / "im0001.png", rgb[0])
    with pytest.raises(Exception, match="naming convention"):
        images.read_png_frames(spark, str(tmp_path / "odd" / "*")).collect()


def test_image_folders_in_a_configuration(spark, tmp_path):
    from rdspark.operators.planning import expand_image_folders, job_matrix
    from rdspark.sources.configs import read_test_config
    for n in ("b.png", "a.png", "c.jpg"):
        (tmp_path / "kodak").mkdir(exist_ok=True)
        (tmp_path / "kodak" / n).write_bytes(b"x")
    (tmp_path / "conf.json").write_text(json.dumps({"root_path": str(tmp_path), "test_classes": {
        "K": {"test": 1, "base_path": "kodak", "src_type": "png", "img_folder": 1},
        "U": {"test": 1, "base_path": "U", "src_type": "yuv420", "sequences": {"x": {"width": 8, "height": 4, "frames": 10, "intra_period": -1}}}}}))
    conf = read_test_config(spark, str(tmp_path / "conf.json"))
    files = images.list_images(spark, str(tmp_path / "kodak"), "")
    jobs = job_matrix(expand_image_folders(conf, files), 2)
    assert {(r["dataset"], r["sequence"], r["qp_i"]) for r in jobs.collect()} == {
        ("K", n, q) for n in ("a.png", "b.png") for q in (0, 63)} | {("U", "x", q) for q in (0, 63)}


def test_manifests(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "description.json").write_text(json.dumps(["a.png", "b/c.png"]))
    got = manifests.read_image_manifest(spark, str(tmp_path / "i")).orderBy("image_id").collect()
    assert [(r["image_id"], r["path"]) for r in got] == [(0, f"{tmp_path}/i/a.png"), (1, f"{tmp_path}/i/b/c.png")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "description.json").write_text(json.dumps({"seqs": [{"path": "s1", "width": 64, "height": 32, "seq_length": 2},
                                                                          {"path": "s2", "width": 64, "height": 32, "seq_length": 3}],
                                                                 "frames": [f"im{i:05d}.png" for i in range(1, 5)]}, indent=1))
    seqs, names = manifests.read_video_manifest(spark, str(tmp_path / "v"))
    frames = cu.manifest_frames(seqs, names).orderBy("path", "frame_no").collect()
    assert [(r["path"], r["frame_name"]) for r in frames] == [("s1", "im00001.png"), ("s1", "im00002.png"), ("s2", "im00001.png"), ("s2", "im00002.png"), ("s2", "im00003.png")]
