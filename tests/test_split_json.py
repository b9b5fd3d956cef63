"""JSON documents cut anywhere: compact and indented, with quotes, brackets and backslashes inside strings."""

import json
import random

import pytest

from rdspark.operators import curation as cu
from rdspark.sources import manifests, result_logs as rl, split_json as sj

HARD = ['a"b', "back\\slash", "\\\\", '\\"', "{not: [a, bracket]}", "é 日本 \n\t", ",:,", "", "plain"]


def log(n, seed):
    r = random.Random(seed)
    return {f"{r.choice(HARD)}{k}": {f"{r.choice(HARD)}{j}": {f"{q:03d}": {"bpp": r.random(), "img_path": r.choice(HARD), "frame_bpp": [0.5] * r.randint(0, 4), "i_frame_num": q} for q in range(r.randint(0, 3))}
                                         for j in range(r.randint(0, 3))} for k in range(n)}


def flat(doc):
    return sorted((d, s, q, p["bpp"], p["img_path"]) for d, x in doc.items() for s, y in x.items() for q, p in y.items())


def got(df):
    return sorted((r["dataset"], r["sequence"], r["rate_key"], r["bpp"], r["img_path"]) for r in df.collect())


@pytest.mark.parametrize("indent,split", [(None, 7), (None, 64), (None, 1 << 20), (2, 50), (None, 1)])
def test_logs_cut_anywhere(spark, tmp_path, indent, split):
    doc = log(4 if split < 8 else 25, split)
    (tmp_path / "log.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=split == 64))
    assert got(rl.read_split_log(spark, "m", str(tmp_path / "log.json"), split_bytes=split)) == flat(doc)


def test_ranges_know_how_they_begin(spark, tmp_path):
    text = json.dumps(log(6, 3))
    (tmp_path / "x").write_text(text)
    depth, inside, escaped, states = 0, False, False, []
    for c in text:
        states.append((int(inside), depth))
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(c, 0)
    found = sj._ranges(spark, sj._documents(str(tmp_path / "x"), False), 5).collect()
    assert {r["start"]: (r["inside"], r["depth"]) for r in found} == {k: states[k] for k in range(0, len(text), 5)}


def test_parts_of_one_document_and_documents_of_a_folder(spark, tmp_path):
    doc = log(8, 11)
    text = json.dumps(doc).encode()
    (tmp_path / "parts").mkdir()
    for k in range(0, len(text), 97):
        (tmp_path / "parts" / f"part-{k:09d}").write_bytes(text[k:k + 97])
    assert got(rl.read_split_log(spark, "m", str(tmp_path / "parts"), joined=True, split_bytes=40)) == flat(doc)
    (tmp_path / "docs").mkdir()
    docs = [log(3, k) for k in range(4)]
    for k, d in enumerate(docs):
        (tmp_path / "docs" / f"{k}.json").write_text(json.dumps(d))
    assert got(rl.read_split_log(spark, "m", str(tmp_path / "docs"), split_bytes=30)) == sorted(x for d in docs for x in flat(d))


def test_broken_documents_are_errors(spark, tmp_path):
    good = json.dumps({"d": {"s": {"000": {"bpp": 1.0}}}})
    for k, bad in enumerate((good[:-1], good[:-4], good + "}", '{"d": {"s": {"000": {"bpp": "x}}}}', '{"d": 5}', '{"d": {"s": {"000": {"bpp": oops}}}}', '{d: {"s": {"000": {}}}}', "plain words")):
        (tmp_path / f"{k}.json").write_text(bad)
        with pytest.raises(Exception):
            rl.read_split_log(spark, "m", str(tmp_path / f"{k}.json"), split_bytes=6).collect()
    (tmp_path / "empty.json").write_text("{}")
    assert rl.read_split_log(spark, "m", str(tmp_path / "empty.json")).count() == 0


@pytest.mark.parametrize("split", [9, 1 << 20])
def test_manifests_cut_anywhere(spark, tmp_path, split):
    names = [f"{HARD[k % len(HARD)]}/im{k}.png" for k in range(60)]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "description.json").write_text(json.dumps(names))
    rows = manifests.read_image_manifest(spark, str(tmp_path / "i"), split_bytes=split).collect()
    assert sorted((r["image_id"], r["name"]) for r in rows) == list(enumerate(names))
    (tmp_path / "v").mkdir()
    seqs = [{"path": f"p{k}", "width": 8 + k, "height": 4, "seq_length": k % 5 + 1} for k in range(30)]
    (tmp_path / "v" / "description.json").write_text(json.dumps({"about": {"frames": ["no"]}, "version": 1, "seqs": seqs, "frames": names[:5]}))
    s, n = manifests.read_video_manifest(spark, str(tmp_path / "v"), split_bytes=split)
    assert sorted((r["seq_id"], r["path"], r["width"]) for r in s.collect()) == [(k, f"p{k}", 8 + k) for k in range(30)]
    assert sorted((r["frame_no"], r["frame_name"]) for r in n.collect()) == list(enumerate(names[:5]))
    assert cu.manifest_frames(s, n).count() == sum(x["seq_length"] for x in seqs)


def test_one_large_line_is_read_by_many_tasks(spark, tmp_path):
    doc = {"d": {f"s{k}": {"000": {"bpp": float(k)}} for k in range(3000)}}
    (tmp_path / "log.json").write_text(json.dumps(doc))
    elements = sj.json_elements(spark, str(tmp_path / "log.json"), 3, split_bytes=4096)
    from pyspark.sql import functions as F
    assert elements.where("level = 3").select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert rl.read_result_log(spark, "m", str(tmp_path / "log.json"), lines=False).agg(F.sum("bpp")).first()[0] == sum(range(3000))
