import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import registry
from sightline.functions.images import lanczos_weights, thumbnail_hash
from sightline.operators import splits
from sightline.plans import dataset


def png(px):
    h, w = px.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in px.astype(np.uint8)))) + chunk(b"IEND", b"")


def picture(seed):
    r = np.random.default_rng(seed)
    return np.kron(r.integers(0, 255, (8, 9)), np.ones((6, 6)))


def test_thumbnail_hash():
    ramp = np.tile(np.linspace(255, 0, 90), (40, 1))
    assert thumbnail_hash(ramp)[0] == -1  # left is brighter everywhere
    assert thumbnail_hash(ramp[:, ::-1])[0] == 0
    assert thumbnail_hash(np.full((5, 5), 7.0)) == (0, 0)
    a, b = thumbnail_hash(picture(1))[0], thumbnail_hash(picture(1) * 0.9 + 5)[0]
    assert ((a ^ b) & (2**64 - 1)).bit_count() <= 5
    assert np.allclose(lanczos_weights(50, 8).sum(axis=1), 1)


def raw(root):
    n = 0
    for src, d, stems in (("eu", "train", [f"video1_{i}" for i in range(4)] + [f"still{i}" for i in range(20)]), ("eu", "test", ["video1_9", "copy"]), ("in", "valid", [f"pic{i}" for i in range(20)])):
        for s in stems:
            n += 1
            (root / src / d / "images").mkdir(parents=True, exist_ok=True)
            (root / src / d / "labels").mkdir(exist_ok=True)
            px = picture(4) if s in ("copy", "still0") else picture(100 + n)
            (root / src / d / "images" / f"{s}.png").write_bytes(png(px))
            (root / src / d / "labels" / f"{s}.txt").write_text("0 .5 .5 .5 .2\n" if s != "pic3" else "")


SOURCES = [("eu", "tag-eu", "EU", "eu-", "CC BY 4.0", "u"), ("in", "tag-in", "IN", "in-", "CC BY-NC 4.0", "v")]


def test_build_dataset(spark, tmp_path):
    raw(tmp_path / "raw")
    table = spark.createDataFrame(SOURCES, "directory string, source_tag string, region string, id_prefix string, licence string, url string")
    sources = dataset.registry(table)
    built = dataset.build_dataset(spark, str(tmp_path / "raw"), str(tmp_path / "out"), sources)
    rows = {r.image_id: r for r in built.records.collect()}
    assert len(rows) == 46
    assert len({rows[i].split for i in rows if "video1" in i}) == 1
    assert rows["eu-test-copy"].group_key == rows["eu-train-still0"].group_key == "dup:eu-test-copy"
    assert rows["eu-test-copy"].split == rows["eu-train-still0"].split
    assert built.stats.first().plates == 45
    facts = dataset.inspect_tree(spark, built.tree)
    assert sum(facts["labels"].values()) == 46
    assert facts["annotations"] == 45
    again = dataset.build_dataset(spark, str(tmp_path / "raw"), str(tmp_path / "again"), sources)
    assert dataset.inspect_tree(spark, again.tree)["export_sha256"] == facts["export_sha256"]
    assert splits.split_counts(built.records).count() == 3
    plain = dataset.build_dataset(spark, str(tmp_path / "raw"), str(tmp_path / "plain"), sources, check_duplicates=False)
    assert {r.group_key for r in plain.records.where("image_id = 'eu-test-copy'").collect()} == {"eu-test-copy"}
    with pytest.raises(FileNotFoundError):
        dataset.ingest_sources(spark, str(tmp_path / "nowhere"), sources)
    with pytest.raises(FileNotFoundError):
        dataset.inspect_tree(spark, str(tmp_path / "raw"))
    assert [r.source_tag for r in dataset.attribution(table).where("redistributable").collect()] == ["tag-eu"]


def test_provenance(tmp_path):
    got = dataset.write_provenance(str(tmp_path / "p.json"), dataset={"images": 1})
    assert got["metrics"] is None and got["dataset"] == {"images": 1}
    with pytest.raises(ValueError):
        dataset.write_provenance(str(tmp_path / "p.json"), guess=1)


def test_registered_functions(spark):
    assert "box_iou" in registry.register(spark)
    r = spark.sql("SELECT clip_id('video3_2190') AS a, hamming(1, 6) AS b, size_bucket(40) AS c, box_iou(named_struct('x1', 0D, 'y1', 0D, 'x2', 1D, 'y2', 1D), named_struct('x1', 0.5D, 'y1', 0D, 'x2', 1.5D, 'y2', 1D)) AS d, error_rate('AB', 'AC') AS e, normalize_plate('ind mh-12 a1') AS f").first()
    assert (r.a, r.b, r.c, r.e, r.f) == ("video3", 3, "small (32-64px)", 0.5, "MH12A1")
    assert r.d == pytest.approx(1 / 3)
    df = spark.createDataFrame([("still",), (None,)], "n string")
    assert [x[0] for x in df.select(F.call_function("clip_id", F.col("n"))).collect()] == [None, None]
