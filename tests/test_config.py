import pytest

from sightline.operators.sampling import crop_refs
from sightline.sources.config import dataset_problems, read_options

pytest.importorskip("yaml")


def test_options(tmp_path):
    p = tmp_path / "o.yaml"
    p.write_text("ocr_every: 3\nregion: IN\ntracking:\n  max_age: 4\n")
    o = read_options(str(p))
    assert (o.ocr_every, o.region, o.tracking.max_age, o.tracking.min_hits) == (3, "IN", 4, 3)
    for bad in ("speed: 1", "tracking: {x: 1}", "ocr_every: 0", "tracking: {min_hits: 0}", "- 1"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            read_options(str(p))
    p.write_text("")
    assert read_options(str(p)).ocr_every == 1


def test_dataset_problems(tmp_path):
    p = tmp_path / "data.yaml"
    assert dataset_problems(str(p)) == [f"{p} is missing"]
    (tmp_path / "images/train").mkdir(parents=True)
    p.write_text(f"path: {tmp_path}\ntrain: images/train\nval: images/val\n")
    assert dataset_problems(str(p)) == ["key names is missing", "folder images/val is missing"]


def test_crop_refs(spark):
    box = lambda w: (0.5, 0.5, w, 0.1, None, "XX")
    rows = [("a", 1000, [box(0.02), box(0.05), box(0.1), box(0.3)]), ("b", 1000, [box(0.02)]), ("b", 1000, [box(0.02)]), ("c", 1000, None), (None, 1000, [box(0.1)])]
    df = spark.createDataFrame(rows, "image_id string, width int, boxes array<struct<cx: double, cy: double, w: double, h: double, text: string, region: string>>")
    got = {r.crop_id: r for r in crop_refs(df, 10).collect()}
    assert set(got) == {"a#0", "a#1", "a#2", "a#3", "b#0"}
    assert sorted(r.file_name for r in got.values()) == [f"{i:04d}.png" for i in range(5)]
    assert {r.bucket for r in crop_refs(df, 4).collect()} == {r.bucket for r in got.values()}
    assert (got["a#1"].width_px, got["a#1"].bucket) == (50, "small (32-64px)")
    assert crop_refs(df.limit(0), 5).count() == 0
