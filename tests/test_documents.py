"""JSON documents read, checked and written back."""

from __future__ import annotations

import base64
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canopia.sources import documents as D

def now():
    return F.lit("2024-05-02 00:00:00").cast("timestamp")


def put(path, *docs):
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    return str(path)


def test_inventories(spark, tmp_path):
    doc = {
        "config_entry_id": "e1", "extra": 1,
        "plants": [{"id": 1, "name": "a", "openfarm_slug": "beet", "x": 1, "y": 2.5, "radius": 30, "planted_at": "2024-01-01T00:00:00Z"}, {"id": 2, "name": "b", "x": 1, "y": 2, "radius": -1}],
        "weeds": [{"id": 5, "x": 1.0, "y": 2.0, "radius": None}, {"id": 6, "x": 1.0, "y": 2.0, "z": -3, "radius": 4}],
        "images": [
            {"id": 7, "created_at": "2024-05-01T12:00:00Z", "processed": False, "meta": {"x": 10, "y": 20, "z": -1, "name": "n"}}, {"id": 8, "created_at": "2024-05-01T13:00:00Z", "x": 11, "y": 21},
            {"id": 9, "created_at": "2024-04-01T00:00:00Z", "meta": {"x": 1, "y": 1}}, {"id": 10, "created_at": "2024-05-01T13:00:00Z"},
        ],
        "curves": [{"id": 3, "name": "c", "data": {"1": 10, "20": 300}}],
    }
    docs = D.documents(spark, put(tmp_path / "inventory.json", doc, "{not json", {"config_entry_id": "e2"}), D.INVENTORY)
    found = D.inventory(docs, 24, now())
    assert [(r.config_entry_id, r.id, r.y, r.z, r.planted_at) for r in found["plants"].collect()] == [("e1", 1, 2.5, 0.0, datetime(2024, 1, 1))]
    assert sorted((r.id, r.z, r.radius) for r in found["weeds"].collect()) == [(5, 0.0, 0.0), (6, -3.0, 4.0)]
    assert sorted((r.id, r.processed, r.x, r.z, r.name) for r in found["images"].collect()) == [(7, False, 10.0, -1.0, "n"), (8, True, 11.0, 0.0, None)]
    assert found["curves"].first().data == {"1": 10.0, "20": 300.0}
    for bad in (0, 721):
        with pytest.raises(ValueError):
            D.inventory(docs, bad, now())


def test_soil_and_devices(spark, tmp_path):
    soil = {"config_entry_id": "e", "points": [{"id": 1, "name": "s", "x": 1, "y": 2, "z": -3, "updated_at": "2024-01-01T00:00:00Z"}, {"name": "no id"}], "motion": {"axis_bounds": {"x": [0, 1000], "y": [0, 500], "z": [1]}}}
    points, axes = D.soil_points(D.documents(spark, put(tmp_path / "soil.json", soil), D.SOIL))
    assert [(r.id, r.z) for r in points.collect()] == [(1, -3.0)]
    assert sorted(map(tuple, axes.collect())) == [("e", "x", 0.0, 1000.0), ("e", "y", 0.0, 500.0)]
    bots = {"bots": [{"config_entry_id": "a", "capabilities": ["stereo", "grid"]}, {"config_entry_id": "b"}, {"name": "lost"}]}
    docs = D.documents(spark, put(tmp_path / "bots.json", bots), D.BOTS)
    assert sorted(r.config_entry_id for r in D.devices(docs).collect()) == ["a", "b"]
    assert [r.config_entry_id for r in D.devices(docs, "grid").collect()] == ["a"]


def jpeg(spark, tmp_path, w=40, h=30):
    jvm = spark._jvm
    path = tmp_path / f"{w}x{h}.jpg"
    image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    return path.read_bytes()


def test_images_are_checked(spark, tmp_path):
    data = jpeg(spark, tmp_path)
    assert D.jpeg_size(data) == (40, 30) and D.jpeg_size(data[:20]) is None and D.jpeg_size(b"") is None and D.jpeg_size(b"\xff\xd8\xff\xc4\x00\x01") is None
    assert D.jpeg_size(b"\xff\xd8\xff\xff\xd0\xff\xc0\x00\x11\x08\x00\x07\x00\x09rest") == (9, 7)

    def doc(k, content=data, **more):
        return {"image_id": k, "sha256": hashlib.sha256(content).hexdigest().upper(), "width": 40, "height": 30, "image_base64": base64.b64encode(content).decode()} | more

    docs = [doc(1), doc(2, sha256="0" * 64), doc(3, width=41), doc(4, b"PNG no jpeg"), doc(5, image_base64="%%%"), doc(6, image_base64=None), doc(7, b"\xff\xd8" + b"x" * 5000)]
    found = {r.image_id: r for r in D.images(D.documents(spark, put(tmp_path / "images.json", *docs), D.IMAGES), most_bytes=4000).collect()}
    assert {k: r.error for k, r in found.items()} == {1: None, 2: "digest", 3: "dimensions", 4: "no JPEG", 5: "no base64", 6: "no base64", 7: "size"}
    assert bytes(found[1].content) == data and (found[1].width, found[1].height) == (40, 30) and found[2].content is None


def test_training_bundles_go_round(spark, tmp_path):
    schema = "detection_id string, label string, features map<string, double>, created_at timestamp, image_id long"
    samples = spark.createDataFrame([("a", "weed", {"green": 0.5}, datetime(2024, 1, 1), 3), ("b", "crop", {"green": 0.1, "edge": 2.0}, datetime(2024, 1, 2), None)], schema)
    path = str(tmp_path / "bundle")
    D.export_training(samples, path)
    assert sorted(map(str, D.import_training(spark, path).select(samples.columns).collect())) == sorted(map(str, samples.collect()))
    put(tmp_path / "more.json", {"detection_id": "a", "label": "soil", "features": {"green": 0.9}}, {"detection_id": "c", "label": "ufo", "features": {}}, {"detection_id": "", "label": "weed", "features": {}}, {"detection_id": "d", "label": "weed"}, "broken")
    over = {r.detection_id: r.label for r in D.import_training(spark, str(tmp_path / "more.json"), samples).collect()}
    assert over == {"a": "soil", "b": "crop"}
    assert {r.detection_id for r in D.import_training(spark, str(tmp_path / "more.json"), samples, replace=True).collect()} == {"a"}
    with pytest.raises(ValueError):
        D.import_training(spark, put(tmp_path / "none.json", {"detection_id": "x", "label": "ufo", "features": {}}))


def test_settings_are_versions(spark, tmp_path):
    folder = tmp_path / "settings"
    store = D.Settings(spark, str(folder), {"margin": 20.0, "enabled": True}, lambda s: isinstance(s["margin"], float) and s["margin"] >= 0)
    assert store.load("e") == {"margin": 20.0, "enabled": True}
    store.save("e", {"margin": 5.0})
    store.save("f", {"enabled": False})
    assert store.load("e") == {"margin": 5.0, "enabled": True} and store.load("f")["enabled"] is False and store.load("g")["margin"] == 20.0
    for bad in ({"margin": -1.0}, {"colour": 1}):
        with pytest.raises(ValueError):
            store.save("e", bad)
    assert store.load("e")["margin"] == 5.0
    # a version that was not finished does not count; one that cannot be read means the defaults
    (folder / "v=9").mkdir()
    (folder / "v=9" / "part.json").write_text('{"entry": "e", "settings": "{\\"margin\\": 9.0}"}')
    assert store.load("e")["margin"] == 5.0
    (folder / "v=9" / "_SUCCESS").write_text("")
    assert store.load("e")["margin"] == 9.0
    (folder / "v=9" / "part.json").write_text('{"entry": "e", "settings": "{broken"}')
    assert store.load("e") == store.defaults
