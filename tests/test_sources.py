"""Sources, sinks and streams on files made here."""

import json
import zipfile
import zlib

from plangrove.sources import archive, documents
from plangrove.streaming import ledger as streams


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/APT_FP_STR_000000001.json", "{}")
        z.writestr("d/APT_FP_SPA_000000002.png", "png")
        z.writestr("d/bad.name.json", "x")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("APT_FP_STR_000000003.png", "png")
    (tmp_path / "c.zip").write_bytes(b"not an archive")
    archive.register(spark)
    listed = spark.read.format("zip_entries").load(f"{tmp_path}/*.zip")
    assert listed.count() == 4
    binary = archive.entries_of(spark.read.format("binaryFile").load(f"{tmp_path}/*.zip"))
    assert sorted(r.crc for r in binary.collect()) == sorted(r.crc for r in listed.collect())
    good, bad = archive.inventory(listed)
    assert good.count() == 3 and [r.entry for r in bad.collect()] == ["d/bad.name.json"]
    linked = {r.file_size: r for r in archive.link_by_fingerprint(good).collect()}
    assert linked[3].crc == zlib.crc32(b"png") and linked[3]["keys"] == {"SPA": "000000002", "STR": "000000003"} and linked[3].copies == 2


def test_annotations(spark, tmp_path):
    doc = {
        "categories": [{"id": 1, "name": "room"}],
        "images": [{"file_name": "a.png", "width": 10, "height": 5}],
        "annotations": [
            {"id": 1, "category_id": 1, "segmentation": [0, 0, 1, 0, 1, 1], "bbox": [0, 0, 1, 1], "area": 0.5, "attributes": {"k": "v"}},
            {"id": 2, "category_id": 9, "segmentation": [[0, 0, 2, 0, 2, 2], [5, 5, 6, 5, 6, 6]], "bbox": [0, 0, 2, 2], "area": 2, "attributes": {}},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    docs = documents.annotation_documents(spark, str(tmp_path)).cache()
    assert docs.where("_corrupt_record is not null").count() == 1
    rows = documents.annotations(docs.where("annotations is not null")).orderBy("ann_id").collect()
    assert [(r.class_name, len(r.segmentation)) for r in rows] == [("room", 1), ("9", 2)]


def test_ledgers(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("train", "r1", 0.5), ("eval", "r2", None)], "kind string, run_id string, adj_L1 double")
    documents.append_ledger(rows, path)
    documents.append_ledger(rows, path)
    (tmp_path / "ledger" / "x.json").write_text('\n{"kind": "eval", "run_id": 5}\nnot json\n')
    got = documents.ledger(spark, path)
    assert got.where("kind is not null").count() == 5 and got.where("logged is not null").count() == 4
    assert documents.broken_lines(spark, path).count() == 1
    edits = spark.createDataFrame([("ann", "merge"), ("eve", "merge"), (None, "split")], "actor string, kind string")
    fine, odd = documents.checked_edits(edits, ["ann"], ["merge", "split"])
    assert fine.count() == 1 and odd.count() == 2
    documents.append_decisions(edits, str(tmp_path / "csv"))
    assert documents.decisions(spark, str(tmp_path / "csv")).count() == 3


def test_svg(spark, tmp_path):
    (tmp_path / "a.svg").write_text('<svg><polygon class="Room" points="0,0 4,0 4,3"/><polygon class="Door" points="1,1 2,1 2,2 1,2"/></svg>')
    (tmp_path / "b.svg").write_text("<svg></svg>")
    (tmp_path / "c.svg").write_text("nothing")
    rows = documents.svg_regions(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r["class"] or "", r.status) for r in rows) == [("", "empty_svg"), ("", "svg_parse_error"), ("Door", "success"), ("Room", "success")]
    assert [len(r.ring) for r in rows if r["class"] == "Room"] == [3]


def test_releases(spark, tmp_path):
    path = str(tmp_path / "release")
    rows = spark.createDataFrame([("a", "v0", "train"), ("b", "v0", "test"), ("c", "v1", "train")], "id string, version string, split string")
    documents.write_release(rows, path)
    documents.write_release(rows.where("id = 'c'"), path)
    assert [r.id for r in documents.read_split(spark, path, "v0", "train").collect()] == ["a"]
    old = spark.createDataFrame([("a", None, None, None, None, "0.1"), ("b", "benchmark", 1, "success", "", "0.2")], "id string, role string, tier int, status string, reason string, schema_version string")
    assert [(r.id, r.changed, r.schema_version) for r in documents.migrate(old).orderBy("id").collect()] == [("a", True, "0.2"), ("b", False, "0.2")]


def test_streams(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1)
    events.write.parquet(str(source))
    events.limit(50).write.mode("append").parquet(str(source))
    stream = streams.unseen(streams.valid(streams.read_events(spark, str(source), 1), ["view", "click"]), "60 days")
    streams.run_available(stream, str(tmp_path / "c1"), str(tmp_path / "out")).awaitTermination(120)
    want = events.where("event_type in ('view', 'click')").select("event_id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
    kept = streams.keep_latest(streams.read_events(spark, str(source), 1), str(tmp_path / "c2"), str(tmp_path / "latest"), ["user_id", "event_type"], ["ts", "event_id"])
    kept.awaitTermination(120)
    last = max((tmp_path / "latest").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert spark.read.parquet(str(last)).count() == events.select("user_id", "event_type").distinct().count()
