"""Versions of a package are there whole or not at all."""

import os

import pytest

from tracelake.sources import published


def frame(spark, n):
    return spark.range(n).selectExpr("id", "concat('v', id) as name")


def test_a_lost_job_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "package")
    assert published.versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        published.opened(spark, root, "nodes")
    first = published.publish({"nodes": frame(spark, 1000), "edges": frame(spark, 0)}, root)
    assert published.opened(spark, root, "nodes").count() == 1000 and published.opened(spark, root, "edges").columns == ["id", "name"]
    rows = published.manifest(spark, root).collect()
    assert sum(r.rows for r in rows if r.table == "nodes") == 1000
    assert all(r.bytes == os.path.getsize(f"{root}/{first}/{r.table}/{r.part}") for r in rows)
    # parts without a manifest, and a manifest that was not committed
    frame(spark, 5).write.parquet(f"{root}/000000000002-lost/nodes")
    frame(spark, 5).write.parquet(f"{root}/000000000003-half/manifest")
    os.remove(f"{root}/000000000003-half/manifest/_SUCCESS")
    assert published.versions(spark, root) == [first] and published.opened(spark, root, "nodes").count() == 1000
    second = published.publish({"nodes": frame(spark, 7)}, root)
    assert published.versions(spark, root) == [first, second] and published.opened(spark, root, "nodes").count() == 7
    assert published.opened(spark, root, "nodes", first).count() == 1000


def test_damaged_parts_are_named(spark, tmp_path):
    root = str(tmp_path / "package")
    name = published.publish({"nodes": frame(spark, 1000).repartition(3)}, root)
    assert published.damaged(spark, root).isEmpty()
    files = sorted(f for f in os.listdir(f"{root}/{name}/nodes") if f.startswith("part-"))
    with open(f"{root}/{name}/nodes/{files[0]}", "ab") as part:
        part.write(b"x")
    os.remove(f"{root}/{name}/nodes/.{files[0]}.crc")  # the local file system has checksums of its own
    os.remove(f"{root}/{name}/nodes/{files[1]}")
    frame(spark, 3).coalesce(1).write.mode("append").parquet(f"{root}/{name}/nodes")
    assert sorted(r.fault for r in published.damaged(spark, root).collect()) == ["changed", "missing", "unknown"]
