"""A stream over many small files lists and reads them with few tasks, and leaves its caller's settings alone."""

from __future__ import annotations

from bytelode.operators.specs import builtin_specs, select_types
from bytelode.plans.carve import CarveConfig
from bytelode.streaming import landing

LISTING, OPENING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"


def test_small_files_share_tasks(spark, tmp_path, monkeypatch) -> None:
    (tmp_path / "in").mkdir()
    for k in range(300):
        (tmp_path / "in" / f"{k}.html").write_bytes(b"<html>%d</html>" % k)
    before, seen, plain = [spark.conf.get(k) for k in (LISTING, OPENING)], [], landing.carve

    def carve(images, config):
        seen.append((images.rdd.getNumPartitions(), int(images.sparkSession.conf.get(LISTING))))
        return plain(images, config)

    monkeypatch.setattr(landing, "carve", carve)
    config = CarveConfig(select_types(builtin_specs(), ["htm"]), "buffer")
    landing.watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", config, 1000).awaitTermination()
    assert len(seen) == 1 and seen[0][0] <= 4 and seen[0][1] == 4 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300
    assert [spark.conf.get(k) for k in (LISTING, OPENING)] == before
