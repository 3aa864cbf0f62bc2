from datetime import datetime, timedelta

import pytest

from tidelane.sources.cache import RequestCache

NOW = datetime(2024, 3, 1, 12, 7)


def test_a_bucket_is_made_once(spark, tmp_path):
    """The second call reads no source: that is gone by then. Another request or bucket is made anew."""
    source = tmp_path / "source"
    spark.range(50).write.parquet(str(source))
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(str(source)).where("id < 40")

    cache = RequestCache(spark, f"file://{tmp_path}/cache", timedelta(minutes=15))
    assert cache.get({"ticker": "A", "grain": "1d"}, NOW, make).count() == 40
    source.rename(tmp_path / "moved")
    for at in (NOW, NOW + timedelta(minutes=7), NOW.replace(minute=0)):
        assert cache.get({"grain": "1d", "ticker": "A"}, at, make).count() == 40
    assert len(made) == 1
    for request, at in (({"ticker": "B", "grain": "1d"}, NOW), ({"ticker": "A", "grain": "1d"}, NOW + timedelta(minutes=8))):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            cache.get(request, at, make)
    (tmp_path / "moved").rename(source)
    assert cache.get({"ticker": "A", "grain": "1d"}, NOW + timedelta(minutes=8), make).count() == 40


def test_unfinished_attempts_are_not_read_and_old_buckets_go(spark, tmp_path):
    cache = RequestCache(spark, f"file://{tmp_path}", timedelta(hours=1))
    # An attempt whose job never committed.
    folder = cache._folder({"a": 1}, NOW).removeprefix("file://")
    spark.range(3).write.parquet(f"{folder}/0-lost")
    (tmp_path / folder / "0-lost" / "_SUCCESS").unlink()
    assert cache.get({"a": 1}, NOW, lambda: spark.range(7)).count() == 7
    # Of two that committed at the same time all read the same one.
    spark.range(9).write.parquet(f"{folder}/~later")
    assert cache.get({"a": 1}, NOW, lambda: 1 / 0).count() == 7
    cache.get({"a": 1}, NOW + timedelta(hours=5), lambda: spark.range(8))
    assert cache.evict(NOW + timedelta(hours=6), timedelta(hours=2)) == 1
    assert cache.evict(NOW + timedelta(hours=6), timedelta(hours=2)) == 0
    assert cache.get({"a": 1}, NOW + timedelta(hours=5), lambda: 1 / 0).count() == 8
    with pytest.raises(ValueError):
        RequestCache(spark, f"file://{tmp_path}", timedelta(0))
