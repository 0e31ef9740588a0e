"""Landing of new files only."""

from helpers import rows

from signalmart import schemas
from signalmart.operators import landing as L
from signalmart.sources.bronze import read_bronze
from signalmart.streaming.landing import land_new_files


def test_each_file_lands_once(spark, root):
    brands = L.brand_dim(spark)

    def arrive(name, url):
        data = [("Limca", "Limca drink India", 0, "ok", [("Title " + url, None, url, "2026-03-22", None, ("S",))])]
        spark.createDataFrame(data, schemas.NEWS_PAYLOAD).write.mode("append").json(f"{root}/raw")

    def run():
        query = land_new_files(
            spark, f"{root}/raw", schemas.NEWS_PAYLOAD, lambda raw: L.shape_news(raw, brands, "2026-03-22T00:00:00Z"),
            f"{root}/bronze", "news", f"{root}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None
        return rows(read_bronze(spark, f"{root}/bronze", "news").select("brand_name", "url"))

    arrive("one", "u1")
    assert run() == [("Limca", "u1")]
    assert run() == [("Limca", "u1")]
    arrive("two", "u2")
    assert run() == [("Limca", "u1"), ("Limca", "u2")]
