import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def feature(id, collection="c", at="2020-01-01T00:00:00Z", box=(0, 0, 1, 1), **properties):
    x0, y0, x1, y1 = box
    shape = {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}
    times = {"datetime": None, "start_datetime": at[0], "end_datetime": at[1]} if isinstance(at, tuple) else {"datetime": at}
    return {"id": id, "type": "Feature", "collection": collection, "geometry": shape, "bbox": list(box), "stac_version": "1.0.0", "properties": times | properties}


def group(id, **more):
    return {"id": id, "type": "Collection", "description": f"about {id}", "license": "CC0-1.0", "extent": {"spatial": {"bbox": [[-180, -90, 180, 90]]}, "temporal": {"interval": [["2019-01-01T00:00:00Z", None]]}}} | more
