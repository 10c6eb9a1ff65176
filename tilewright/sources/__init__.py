"""Sources and sinks."""

from pyspark.sql import SparkSession

from tilewright.shipping import ship


def register(spark: SparkSession) -> None:
    """Make the formats osmpbf, mbtiles, pmtiles and tilestream known."""
    from tilewright.sources.mbtiles import MBTilesSource
    from tilewright.sources.osmpbf import OsmPbfSource
    from tilewright.sources.pmtiles import PMTilesSource
    from tilewright.sources.tilestream import TileStreamSource

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (OsmPbfSource, MBTilesSource, PMTilesSource, TileStreamSource):
        spark.dataSource.register(source)
