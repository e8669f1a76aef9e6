"""Search, browse and upkeep of catalogues of embedded items, as Spark DataFrame jobs."""
