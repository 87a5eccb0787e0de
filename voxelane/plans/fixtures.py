"""The driver's tables seen as movies, traces, cameras and recordings; the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import sent


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.path = lambda name: f"{sf_dir}/{name}.parquet"
        self.read = lambda name: spark.read.parquet(self.path(name))

    @property
    def movie(self) -> DataFrame:
        """(t, x, y, v): an 8 x 8 movie, pix = x + 8 y."""
        e = self.read("embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("p", "e"))
        return e.select("t", (F.col("p") % 8).cast("long").alias("x"), F.floor(F.col("p") / 8).alias("y"), F.col("e").cast("double").alias("v"))

    @property
    def trace(self) -> DataFrame:
        """(pix, t, v): a trace a user."""
        t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
        return self.read("events").select(F.col("user_id").alias("pix"), t.cast("long").alias("t"), F.col("value").alias("v"))

    @property
    def prob(self) -> DataFrame:
        """(pix, t, v, prob, truth)."""
        t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
        return self.read("events").select(F.col("user_id").alias("pix"), t.cast("long").alias("t"), F.col("value").alias("v"), F.least(F.lit(1.0), F.col("value") / 200).alias("prob"), (F.col("event_type") == "error").alias("truth"))

    @property
    def wide(self) -> DataFrame:
        """(t, x, y, v): a 16 x 16 movie, four vectors a frame."""
        k = F.col("t") % 4
        return self.movie.select(F.floor(F.col("t") / 4).alias("t"), (F.col("x") + 8 * (k % 2)).alias("x"), (F.col("y") + 8 * F.floor(k / 2)).alias("y"), "v")

    @property
    def volume(self) -> DataFrame:
        """(t, z, x, y, v): four planes of 8 x 8 pixels, a vector a plane."""
        return self.movie.select(F.floor(F.col("t") / 4).alias("t"), (F.col("t") % 4).alias("z"), "x", "y", "v")

    @property
    def pixels(self) -> DataFrame:
        return self.movie.where("t = 0").select("x", "y")

    @property
    def camera(self) -> DataFrame:
        p = F.col("x") + 8 * F.col("y")
        return self.pixels.select("x", "y", (-0.3 + 0.001 * p).alias("off"), (0.4 + 0.09 * p).alias("gain"))

    @property
    def mask(self) -> DataFrame:
        return self.pixels.select("x", "y", ((F.col("x") + F.col("y")) % 3 != 0).alias("keep"))

    @property
    def components(self) -> DataFrame:
        """(cell, x, y, w): ten overlapping footprints."""
        labels = self.read("embeddings").select(F.col("vec_id").alias("t"), F.col("label").cast("long").alias("cell"))
        return self.movie.join(labels, "t").groupBy("cell", "x", "y").agg(F.avg("v").alias("w")).where("w > 0.01")

    @property
    def cell_traces(self) -> DataFrame:
        """(cell, t, c): a frame's weighted sum over each footprint."""
        return self.movie.join(sent(self.components), ["x", "y"]).groupBy("cell", "t").agg(F.sum(F.col("w") * F.col("v")).alias("c"))

    @property
    def levels(self) -> DataFrame:
        return self.read("lineitem").groupBy(F.col("l_suppkey").alias("pix"), (F.col("l_linenumber") - 1).alias("lvl")).agg(F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("var"))

    @property
    def affine(self) -> DataFrame:
        return self.movie.where("x = 0 AND y = 0 AND t % 4 = 0").select("t", (0.01 * (F.col("t") % 7)).alias("dy"), (-0.01 * (F.col("t") % 5)).alias("dx"))

    @property
    def ephys(self) -> DataFrame:
        """One recording in order of event_id, which counts from 0 without gaps; the second channel looks one sample back."""
        e = self.read("events").select(F.col("event_id").alias("i"), "value", "user_id")
        before = e.select((F.col("i") + 1).alias("i"), F.col("value").alias("back"))
        back = F.coalesce("back", "value")
        return e.join(before, "i", "left").select("i", ((F.col("value") - 50) / 1000).alias("ch1"), ((50 - back) / 1000).alias("ch2"), (F.col("user_id") % 5 + 1).alias("stim3"), (F.col("i") % 3 + 1).alias("stim4"))


#: DuckDB forms of the views; each query's SQL takes the ones it names.
SQL = {
    "movie": "SELECT t, p % 8 AS x, p // 8 AS y, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id AS t, unnest(embedding) AS e, unnest(range(0, 64)) AS p FROM embeddings)",
    "volume": "SELECT t // 4 AS t, t % 4 AS z, x, y, v FROM movie",
    "wide": "SELECT t // 4 AS t, x + 8 * (t % 4 % 2) AS x, y + 8 * (t % 4 // 2) AS y, v FROM movie",
    "trace": "SELECT user_id AS pix, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, value AS v FROM events",
    "prob": "SELECT user_id AS pix, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, value AS v, least(1.0::DOUBLE, value / 200) AS prob, event_type = 'error' AS truth FROM events",
    "camera": "SELECT x, y, -0.3::DOUBLE + 0.001::DOUBLE * (x + 8 * y) AS off, 0.4::DOUBLE + 0.09::DOUBLE * (x + 8 * y) AS gain FROM movie WHERE t = 0",
    "mask": "SELECT x, y, (x + y) % 3 <> 0 AS keep FROM movie WHERE t = 0",
    "components": "SELECT e.label AS cell, m.x, m.y, avg(m.v) AS w FROM movie m JOIN embeddings e ON e.vec_id = m.t GROUP BY ALL HAVING avg(m.v) > 0.01::DOUBLE",
    "cells": "SELECT cell, t, sum(w * v) AS c FROM movie JOIN components USING (x, y) GROUP BY ALL",
    "levels": "SELECT l_suppkey AS pix, l_linenumber - 1 AS lvl, avg(l_quantity) AS mean, var_pop(l_quantity) AS var FROM lineitem GROUP BY ALL",
    "affine": "SELECT t, 0.01::DOUBLE * (t % 7) AS dy, -0.01::DOUBLE * (t % 5) AS dx FROM movie WHERE x = 0 AND y = 0 AND t % 4 = 0",
    "ephys": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, (value - 50::DOUBLE) / 1000 AS ch1, (50::DOUBLE - lag(value, 1, value) OVER (ORDER BY event_id)) / 1000 AS ch2, user_id % 5 + 1 AS stim3, (row_number() OVER (ORDER BY event_id) - 1) % 3 + 1 AS stim4 FROM events",
}
NEEDS = {"volume": ["movie"], "wide": ["movie"], "camera": ["movie"], "mask": ["movie"], "components": ["movie"], "cells": ["movie", "components"], "affine": ["movie"]}
