"""Views with the shape of a wiring diagram over star-schema tables, for tests and the query catalogue."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiring.functions.scratch import parts_for


class Fixture:
    """Lazily planned views; until a query runs only the number of synapses is read, from the footers of their file."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Partitions of the synapses, so that a task's share of them does not grow."""
        return parts_for(self.spark, self.table("lineitem").count())

    @property
    def neurons(self) -> DataFrame:
        c = F.col
        return self.table("customer").select(
            c("c_custkey").alias("root_id"), F.when(c("c_nationkey") % 5 == 0, "I").otherwise("E").alias("clf_type"), c("c_mktsegment").alias("cell_type"),
            c("c_acctbal").alias("dendrite_length"), (c("c_acctbal") + 500.0).alias("axon_length"), c("c_nationkey").cast("double").alias("x"), (c("c_acctbal") / 10.0).alias("y"))

    @property
    def synapses(self) -> DataFrame:
        rows = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").repartition(self.parts, "l_orderkey")
        return rows.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("id_"), F.col("o_custkey").alias("pre_id"), F.col("l_partkey").alias("post_id"), F.col("l_quantity").alias("size"),
            (F.col("l_extendedprice") / 100.0).alias("dist"))

    @property
    def tags(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.table("orders").where("o_orderkey % 10 <> 9").select(
            F.col("o_orderkey").alias("target_id"), F.col("o_custkey").alias("pre_pt_root_id"), F.when(s == "F", "spine").when(s == "O", "shaft").otherwise("soma").alias("tag"))

    @property
    def tags_in(self) -> DataFrame:
        """Tags of incoming synapses: another relation, with other keys and tags than ``tags``."""
        p = F.substring("o_orderpriority", 1, 1)
        tag = F.when(p.isin("1", "2"), "spine").when(p == "3", "shaft").when(p == "4", "soma").otherwise("other")
        return self.table("orders").where("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("target_id"), (F.col("o_custkey") * 3 % 1501).alias("post_pt_root_id"), tag.alias("tag"))

    @property
    def tagged(self) -> DataFrame:
        types = self.neurons.select("root_id", "clf_type")
        pre = types.select(F.col("root_id").alias("pre_id"), F.col("clf_type").alias("pre_clf_type"))
        post = types.select(F.col("root_id").alias("post_id"), F.col("clf_type").alias("post_clf_type"))
        tags = self.tags.select(F.col("target_id").alias("id_"), "tag")
        return self.synapses.join(tags, "id_").join(pre, "pre_id", "left").join(post, "post_id", "left")

    @property
    def edges(self) -> DataFrame:
        types = self.neurons.where("dendrite_length > 0").select("root_id", "clf_type")
        pre = types.select(F.col("root_id").alias("pre_id"), F.col("clf_type").alias("pre_type"))
        post = types.select(F.col("root_id").alias("post_id"), F.col("clf_type").alias("post_type"))
        ends = self.synapses.select("pre_id", "post_id").repartition(self.parts, "pre_id", "post_id")
        pairs = ends.groupBy("pre_id", "post_id").agg(F.count(F.lit(1)).alias("n_syn"))  # shrink before the joins
        return pairs.join(pre, "pre_id").join(post, "post_id").select("pre_id", "post_id", "pre_type", "post_type", "n_syn")


#: The same views for an independent engine.
SQL = """
fx_neurons AS (SELECT c_custkey AS root_id, CASE WHEN c_nationkey % 5 = 0 THEN 'I' ELSE 'E' END AS clf_type, c_mktsegment AS cell_type,
  c_acctbal AS dendrite_length, c_acctbal + 500.0 AS axon_length, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 10.0 AS y FROM customer),
fx_synapses AS (SELECT l_orderkey AS id_, o_custkey AS pre_id, l_partkey AS post_id, l_quantity AS size, l_extendedprice / 100.0 AS dist
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fx_tags AS (SELECT o_orderkey AS target_id, o_custkey AS pre_pt_root_id,
  CASE o_orderstatus WHEN 'F' THEN 'spine' WHEN 'O' THEN 'shaft' ELSE 'soma' END AS tag FROM orders WHERE o_orderkey % 10 <> 9),
fx_tags_in AS (SELECT o_orderkey AS target_id, o_custkey * 3 % 1501 AS post_pt_root_id, CASE substr(o_orderpriority, 1, 1)
  WHEN '1' THEN 'spine' WHEN '2' THEN 'spine' WHEN '3' THEN 'shaft' WHEN '4' THEN 'soma' ELSE 'other' END AS tag FROM orders WHERE o_orderkey % 7 <> 3),
fx_tagged AS (SELECT s.*, t.tag, a.clf_type AS pre_clf_type, b.clf_type AS post_clf_type FROM fx_synapses s JOIN fx_tags t ON s.id_ = t.target_id
  LEFT JOIN fx_neurons a ON s.pre_id = a.root_id LEFT JOIN fx_neurons b ON s.post_id = b.root_id),
fx_edges AS (SELECT s.pre_id, s.post_id, a.clf_type AS pre_type, b.clf_type AS post_type, count(*) AS n_syn FROM fx_synapses s
  JOIN fx_neurons a ON s.pre_id = a.root_id JOIN fx_neurons b ON s.post_id = b.root_id
  WHERE a.dendrite_length > 0 AND b.dendrite_length > 0 GROUP BY ALL)"""
