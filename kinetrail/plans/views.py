"""The tables of a data directory as trajectory sets and vector sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.plans.trajectories import Trajectories
from kinetrail.session import table

#: Features of a line item, as expressions that SQL engines share.
LINE_FEATURES = ("l_quantity", "l_extendedprice / 1000", "l_discount * 100", "l_tax * 100")


def events(s, d) -> Trajectories:
    """Event types of a user in the order of time."""
    return Trajectories(table(s, d, "events"), "user_id", ("ts", "event_id"), "event_type")


def event_values(s, d) -> Trajectories:
    """The value of an event and its logarithm, by user."""
    df = table(s, d, "events").withColumn("features", F.array(F.col("value"), F.log1p(F.greatest("value", F.lit(0.0)))))
    return Trajectories(df, "user_id", ("ts", "event_id"), "event_type", "features")


def orders(s, d) -> Trajectories:
    """Priorities of the orders of a customer."""
    return Trajectories(table(s, d, "orders"), "o_custkey", ("o_orderdate", "o_orderkey"), "o_orderpriority")


def lines(s, d) -> Trajectories:
    """Four features of the line items of a supplier."""
    df = table(s, d, "lineitem").withColumn("features", F.array(*(F.expr(e).cast("double") for e in LINE_FEATURES)))
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return Trajectories(df, "l_suppkey", order, None, "features")


def vectors(s, d):
    """The embeddings with 64-bit features."""
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
