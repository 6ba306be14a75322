"""Kinetic modelling of high-dimensional time series on Spark DataFrames.

A trajectory set is one DataFrame with a row per frame; a model is a small
dense object on the driver plus DataFrame transformations that apply it.
"""

__version__ = "0.1.0"
