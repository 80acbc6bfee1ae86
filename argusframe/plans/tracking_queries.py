"""Trackers over the detections view; their results are checked in the tests."""

from argusframe.operators import tracking as T
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X


@query("track_centroid")
def track_centroid(spark, sf):
    return T.track_centroid(X.detections(spark, sf), fps=4.0)


@query("track_entities")
def track_entities(spark, sf):
    return T.track_entities(X.detections(spark, sf))


@query("track_open_vocab")
def track_open_vocab(spark, sf):
    return T.track_open_vocab(X.detections(spark, sf))
