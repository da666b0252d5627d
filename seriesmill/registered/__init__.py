"""Registered queries with their oracles."""

from seriesmill.registered import evaluation, features, learning, storage, streams, temporal  # noqa: F401
from seriesmill.registered.base import ORACLE, QUERIES  # noqa: F401
