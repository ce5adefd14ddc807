"""Imports every module that registers queries."""

from prefixloom.plans import blocks, cluster, reuse, store, streams  # noqa: F401

FLAGSHIP = "reuse_report"
