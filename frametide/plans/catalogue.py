"""All queries and their SQL: importing a module of queries registers them."""

from frametide.plans import association, features, images, media, registry, requests, samplers, service, spectral
from frametide.plans.registry import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "association", "features", "flagship", "images", "media", "registry", "requests", "samplers", "service", "spectral"]
