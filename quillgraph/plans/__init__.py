"""The library's queries over the driver's tables."""

from . import catalogue, live, queries  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
