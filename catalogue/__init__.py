"""Every operator as a query over the test tables, with its SQL twin."""

from catalogue.registry import CATALOGUE
from catalogue import cleaning, flows, models, relational, statistics  # noqa: F401, E402

__all__ = ["CATALOGUE"]
