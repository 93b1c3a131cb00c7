from rowdeck.plans.catalog import QUERIES, flagship
from rowdeck.plans.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]
