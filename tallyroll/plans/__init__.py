"""All registered queries; importing the modules fills the registry."""

from tallyroll.plans import changes, ingest, joining, listing, streams  # noqa: F401
from tallyroll.plans.registry import ORACLES, QUERIES, oracle_texts, run  # noqa: F401
