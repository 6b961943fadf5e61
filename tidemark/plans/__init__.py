"""Named queries; importing this package registers them."""

from . import basics, evaluation, ladders, meetings, panels, selection
from .registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES", "basics", "evaluation", "ladders", "meetings", "panels", "selection"]
