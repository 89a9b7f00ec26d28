"""Named queries over the given tables.  Importing this package fills the registry."""

from siftlake.plans import activity, packages, projects, scans, storage, streams, tooling, trees  # noqa: F401
from siftlake.plans.registry import PLANS

__all__ = ["PLANS"]
