"""Query plans.  Importing this package fills `spec.REGISTRY`."""
from . import grids, series, experiments, records, physics, io, features  # noqa: F401
