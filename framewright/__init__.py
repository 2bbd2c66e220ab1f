"""Trajectory scoring on Spark: sources, operators, plans. Importing this package imports no Spark."""

import os

# Numerical libraries read these when they load; unset, they start a thread for each core of the machine,
# which makes small decompositions a hundred times slower. Spark's own setting for its workers stands.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, os.environ.get("OMP_NUM_THREADS", str(min(8, os.cpu_count() or 1))))

__version__ = "0.1.0"


def tools() -> dict:
    """The four verbs by name (loaded on use)."""
    from framewright.plans import verbs

    return verbs.TOOLS
