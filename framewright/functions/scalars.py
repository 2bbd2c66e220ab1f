"""Scalar expressions: fixed-width text, predicates with the reference's bounds, minimum image, lag grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residue names taken as water and as protein.
WATERS = ("HOH", "WAT", "H2O", "TIP3", "TIP4", "TIP5", "TP3", "TIP", "SOL", "SPC", "OPC")
PROTEIN = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "ACE", "NME", "NMA", "ASH", "CYM", "CYX", "GLH", "HID", "HIE", "HIP", "LYN", "HSD", "HSE", "HSP", "MSE")
LICENCE = r"(?i)CC BY|CC0|Creative Commons"
DIGEST = "^[0-9a-f]{64}$"


def strip(c: Column) -> Column:
    """Without white space at either end, carriage returns and tabs included (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def field(line: Column, first: int, last: int) -> Column:
    """Characters first..last of a fixed-width line, 1-based, as they stand."""
    return F.substring(line, first, last - first + 1)


def is_heavy(element: Column) -> Column:
    return element != "H"


def band(x: Column, low, high) -> Column:
    """Inclusive at both ends; a null is outside."""
    return F.coalesce(x.between(low, high), F.lit(False))


def within(x: Column, target, tolerance) -> Column:
    """|x - target| <= tolerance; a null is not within."""
    return F.coalesce(F.abs(x - target) <= tolerance, F.lit(False))


def relative_within(x: Column, target: Column, tolerance: float) -> Column:
    return F.coalesce(F.try_divide(F.abs(x - target), F.abs(target)) <= tolerance, F.lit(False))


def folded_contains(text: Column, wanted: Column) -> Column:
    """Case-folded substring test; a null text is empty."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(wanted))


def is_licensed(licence: Column) -> Column:
    return F.coalesce(licence.rlike(LICENCE), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(DIGEST), F.lit(False))


def is_water_oxygen(resname: Column, atom_name: Column) -> Column:
    return resname.isin(*WATERS) & (atom_name == "O")


def is_protein(resname: Column) -> Column:
    return resname.isin(*PROTEIN)


def minimum_image(step: Column, box: Column) -> Column:
    """A step less the nearest whole number of boxes; halves go to the even number."""
    return step - box * F.rint(step / box)


def lag_grid(n_frames: Column, most: int = 40) -> Column:
    """Distinct whole lags, evenly spread (truncated) over 1..max(2, (n_frames - 1) // 5)."""
    top = F.greatest(F.lit(2), F.floor((n_frames - 1) / 5).cast("int"))
    points = F.least(F.lit(most), top)
    step = (top - 1).cast("double") / (points - 1)
    lag = lambda i: F.when(i == points - 1, top).otherwise((F.lit(1.0) + i * step).cast("int"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), points - 1), lag))


def stride(total: int, wanted: int) -> str:
    """Selector first:last:step (1-based) that keeps about `wanted` of `total` frames; the step is a whole number."""
    return f"1:{total}:{max(1, total // wanted)}"


def selected(frame: Column, selector: str) -> Column:
    """Whether a 1-based frame number is in first:last:step."""
    first, last, step = map(int, selector.split(":"))
    return frame.between(first, last) & ((frame - first) % step == 0)


def all_of(*conditions: Column) -> Column:
    """Conjunction in which a null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])
