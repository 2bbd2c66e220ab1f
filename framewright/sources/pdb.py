"""PDB atoms as rows, in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalars import field, strip


def parse_atoms(files: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """ATOM and HETATM lines of whole-file texts: file, ordinal (among such lines, from 0), chain, resid, atom_name, x, y, z, element, resname.

    The ordinal comes from the position in the filtered array, so no shuffle or sort is
    needed. Bad numbers raise. An absent element column falls back to the first character of the atom name.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike("^(ATOM|HETATM)"))
    at = files.select(F.col(file).alias("file"), F.posexplode(lines).alias("ordinal", "line"))
    line = F.col("line")
    name, element = strip(field(line, 13, 16)), strip(field(line, 77, 78))
    number = lambda a, b: strip(field(line, a, b)).cast("double")
    return at.select(
        "file",
        "ordinal",
        field(line, 22, 22).alias("chain"),
        strip(field(line, 23, 27)).alias("resid"),
        name.alias("atom_name"),
        number(31, 38).alias("x"),
        number(39, 46).alias("y"),
        number(47, 54).alias("z"),
        F.upper(F.when(element != "", element).otherwise(F.substring(name, 1, 1))).alias("element"),
        strip(field(line, 18, 20)).alias("resname"),
    )


def read_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Atoms of the PDB files at path (file, directory or glob); all models and alternates are kept."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_atoms(texts)


def pdb_line(ordinal: int, atom_name: str, resname: str, chain: str, resid: str, xyz, element: str = "", record: str = "ATOM") -> str:
    """One fixed-width line (resid may end in an insertion code)."""
    digits = resid.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    code = resid[len(digits) :] or " "
    return f"{record:<6}{(ordinal + 1) % 100000:>5} {atom_name:<4} {resname:>3} {chain}{digits:>4}{code}   {xyz[0]:8.3f}{xyz[1]:8.3f}{xyz[2]:8.3f}  1.00  0.00          {element:>2}"
