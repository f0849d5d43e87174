"""Identifier formats as anchored patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted identifier formats.
FORMATS = {
    "annotation": r"^(DOP|DOF|DOT):\d{6}$",
    "domain_type": (
        r"^(CDD:cd\d+|INTERPRO:IPR\d{6}|NCBIFAM:TIGR\d{5}|PFAM:PF\d{5}|PRINTS:PR\d{5}|PROFILE:PS\d{5}"
        r"|SMART:SM\d{5}|SUPERFAMILY:SSF\d+|PANTHER:PTHR\d+|GENE3D:G3DSA:[\d.]+|HAMAP:MF_\d+|PIRSF:PIRSF\d+)$"
    ),
    "interpro": r"^IPR\d{6}$",
    "go": r"^GO:\d{7}$",
    "reactome": r"^R-[A-Z]{3}-\d+$",
    "kegg": r"^[a-z]{2,5}:\d+$",
    "chebi": r"^CHEBI:\d+$",
    "chebi_double": r"^CHEBI:CHEBI:\d+$",
    "accession": r"^[A-Z][0-9][A-Z0-9]{3}[0-9]([A-Z][0-9][A-Z0-9]{3}[0-9])?$",
    "pro": r"^PR:\d{9}$",
    "elm": r"^[A-Z]{3}_\S+$",
}


def format_ok(c: Column | str, kind: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(FORMATS[kind])
