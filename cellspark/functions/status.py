"""Status codes and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transport codes and their names.
CODES = {
    0: "Success", 1: "NullPtr", 2: "Mmap", 3: "InvalidLen", 4: "Alignment", 5: "Io", 6: "Oom", 8: "IntegrationConfig", 100: "Malignant", 101: "Normal",
    7010: "BadArg", 7020: "BadWork", 7030: "Shape", 7088: "LibraryUnset", 7099: "UnknownTransport",
}
HINTS = {
    "Success": "completed", "NullPtr": "a required input is missing", "Mmap": "the file could not be mapped", "InvalidLen": "dimensions or lengths do not fit", "Alignment": "the data is not aligned",
    "Io": "the file could not be read", "Oom": "not enough memory; retry with less at once", "IntegrationConfig": "the configuration is incomplete", "Malignant": "a clinical result, no error", "Normal": "a clinical result, no error",
    "BadArg": "the kernel refused an argument", "BadWork": "the kernel's work space does not fit", "Shape": "the kernel's shapes do not fit", "LibraryUnset": "no kernel library is set", "UnknownTransport": "the code is not known",
}


def name_of(code: Column) -> Column:
    """Name of a code; unknown ones are UnknownTransport."""
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.lit(CODES[7099]))


def hint_of(name: Column) -> Column:
    """Text for operators."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), name)


def diagnosis(cell_id: str, kappa: str, clinical: str) -> Column:
    """One line for a cell."""
    return F.format_string("cell_id=%d kappa=%.6f clinical=%s", F.col(cell_id), F.col(kappa), F.col(clinical))
