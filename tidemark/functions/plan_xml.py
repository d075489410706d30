"""Facts read out of plan documents.

``xpath_*`` fails the whole job on a malformed document, so every document goes
through ``from_xml`` first, which reports it in a column instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a plan document states its optimisation level, and the decoded levels.
_CORRUPT = "_corrupt"
LEVEL_SCHEMA = (
    "BatchSequence array<struct<Batch array<struct<Statements array<struct<"
    "StmtSimple array<struct<_StatementOptmLevel string>>>>>>>>, "
    f"{_CORRUPT} string"
)
LEVELS = {"T": "Trivial", "F": "Full"}

# Only needed to learn whether a document parses; no content is kept.
WELL_FORMED_SCHEMA = f"{_CORRUPT} string"


def _parse(xml: Column, schema: str) -> Column:
    return F.from_xml(
        xml, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )


def optimization_level(xml: Column) -> Column:
    """Level of the first statement that states one, decoded; NULL if none or malformed."""
    def flat(items: Column, field: str) -> Column:
        inner = F.transform(items, lambda x: F.coalesce(x[field], F.array()))
        return F.flatten(F.filter(inner, lambda a: a.isNotNull()))

    statements = _parse(xml, LEVEL_SCHEMA)["BatchSequence"]
    for field in ("Batch", "Statements", "StmtSimple"):
        statements = flat(statements, field)
    stated = F.filter(
        F.transform(statements, lambda s: s["_StatementOptmLevel"]), lambda v: v.isNotNull()
    )
    first = F.substring(F.get(stated, F.lit(0)), 1, 1)
    decoded = None
    for code, name in LEVELS.items():
        decoded = F.when(first == code, name) if decoded is None else decoded.when(first == code, name)
    return decoded


def is_well_formed(xml: Column) -> Column:
    """True for a document that parses, False otherwise and for NULL."""
    parsed = _parse(xml, WELL_FORMED_SCHEMA)
    return xml.isNotNull() & parsed[_CORRUPT].isNull() & parsed.isNotNull()


def touches_schema(xml: Column, schema: str) -> Column:
    """True when a plan document has a column reference into ``[schema]``.

    The quoted name appears verbatim unless the document writes it with
    references (``&...;``), so documents with neither skip the two parses.
    """
    quoted = f"[{schema}]"
    if '"' in quoted:
        raise ValueError("schema names with double quotes are not supported")
    candidate = F.contains(xml, F.lit(quoted)) | F.contains(xml, F.lit("&"))
    path = f'//ColumnReference[@Schema="{quoted}"]'
    return F.when(
        candidate, F.when(is_well_formed(xml), F.xpath_boolean(xml, F.lit(path))).otherwise(F.lit(False))
    ).otherwise(F.lit(False))
