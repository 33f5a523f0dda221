"""Column expressions of the catalog model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procatlas.functions import fixed_values as fv


def risk_level(cyclomatic: Column, unknown: str = "unknown") -> Column:
    """low / moderate / high / critical; null and zero give ``unknown``."""
    out = F.when(cyclomatic.isNull() | (cyclomatic == 0), unknown)
    for label, limit in fv.RISK_LIMITS:
        out = out.when(cyclomatic <= limit, label)
    return out.otherwise(fv.RISK_ABOVE)


def is_reliable(confidence: Column, is_dynamic: Column) -> Column:
    return (confidence >= 0.8) & ~is_dynamic


def known_confidence(confidence: Column) -> Column:
    """Missing or zero confidence counts as one half."""
    return F.coalesce(F.nullif(confidence, F.lit(0)), F.lit(0.5))


def is_write(operation: Column) -> Column:
    return operation.isin(fv.WRITE_OPERATIONS)


def access_edge_type(operation: Column) -> Column:
    return F.when(operation == "SELECT", "reads_from").when(is_write(operation), "writes_to").otherwise("references")


def is_severe(severity: Column) -> Column:
    return severity.isin("critical", "high")


def severity_rank(severity: Column) -> Column:
    """1 for the worst severity; unknown severities sort last."""
    place = F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), severity)
    return F.when(place > 0, place).otherwise(len(fv.SEVERITIES) + 1)


def definition_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(name: Column) -> Column:
    out = F.translate(name, "._", "--")
    out = F.regexp_replace(out, "([a-z])([A-Z])", "$1-$2")
    out = F.regexp_replace(out, "[^a-zA-Z0-9-]", "")
    out = F.regexp_replace(out, "-+", "-")
    return F.lower(F.regexp_replace(out, "^-|-$", ""))


def name_parts(raw: Column, dialect: Column) -> Column:
    """struct(schema_name, object_name, fqn) of a possibly quoted, dotted or bare name."""
    parts = F.split(F.translate(raw, '[]"', ""), r"\.", -1)
    default = F.element_at(F.create_map(*[F.lit(v) for kv in fv.DEFAULT_SCHEMAS.items() for v in kv]), dialect)
    dotted = F.size(parts) >= 2
    schema = F.when(dotted, F.get(parts, F.size(parts) - 2)).otherwise(default)
    name = F.element_at(parts, -1)
    fqn = F.when(dotted, F.array_join(parts, ".")).otherwise(F.concat_ws(".", default, name))
    return F.struct(schema.alias("schema_name"), name.alias("object_name"), fqn.alias("fqn"))


def normalised(text: Column) -> Column:
    """The text with white space collapsed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def fingerprint(text: Column, length: int = 80) -> Column:
    """First characters of the normalised text."""
    return F.substring(normalised(text), 1, length)


def is_running(status: Column) -> Column:
    return status.isin(fv.RUNNING_STATES)


def is_finished(status: Column) -> Column:
    return status.isin(fv.FINISHED_STATES)


def percent_done(processed: Column, total: Column) -> Column:
    done = F.round(processed / total * 100)
    return F.when(total.isNull() | (total == 0), 0).otherwise(done).cast("int")


def label_of(code: Column, labels: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv]), code)


def display_type(data_type: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """Type name with length (-1 is MAX) or precision and scale."""
    length = F.when(max_length == -1, "MAX").otherwise(max_length.cast("string"))
    return (
        F.when(data_type.isin(fv.LENGTH_TYPES), F.concat(data_type, F.lit("("), length, F.lit(")")))
        .when(data_type.isin(fv.DECIMAL_TYPES),
              F.concat(data_type, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .otherwise(data_type))


def age_text(seconds: Column) -> Column:
    """'3d ago' style age from seconds."""
    out = None
    for label, size in (("y", 31536000), ("mo", 2592000), ("d", 86400), ("h", 3600), ("m", 60)):
        text = F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{label} ago"))
        out = F.when(seconds >= size, text) if out is None else out.when(seconds >= size, text)
    return out.otherwise("just now")


def contains_ci(column: Column, term: str) -> Column:
    """Case-insensitive contains, the term taken literally."""
    return F.contains(F.lower(column), F.lit(term.lower()))
