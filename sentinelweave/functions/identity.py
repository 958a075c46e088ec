"""Entity rules, deterministic identifiers and canonical hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from sentinelweave.functions.text import casefold, strip_text

# Fixed values: (entity, pattern over the case-folded text, canonical name, confidence), first hit wins.
ENTITY_RULES = [
    ("disease", r"hantavirus", "Hantavirus disease", 0.82),
    ("pathogen", r"orthohantavirus andesense", "Orthohantavirus andesense", 0.92),
    ("pathogen", r"(?U)\b(cepa|virus|variante)?\s*andes\b", "Andes virus", 0.9),
    ("pathogen", r"hantavirus", "Hantavirus", 0.78),
]
# Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_entity(verbatim: Column, entity: str, rules: Sequence[tuple] = ENTITY_RULES) -> Column:
    """Resolve an entity mention with an ordered rule table."""
    text = strip_text(verbatim)
    folded = casefold(text)
    null_text = F.lit(None).cast("string")

    def outcome(name: Column, status: str, confidence: float, shown: Column = text) -> Column:
        return F.struct(
            shown.alias("verbatim"), name.alias("canonical_name"), F.lit(status).alias("normalization_status"),
            F.lit(float(confidence)).alias("confidence"),
        )

    missing = verbatim.isNull() | (verbatim == "")
    chain = F.when(missing, outcome(null_text, "unresolved", 0.3, null_text))
    for kind, pattern, name, confidence in rules:
        if kind == entity:
            chain = chain.when(folded.rlike(pattern), outcome(F.lit(name), "resolved", confidence))
    return chain.otherwise(outcome(null_text, "unresolved", 0.4))


def explicit_pathogen(verbatim: Column, rules: Sequence[tuple] = ENTITY_RULES) -> Column:
    """Canonical taxon named outright in the text, else null (generic names do not count)."""
    folded = casefold(strip_text(F.coalesce(verbatim, F.lit(""))))
    named = [r for r in rules if r[0] == "pathogen"][:2]
    chain = F.when(folded.rlike(named[0][1]), F.lit(named[0][2]))
    for _, pattern, name, _ in named[1:]:
        chain = chain.when(folded.rlike(pattern), F.lit(name))
    return chain


def resolve_explicit_pathogen(pathogen: Column, rules: Sequence[tuple] = ENTITY_RULES) -> Column:
    """Override the canonical name when the verbatim text names the taxon."""
    canonical = explicit_pathogen(pathogen["verbatim"], rules)
    return F.when(
        canonical.isNotNull(),
        pathogen.withField("canonical_name", canonical).withField("normalization_status", F.lit("resolved")),
    ).otherwise(pathogen)


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def canonical_pair(a: Column, b: Column) -> Column:
    """Stable orientation of a symmetric pair; a self pair fails the job."""
    checked = F.when(a == b, F.raise_error(F.lit("a signal cannot be paired with itself"))).otherwise(a)
    return F.struct(F.least(checked, b).alias("source"), F.greatest(checked, b).alias("target"))


def uuid5(name: Column, namespace_hex: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5) computed with native SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def event_code(ids: Column, kind: str, namespace: str = "events") -> Column:
    """Deterministic event code of a pair or a cohort from its sorted distinct signal ids."""
    ordered = F.array_sort(F.array_distinct(F.transform(ids, strip_text)))
    scope = f"{namespace}:event:v0.4.9:" + ("cohort:" if kind == "cohort" else "")
    return F.concat(F.lit("EVT-"), uuid5(F.concat(F.lit(scope), F.array_join(ordered, ":"))))


def canonical(c: Column, dtype: T.DataType) -> Column:
    """Rebuild a value with struct fields in name order, at every depth."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[canonical(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, dtype.elementType))
    return c


def canonical_json(c: Column, dtype: T.DataType) -> Column:
    """Compact JSON with sorted keys and explicit nulls."""
    return F.to_json(canonical(c, dtype), {"ignoreNullFields": "false"})


def row_sha256(c: Column, dtype: T.DataType) -> Column:
    return F.sha2(canonical_json(c, dtype), 256)
