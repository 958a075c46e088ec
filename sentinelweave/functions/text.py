"""String expressions: normal forms, tokens, clauses, whole-term search, anchors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as a Unicode-aware matcher sees it (Java's \s alone is ASCII).
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"

# Function words ignored when comparing quotations.
QUOTE_STOPWORDS = [
    "a", "al", "ante", "bajo", "con", "contra", "de", "del", "desde", "durante",
    "e", "el", "ella", "ellas", "ellos", "en", "entre", "era", "es", "esa", "ese",
    "esta", "este", "fue", "ha", "hasta", "la", "las", "lo", "los", "o", "para",
    "pero", "por", "que", "se", "sin", "su", "sus", "un", "una", "uno", "unos",
    "unas", "y", "ya", "the", "of", "and", "in", "to", "for", "with", "was", "were",
]
# Words that negate a quotation.
NEGATION_WORDS = [
    "no", "sin", "ningun", "ninguna", "ninguno", "negativo", "negativa", "negativos", "negativas",
]
# Evidence labels read as plain text, per scorer version.
TEXT_LABELS_V045 = ["text", "quote"]
TEXT_LABELS_V046 = ["text", "quote", "excerpt", "document_text"]
# Metric names and units with one canonical spelling.
METRIC_NAMES = {"cases_new": "new_cases", "cases_confirmed_total": "confirmed_cases"}
COUNT_UNITS = ["case", "cases", "person", "persons", "people"]
# Token pattern of the quotation comparison.
TOKEN_PATTERN = "[0-9a-záéíóúüñ]+"
# Clause boundaries of compound quotations.
CLAUSE_BOUNDARY = (
    r"(?i)(?:\s*;\s*|\s*:\s*|(?<=[.!?])\s+|,\s*(?=\d)|\s+(?:y|e)\s+(?=(?:\d|no\b|sin\b)))"
)
CLAUSE_TRIM = " \t\r\n,;:."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim; case is kept."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE, " "))


def casefold(c: Column | str) -> Column:
    """Lower case with the sharp s expanded."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def norm_text(c: Column | str) -> Column:
    """Collapsed, trimmed, case-folded text; blank becomes null."""
    value = casefold(squash(_col(c).cast("string")))
    return F.when(value != "", value)


def norm_once(c: Column | str) -> Column:
    """:func:`norm_text` for use inside lambdas, where Spark computes a repeated expression each time."""
    return F.get(F.filter(F.array(casefold(squash(_col(c).cast("string")))), lambda t: t != ""), F.lit(0))


def strip_text(c: Column | str) -> Column:
    """Trim all Unicode whitespace from both ends, keeping inner runs."""
    return F.regexp_replace(_col(c), rf"^{WHITESPACE}|{WHITESPACE}$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip_text(c), F.lit(""))


# The accented Latin letters folded in comparison copies.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(c: Column | str) -> Column:
    """Case-folded copy without accents, for comparison only.

    Precomposed Latin letters are translated; separate combining marks are removed.
    """
    return F.regexp_replace(F.translate(casefold(c), ACCENTED, UNACCENTED), r"\p{Mn}", "")


def tokens(c: Column | str, drop_stopwords: bool = False) -> Column:
    """Distinct alphanumeric tokens of the normal form, in order of first use."""
    found = token_list(F.coalesce(norm_text(c), F.lit("")))
    return content_tokens(found) if drop_stopwords else found


def token_list(normal: Column) -> Column:
    """Distinct tokens of a text in normal form."""
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(TOKEN_PATTERN), F.lit(0)))


def content_tokens(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: (F.length(t) > 1) & ~t.isin(QUOTE_STOPWORDS))


def has_negation(token_array: Column) -> Column:
    return F.arrays_overlap(token_array, F.array(*[F.lit(w) for w in NEGATION_WORDS]))


def numbers(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: t.rlike("^[0-9]+$"))


def whole_term(value: Column, text: Column) -> Column:
    """True when ``value`` occurs in ``text`` between Unicode word edges.

    Both sides are collapsed and case-folded.  The value is quoted literally, and a
    stray end-of-quote mark inside it is neutralised by splitting the quotation.
    """
    term = F.replace(casefold(squash(value)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)"))
    return F.regexp_like(casefold(squash(text)), pattern)


def clauses(c: Column | str) -> Column:
    """Split a quotation at strong clause boundaries; pieces are stripped of punctuation."""
    pieces = F.split(F.trim(_col(c)), CLAUSE_BOUNDARY)
    trimmed = F.transform(pieces, lambda p: F.btrim(p, F.lit(CLAUSE_TRIM)))
    return F.coalesce(F.filter(trimmed, lambda p: p != ""), F.array().cast("array<string>"))


def canonical_evidence_type(c: Column | str, version: str = "0.4.7") -> Column:
    return canonical_label(norm_text(c), version)


def canonical_label(value: Column, version: str = "0.4.7") -> Column:
    """Canonical evidence type of a label in normal form."""
    labels = TEXT_LABELS_V045 if version == "0.4.5" else TEXT_LABELS_V046
    return F.when(value.isin(labels), F.lit("text")).otherwise(value)


def canonical_metric_name(c: Column | str) -> Column:
    return metric_name_of(norm_text(c))


def metric_name_of(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in METRIC_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def canonical_metric_unit(c: Column | str) -> Column:
    return metric_unit_of(norm_text(c))


def metric_unit_of(value: Column) -> Column:
    return F.when(value.isin(COUNT_UNITS), F.lit("count")).otherwise(value)


def content_hash(c: Column | str) -> Column:
    """SHA-256 of whitespace-collapsed text."""
    return F.sha2(squash(c), 256)


def signal_text(summary: Column, evidence: Column, sep: str = " ") -> Column:
    """Summary followed by every excerpt; absent parts are skipped."""
    texts = F.filter(F.transform(evidence, lambda e: e["text"]), lambda t: t.isNotNull())
    return F.concat_ws(sep, summary, F.coalesce(texts, F.array().cast("array<string>")))


# Named-vessel mentions.  Only ASCII capitals start a name.
_NAME = r"[A-Z?][\w.-]*(?:\s+[A-Z?][\w.-]*){0,3}"
VESSEL_PATTERN = rf"(?U)\b(?i:buque|crucero|embarcaci[o?]n)\s+((?:(?:MV|M/V|M\.V\.)\s+)?{_NAME})"
PREFIXED_VESSEL_PATTERN = rf"(?U)\b((?:MV|M/V|M\.V\.)\s+{_NAME})"


def anchors(c: Column | str) -> Column:
    """Sorted distinct ``vessel:<name>`` anchors mentioned in a text."""
    text = F.coalesce(_col(c), F.lit(""))
    names = F.concat(
        F.regexp_extract_all(text, F.lit(VESSEL_PATTERN), F.lit(1)),
        F.regexp_extract_all(text, F.lit(PREFIXED_VESSEL_PATTERN), F.lit(1)),
    )

    def tidy(name: Column) -> Column:
        name = F.regexp_replace(squash(name), r"[.,;:!?)\]}]+$", "")
        name = F.replace(F.replace(name, F.lit("M/V "), F.lit("MV ")), F.lit("M.V. "), F.lit("MV "))
        return F.concat(F.lit("vessel:"), casefold(name))

    return F.array_sort(F.array_distinct(F.transform(names, tidy)))


def paragraphs(c: Column | str) -> Column:
    """Blank-line separated paragraphs of a text with 0-based character spans.

    Returns ``array<struct<id,start,end,text>>``.  The separators are extracted next to
    the pieces, so offsets are a running sum inside one row and nothing is shuffled.
    """
    text = _col(c)
    separator = r"\r?\n[ \t]*\r?\n"
    pieces = F.split(text, separator)
    gaps = F.transform(F.regexp_extract_all(text, F.lit(separator), F.lit(0)), F.length)
    sized = F.transform(
        pieces, lambda p, i: F.struct(p.alias("raw"), F.coalesce(F.get(gaps, i), F.lit(0)).alias("gap"))
    )
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, piece: Column) -> Column:
        raw = piece["raw"]
        body = strip_text(raw)
        left = F.length(raw) - F.length(F.regexp_replace(raw, rf"^{WHITESPACE}", ""))
        begin = acc["pos"] + left
        item = F.struct(
            begin.cast("int").alias("start"), (begin + F.length(body)).cast("int").alias("end"), body.alias("text")
        )
        found = F.when(F.length(body) > 0, F.concat(acc["found"], F.array(item))).otherwise(acc["found"])
        return F.struct(
            (acc["pos"] + F.length(raw) + piece["gap"]).cast("int").alias("pos"), found.alias("found")
        )

    folded = F.aggregate(sized, F.struct(F.lit(0).alias("pos"), empty.alias("found")), step)["found"]
    return F.transform(
        folded,
        lambda p, i: F.struct(
            F.concat(F.lit("P"), F.lpad((i + 1).cast("string"), F.greatest(F.lit(3), F.length((i + 1).cast("string"))), F.lit("0"))).alias("id"),
            p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"),
        ),
    )
