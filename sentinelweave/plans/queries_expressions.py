"""Registered queries for the scalar expressions (FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.functions import dates, identity, text
from sentinelweave.operators.exports import mask_projection
from sentinelweave.plans.nested import nested_signals, signal_rows
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import view

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
STOP = ", ".join(f"'{w}'" for w in text.QUOTE_STOPWORDS)
NEGATIONS = ", ".join(f"'{w}'" for w in text.NEGATION_WORDS)


def sql_squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def sql_norm(c: str) -> str:
    return f"nullif(replace(lower({sql_squash(c)}), 'ß', 'ss'), '')"


def sql_tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({sql_norm(c)}, ''), '[0-9a-záéíóúüñ]+'))"


@query("fn01_norm_text", f"select raw_item_id, md5({sql_norm('raw_text')}) as norm_md5, length({sql_norm('raw_text')}) as norm_length from {{doc}}")
def _(spark, sf):
    d = view(spark, sf, "doc").withColumn("t", text.norm_text("raw_text"))
    return d.select("raw_item_id", F.md5("t").alias("norm_md5"), F.length("t").cast("long").alias("norm_length"))


@query(
    "fn02_fold_accents",
    """select raw_item_id, md5(regexp_replace(translate(replace(lower(raw_text), 'ß', 'ss'),
    'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\p{Mn}', '', 'g')) as folded_md5 from {doc}""",
)
def _(spark, sf):
    return view(spark, sf, "doc").select("raw_item_id", F.md5(text.fold_accents("raw_text")).alias("folded_md5"))


@query(
    "fn03_tokens",
    f"""select raw_item_id, len(t) as n_tokens, len(c) as n_content, md5(array_to_string(list_sort(c), ' ')) as content_md5
    from (select raw_item_id, {sql_tokens('raw_text')} as t,
      list_filter({sql_tokens('raw_text')}, lambda x: x not in ({STOP}) and length(x) > 1) as c from {{doc}}) q""",
)
def _(spark, sf):
    d = view(spark, sf, "doc").select("raw_item_id", text.tokens("raw_text").alias("t"), text.tokens("raw_text", True).alias("c"))
    return d.select(
        "raw_item_id", F.size("t").cast("long").alias("n_tokens"), F.size("c").cast("long").alias("n_content"),
        F.md5(F.array_join(F.array_sort("c"), " ")).alias("content_md5"),
    )


@query(
    "fn04_negation_numbers",
    f"""select raw_item_id, len(list_filter(t, lambda x: x in ({NEGATIONS}))) > 0 as negated,
      array_to_string(list_sort(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+'))), ' ') as number_list
    from (select raw_item_id, {sql_tokens('raw_text')} as t from {{doc}}) q""",
)
def _(spark, sf):
    d = view(spark, sf, "doc").select("raw_item_id", text.tokens("raw_text").alias("t"))
    return d.select(
        "raw_item_id", text.has_negation(F.col("t")).alias("negated"),
        F.array_join(F.array_sort(text.numbers(F.col("t"))), " ").alias("number_list"),
    )


@query(
    "fn05_whole_term",
    r"""select signal_id, seq, regexp_matches(' ' || replace(lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))), ' ', '  ') || ' ',
      '[^\p{L}\p{N}_]' || lower(event_type) || '[^\p{L}\p{N}_]') as mentioned
    from (select e.signal_id, e.seq, e.text, s.event_type from {sig_evidence} e join {sig} s on s.signal_id = e.signal_id) q""",
)
def _(spark, sf):
    e = view(spark, sf, "sig_evidence").join(view(spark, sf, "sig").select("signal_id", "event_type"), "signal_id")
    return e.select("signal_id", "seq", text.whole_term(F.col("event_type"), F.col("text")).alias("mentioned"))


# DuckDB's regex engine has no lookaround; boundaries are marked first, then split.
_MARKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(signal_summary || ': 3 casos; no hay ' || event_type || ', 2 ' || event_type || ' y 4 más e otro. Fin'),
  '\s*;\s*', chr(1), 'g'), '\s*:\s*', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), ',\s*(\d)', chr(1) || '\1', 'g'),
  '\s+(?:y|e)\s+(\d|(?:no|sin)\b)', chr(1) || '\1', 'gi')"""


@query(
    "fn06_clauses",
    f"""select signal_id, array_to_string(list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(13) || chr(10) || ',;:.')),
      lambda p: p <> ''), '|') as pieces from {{sig}}""",
)
def _(spark, sf):
    s = view(spark, sf, "sig")
    long = F.concat(
        F.col("signal_summary"), F.lit(": 3 casos; no hay "), F.col("event_type"), F.lit(", 2 "), F.col("event_type"),
        F.lit(" y 4 más e otro. Fin"),
    )
    return s.select("signal_id", F.array_join(text.clauses(long), "|").alias("pieces"))


@query(
    "fn07_evidence_type",
    f"""select signal_id, seq, case when {sql_norm('type')} in ('text', 'quote') then 'text' else {sql_norm('type')} end as type_v045,
      case when {sql_norm('type')} in ('text', 'quote', 'excerpt', 'document_text') then 'text' else {sql_norm('type')} end as type_v047
    from {{sig_evidence}}""",
)
def _(spark, sf):
    return view(spark, sf, "sig_evidence").select(
        "signal_id", "seq", text.canonical_evidence_type("type", "0.4.5").alias("type_v045"),
        text.canonical_evidence_type("type", "0.4.7").alias("type_v047"),
    )


@query(
    "fn08_metric_names",
    """select name_c, unit_c, count(*) as n from (
      select case name when 'cases_new' then 'new_cases' when 'cases_confirmed_total' then 'confirmed_cases' else name end as name_c,
        case when unit in ('case', 'cases', 'person', 'persons', 'people') then 'count' else unit end as unit_c from {sig_metric}) q
      group by name_c, unit_c""",
)
def _(spark, sf):
    m = view(spark, sf, "sig_metric").select(
        text.canonical_metric_name("name").alias("name_c"), text.canonical_metric_unit("unit").alias("unit_c")
    )
    return m.groupBy("name_c", "unit_c").agg(F.count("*").alias("n"))


@query(
    "fn09_partial_date",
    r"""select signal_id, case when kind = 'full' then as_of_date end as date, case when kind in ('full', 'year', 'month') then cast(substr(as_of_date, 1, 4) as int) end as year,
      case when kind in ('full', 'month') then cast(substr(as_of_date, 6, 2) as int) end as month,
      case kind when 'full' then 'day' when 'none' then 'unknown' when 'bad' then 'unknown' else kind end as precision,
      case when kind in ('full', 'none') then null else as_of_date end as verbatim
    from (select signal_id, as_of_date, case when as_of_date is null then 'none'
        when regexp_full_match(as_of_date, '\d{4}-\d{2}-\d{2}') and try_cast(as_of_date as date) is not null then 'full'
        when regexp_full_match(as_of_date, '\d{4}') then 'year'
        when regexp_full_match(as_of_date, '\d{4}-\d{2}') and cast(substr(as_of_date, 6, 2) as int) between 1 and 12 then 'month' else 'bad' end as kind
      from {sig_metric}) q""",
)
def _(spark, sf):
    null, none = F.lit(None).cast("string"), F.lit(None).cast("int")
    p = dates.partial_date(F.col("as_of_date"), none, none, F.lit("unknown"), null)
    return view(spark, sf, "sig_metric").select("signal_id", p.alias("p")).select(
        "signal_id", "p.date", "p.year", "p.month", "p.precision", "p.verbatim"
    )


@query(
    "fn10_signal_interval",
    """select signal_id, coalesce(occurred_start, case when period_year is not null then make_date(period_year, 1, 1) end) as lo,
      case when occurred_start is not null then coalesce(occurred_end, occurred_start) when period_year is not null then make_date(period_year, 12, 31) end as hi
    from {sig}""",
)
def _(spark, sf):
    s = signal_rows(spark, sf).select("signal_id", dates.signal_interval(F.col("event_date"), F.col("reference_period")).alias("i"))
    return s.select("signal_id", "i.lo", "i.hi")


@query(
    "fn11_normalize_entity",
    r"""select p_partkey, v as verbatim, case when v is null then null when f like '%orthohantavirus andesense%' then 'Orthohantavirus andesense'
        when regexp_matches(f, '\b(cepa|virus|variante)?\s*andes\b') then 'Andes virus' when f like '%hantavirus%' then 'Hantavirus' end as canonical_name,
      case when v is null then 0.3 when f like '%orthohantavirus andesense%' then 0.92
        when regexp_matches(f, '\b(cepa|virus|variante)?\s*andes\b') then 0.9 when f like '%hantavirus%' then 0.78 else 0.4 end as confidence
    from (select p_partkey, trim(w) as v, lower(trim(w)) as f from (select p_partkey, case p_partkey % 6 when 0 then null when 1 then ' Cepa Andes ' || p_name
      when 2 then 'Orthohantavirus ANDESENSE ' || p_type when 3 then 'Hantavirus ' || p_name when 4 then 'landes ' || p_name else p_name end as w from {part}) a) q""",
)
def _(spark, sf):
    p = view(spark, sf, "part")
    m = F.col("p_partkey") % 6
    mention = (
        F.when(m == 1, F.concat(F.lit(" Cepa Andes "), "p_name"))
        .when(m == 2, F.concat(F.lit("Orthohantavirus ANDESENSE "), "p_type"))
        .when(m == 3, F.concat(F.lit("Hantavirus "), "p_name"))
        .when(m == 4, F.concat(F.lit("landes "), "p_name"))
        .when(m == 5, F.col("p_name"))
    )
    e = p.select("p_partkey", identity.normalize_entity(mention, "pathogen").alias("e"))
    return e.select("p_partkey", "e.verbatim", "e.canonical_name", "e.confidence")


@query(
    "fn12_explicit_pathogen",
    r"""select id, case when lower(canonical_name) like '%orthohantavirus andesense%' then 'Orthohantavirus andesense'
        when regexp_matches(lower(canonical_name), '\b(cepa|virus|variante)?\s*andes\b') then 'Andes virus' else 'old' end as canonical_name,
      case when lower(canonical_name) like '%orthohantavirus andesense%' or regexp_matches(lower(canonical_name), '\b(cepa|virus|variante)?\s*andes\b')
        then 'resolved' else 'ambiguous' end as status from {pathogen}""",
)
def _(spark, sf):
    p = view(spark, sf, "pathogen").select(
        "id",
        F.struct(
            F.col("canonical_name").alias("verbatim"), F.lit("old").alias("canonical_name"),
            F.lit("ambiguous").alias("normalization_status"), F.lit(0.5).alias("confidence"),
        ).alias("e"),
    )
    return p.select("id", identity.resolve_explicit_pathogen(F.col("e")).alias("e")).select(
        "id", "e.canonical_name", F.col("e.normalization_status").alias("status")
    )


@query("fn13_canonical_pair", "select relation_id, source_id as low, target_id as high from {rel}")
def _(spark, sf):
    r = view(spark, sf, "rel").select("relation_id", identity.canonical_pair(F.col("target_id"), F.col("source_id")).alias("p"))
    return r.select("relation_id", F.col("p.source").alias("low"), F.col("p.target").alias("high"))


@query(
    "fn14_event_code",
    """select relation_id, 'EVT-' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as code
    from (select relation_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('events:event:v0.4.9:' || source_id || ':' || target_id)) as h from {rel}) q""",
)
def _(spark, sf):
    return view(spark, sf, "rel").select("relation_id", identity.event_code(F.array("source_id", "target_id"), "pair").alias("code"))


@query(
    "fn15_row_sha256",
    """select signal_id, sha256('{"animal_to_human":"' || animal_to_human || '","human_to_human":"' || human_to_human || '","vector_borne":"' || vector_borne || '"}') as digest from {sig}""",
)
def _(spark, sf):
    s = signal_rows(spark, sf)
    return s.select("signal_id", identity.row_sha256(F.col("transmission"), s.schema["transmission"].dataType).alias("digest"))


@query(
    "fn16_signal_text",
    """select s.signal_id, s.signal_summary || coalesce(' ' || e.t, '') as full_text from {sig} s
    left join (select signal_id, string_agg(text, ' ' order by seq) as t from {sig_evidence} group by signal_id) e on e.signal_id = s.signal_id""",
)
def _(spark, sf):
    return nested_signals(spark, sf).select("signal_id", text.signal_text(F.col("signal_summary"), F.col("evidence")).alias("full_text"))


@query(
    "fn17_anchors",
    """select signal_id, case when signal_summary like '%MV Hondius%' then 'vessel:mv hondius' else '' end as anchor_list from {sig}""",
)
def _(spark, sf):
    return view(spark, sf, "sig").select("signal_id", F.array_join(text.anchors("signal_summary"), "|").alias("anchor_list"))


@query(
    "fn18_paragraphs",
    r"""select raw_item_id, count(*) as n_paragraphs, sum(length(body)) as n_characters, md5(string_agg(body, '|' order by i)) as text_md5
    from (select raw_item_id, i, regexp_replace(p, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') as body
      from (select raw_item_id, generate_subscripts(a, 1) as i, unnest(a) as p
        from (select raw_item_id, string_split_regex(raw_text, '\r?\n[ \t]*\r?\n') as a from {doc}) q) r) s
    where body <> '' group by raw_item_id""",
)
def _(spark, sf):
    p = view(spark, sf, "doc").select("raw_item_id", text.paragraphs("raw_text").alias("p")).filter(F.size("p") > 0)
    bodies = F.transform("p", lambda x: x["text"])
    return p.select(
        "raw_item_id", F.size("p").cast("long").alias("n_paragraphs"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_characters"),
        F.md5(F.array_join(bodies, "|")).alias("text_md5"),
    )


@query("fn19_mask_projection", "select c_custkey, c_mktsegment from {customer}")
def _(spark, sf):
    return mask_projection(view(spark, sf, "customer"), ["c_custkey", "c_mktsegment"])
