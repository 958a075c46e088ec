"""Derived views: the given tables reshaped into the roles the operators expect.

Each view is one SQL text that Spark and an ANSI-SQL checker both run.  ``{name}``
refers to a given table or to another view; :func:`view` resolves it with Spark and
:func:`with_views` renders the same text as a chain of common table expressions.
Every view reads its whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["doc"] = """
select cast(doc_id as string) as raw_item_id, doc_id as arrival,
  'src' || cast(doc_id % 5 as string) as source_code,
  'https://example.org/a/' || cast(doc_id % 97 as string) || case when doc_id % 3 = 0 then '/' else '' end as url,
  case when doc_id % 4 = 0 then null else 'Title ' || cast(doc_id % 11 as string) end as title,
  case when doc_id % 6 = 0 then null else cast('2026-05-04' as date) + cast(doc_id % 40 as int) end as published_on,
  lang as language, case when doc_id % 5 = 1 then null else 'text/html' end as mime_type,
  text as raw_text, n_chars
from {documents}
"""

VIEWS["page"] = """
select page_id, url, html,
  case when page_id % 10 = 9 then 'application/pdf' when page_id % 10 = 4 then ' Application/XHTML+XML ; charset=utf-8'
    when page_id % 10 = 7 then 'text/' when page_id % 10 = 2 then null else 'Text/HTML; charset=UTF-8' end as mime
from {pages}
"""

VIEWS["disease"] = """
select 'd' || cast(n_nationkey as string) as id,
  case when n_nationkey = 0 then 'Hantavirus disease' else 'Fever ' || n_name end as canonical_name,
  lower(n_name) || ' fever' as synonym_a, 'The ' || n_name || ' syndrome' as synonym_b
from {nation}
"""

VIEWS["pathogen"] = """
select 'p' || cast(n_nationkey as string) as id,
  case n_nationkey when 0 then 'Hantavirus' when 1 then 'Andes virus' when 2 then 'Orthohantavirus andesense'
    else 'Virus ' || n_name end as canonical_name,
  upper(n_name) || ' VIRUS' as synonym_a, n_name || ' agent' as synonym_b
from {nation}
"""

VIEWS["host_catalog"] = """
select cast(p_partkey as string) as id, p_name as common_name,
  case when p_partkey = 0 then 'Homo sapiens' when p_partkey % 3 = 0 then null else 'Species ' || cast(p_partkey as string) end as scientific_name,
  case p_partkey % 4 when 0 then 'human' when 1 then 'wildlife' when 2 then 'domestic_animal' else 'vector' end as host_type
from {part}
"""

# One row per signal.  Identities, dates and texts carry nulls and cues by modulo.
VIEWS["sig"] = """
select cast(event_id as string) as signal_id, event_id as n, cast(user_id as string) as raw_item_id,
  'k' || cast(event_id % 7 as string) as local_signal_key, cast(event_id as int) as version,
  event_id % 13 <> 0 as is_current,
  case event_id % 10 when 0 then 'background_context' when 1 then 'surveillance_baseline'
    when 2 then 'negative_evidence' else 'primary_event' end as signal_role,
  case event_id % 16 when 0 then 'outbreak' when 1 then 'cluster' when 2 then 'case_report' when 3 then 'outbreak'
    when 4 then 'laboratory_result' when 5 then 'genomic_observation' when 6 then 'transmission_observation'
    when 7 then 'outbreak' when 8 then 'intervention' when 9 then 'wildlife_event' when 10 then 'travel_or_mobility'
    when 11 then 'case_report' when 12 then 'mortality_event' when 13 then 'official_alert'
    when 14 then 'laboratory_investigation' else 'outbreak' end as signal_type,
  case event_id % 6 when 0 then 'confirmed' when 1 then 'probable' when 2 then 'refuted' when 3 then 'suspected'
    else 'reported' end as verification_status,
  case when event_id % 11 = 0 then null else 'd' || cast(user_id % 8 as string) end as disease_id,
  case when event_id % 9 = 0 then null else 'p' || cast(user_id % 20 as string) end as pathogen_id,
  case when event_id % 17 = 0 then null else cast(ts as date) end as occurred_start,
  case when event_id % 17 = 0 or event_id % 3 <> 0 then null else cast(ts as date) + cast(event_id % 4 as int) end as occurred_end,
  case when event_id % 17 = 0 and event_id % 2 = 0 then 2024 else null end as period_year,
  ts as created_at,
  case event_id % 3 when 0 then 'human' when 1 then 'animal' else 'wildlife' end as domain_a,
  case when event_id % 2 = 0 then 'environment' else null end as domain_b,
  case event_id % 12 when 6 then 'refuted' when 0 then 'possible' else 'unknown' end as human_to_human,
  case event_id % 10 when 2 then 'refuted' else 'unknown' end as animal_to_human,
  case event_id % 14 when 6 then 'documented' else 'unknown' end as vector_borne,
  case event_id % 5 when 0 then 'positive' when 1 then 'negative' when 2 then 'unknown' else null end as test_result,
  event_id % 4 = 1 as sequence_reported,
  case when event_id % 19 = 0 then 'Variante  SIN  relación con los casos del  brote'
    when event_id % 23 = 0 then 'Finding unrelated to the outbreak'
    when event_id % 29 = 0 then 'Casos a bordo del crucero MV Hondius, en viaje'
    else 'Report ' || event_type || ' ' || cast(user_id as string) end as signal_summary,
  event_type, value, props, user_id
from {events}
"""

VIEWS["sig_eligible"] = """
select s.*, d.canonical_name as disease_name, p.canonical_name as pathogen_name,
  s.signal_type <> 'official_alert' and s.signal_role not in ('background_context', 'surveillance_baseline')
    and (s.disease_id is not null or s.pathogen_id is not null) as event_matching_eligible
from {sig} s left join {disease} d on d.id = s.disease_id left join {pathogen} p on p.id = s.pathogen_id
"""

VIEWS["sig_loc"] = """
select signal_id, n, 0 as seq, case n % 4 when 0 then 'event_location' when 1 then 'possible_exposure_location'
    when 2 then 'Sampling_Location' else 'current_location' end as role,
  case when n % 6 = 5 then null else 'C' || cast(user_id % 3 as string) end as country_iso2, 'Country ' || cast(user_id % 3 as string) as country,
  'Adm ' || cast(user_id % 7 as string) as admin1, case when n % 3 = 0 then null else 'Dep ' || cast(n % 5 as string) end as admin2,
  case when n % 2 = 0 then null else 'Town  ' || cast(n % 11 as string) end as locality,
  case when n % 2 = 0 then 'admin2' else 'locality' end as prec, round(value / 500.0, 3) as confidence
from {sig}
union all
select signal_id, n, 1 as seq, case n % 3 when 0 then 'laboratory_location' when 1 then 'reporting_jurisdiction' else 'event_location' end as role,
  'C' || cast(n % 3 as string) as country_iso2, null as country, 'Adm ' || cast(n % 7 as string) as admin1, null as admin2,
  null as locality, 'admin1' as prec, 0.5 as confidence
from {sig} where n % 5 <> 0
"""

VIEWS["sig_host"] = """
select signal_id, n, 0 as seq, case n % 5 when 0 then 'human' when 1 then 'wildlife' when 2 then 'vector' when 3 then 'domestic_animal' else 'other' end as host_type,
  case when n % 3 = 0 then null else 'Host ' || cast(n % 6 as string) end as canonical_name, 'host  ' || cast(n % 9 as string) as verbatim, 0.7 as confidence
from {sig} where n % 7 <> 0
union all
select signal_id, n, 1 as seq, 'human' as host_type, 'Homo sapiens' as canonical_name, 'personas' as verbatim, 0.9 as confidence
from {sig} where n % 8 = 0
"""

VIEWS["sig_metric"] = """
select signal_id, n, 0 as seq, case n % 4 when 0 then 'new_cases' when 1 then 'cases_new' when 2 then 'deaths' else 'confirmed_cases' end as name,
  case when n % 5 = 0 then null else value end as value_numeric, case when n % 5 = 0 then 'several' else null end as value_text,
  case n % 3 when 0 then 'persons' when 1 then 'cases' else null end as unit,
  case n % 4 when 0 then '2024-01-15' when 1 then '2024' when 2 then '2024-13' else null end as as_of_date
from {sig} where n % 3 <> 1
"""

VIEWS["sig_evidence"] = """
select s.signal_id, s.n, 0 as seq, case s.n % 3 when 0 then 'quote' when 1 then 'Text' else 'table' end as type,
  case when s.n % 31 = 0 then '  ' when s.n % 10 = 7 then 'invented ' || s.event_type else s.event_type || ' seen by  ' || s.raw_item_id end as text,
  case when s.n % 4 = 0 then cast(s.n % 9 as int) else null end as page_number, s.raw_item_id
from {sig} s
union all
select s.signal_id, s.n, 1 as seq, 'text' as type,
  case when s.n % 38 = 0 then 'no relacionada con casos humanos' else 'value ' || s.event_type end as text,
  cast(null as int) as page_number, s.raw_item_id
from {sig} s where s.n % 2 = 0
"""

VIEWS["sig_diag"] = """
select signal_id, n, cast(n * 2 as string) as id, created_at, test_result is not null as test_reported, coalesce(test_result, 'unknown') as test_result,
  'pcr' as test_type
from {sig} where n % 2 = 0
union all
select signal_id, n, cast(n * 2 + 1 as string) as id, created_at, true as test_reported,
  case n % 3 when 0 then 'positive' else 'negative' end as test_result, 'serology' as test_type
from {sig} where n % 3 = 0
"""

# Signals of one reporter share a document; its text mentions some of their evidence.
VIEWS["raw_text"] = """
select raw_item_id, 'click seen by ' || raw_item_id || ' and view  seen by ' || raw_item_id
  || '. value click value view value error Signup seen by ' || raw_item_id as raw_text
from {sig} group by raw_item_id
"""

# Edges between consecutive signals of one reporter at most six hours apart.
VIEWS["rel"] = """
select 'r' || cast(m as string) as relation_id,
  least(cast(m as string), cast(n as string)) as source_id, greatest(cast(m as string), cast(n as string)) as target_id,
  case when n % 40 = 7 then 'ineligible' else 'eligible' end as gate,
  case when n % 6 = 0 then 'duplicates' when n % 6 = 1 then 'supports' else 'refines' end as relation,
  case when n % 15 = 3 then 'review_required' when n % 15 = 4 then 'rejected' else 'auto_linked' end as decision,
  n % 33 <> 5 as merge_allowed, n % 25 = 9 as hard_conflict,
  case when n % 50 = 11 then null else round(0.5 + (n % 500) / 1000.0, 3) end as score,
  case when n % 45 = 4 then 'vessel:ship ' || cast(user_id % 40 as string) when n % 45 = 14 then 'place:port' else null end as anchor,
  case when n % 90 = 1 then 'manual' else 'matcher' end as producer, created_at
from (
  select event_id as n, user_id, ts as created_at,
    lag(event_id) over (partition by user_id order by ts, event_id) as m,
    lag(ts) over (partition by user_id order by ts, event_id) as previous
  from {events}
) t where m is not null and created_at <= previous + interval '6' hour
"""

VIEWS["evt"] = """
select 'E' || cast(k as string) as event_id, k, case k % 7 when 0 then 'closed' when 1 then 'resolved' when 2 then 'monitoring' when 3 then null else 'active' end as lifecycle_status,
  'P' || cast(1 + k % 4 as string) as priority, total, first_date
from (
  select cast(floor(o_orderkey / 3) as bigint) as k, round(sum(o_totalprice), 2) as total, min(cast(o_orderdate as date)) as first_date
  from {orders} group by cast(floor(o_orderkey / 3) as bigint)
) t
"""

VIEWS["mem"] = """
select 'E' || cast(cast(floor(o_orderkey / 3) as bigint) as string) as event_id, cast(o_orderkey as string) as signal_id,
  case o_orderkey % 9 when 0 then 'manual_linked' when 1 then 'manual_unlinked' when 2 then 'review_required' when 3 then 'rejected' else 'auto_linked' end as match_decision,
  case when o_orderkey % 9 < 2 then 'ana' else null end as linked_by,
  case when o_orderkey % 14 = 5 then 'importer' else 'matcher' end as producer
from {orders} where o_orderkey % 4 = 0
union all
select 'E' || cast(cast(floor(o_orderkey / 6) as bigint) as string) as event_id, cast(o_orderkey as string) as signal_id,
  'auto_linked' as match_decision, cast(null as string) as linked_by, 'matcher' as producer
from {orders} where o_orderkey % 20 = 0 and o_orderkey > 5
"""

VIEWS["run"] = """
select 'R' || cast(o_orderkey as string) as run_id, o_orderkey as n, cast(o_custkey as string) as raw_item_id,
  case o_orderstatus when 'F' then 'failed' else 'succeeded' end as status,
  case when o_orderkey % 5 = 0 then null else 'document-v1' end as snapshot_policy,
  case when o_orderstatus = 'F' or o_orderkey % 30 = 1 then null else '{}' end as output_json,
  case when o_orderstatus = 'F' and o_orderkey % 20 <> 3 then 'error ' || o_orderpriority else null end as error_text,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 50 = 7 then -1 else o_orderkey % 900 end as input_tokens,
  case when o_orderkey % 4 = 0 then null else 0 end as cached_input_tokens,
  case when o_orderkey % 4 = 0 then null else o_orderkey % 70 end as output_tokens,
  cast(null as bigint) as reasoning_tokens,
  case when o_orderkey % 4 = 0 then null else o_orderkey % 970 end as total_tokens,
  cast(o_orderdate as date) as created_on
from {orders}
"""

# One row per claim: an order is a document, its lines are claims in a fixed order.
VIEWS["line"] = """
select cast(l_orderkey as string) as doc, l_orderkey as n_doc,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as int) as ord,
  l_partkey as pk, l_suppkey as sk, cast(l_quantity as bigint) as qty, l_returnflag, l_linestatus, cast(l_shipdate as date) as shipped,
  cast(round(l_discount * 100) as bigint) as disc
from {lineitem}
"""

VIEWS["clm"] = """
select doc, n_doc, ord, pk, sk, qty, 'c' || doc || '-' || cast(ord as string) as claim_id,
  case sk % 5 when 0 then null when 1 then '' else 'g' || cast(sk % 3 as string) end as group_id,
  case pk % 15 when 0 then 'outbreak_update' when 1 then 'case_status' when 2 then 'death_count' when 3 then 'surveillance_baseline'
    when 4 then 'wildlife_sampling' when 5 then 'wildlife_presence_absence' when 6 then 'diagnostic_result' when 7 then 'laboratory_investigation'
    when 8 then 'genomic_finding' when 9 then 'transmission_statement' when 10 then 'mobility' when 11 then 'historical_context'
    when 12 then 'intervention' when 13 then 'official_action' else 'syndromic_cluster' end as claim_kind,
  case when l_returnflag = 'R' then 'negative' when l_linestatus = 'O' then 'not_applicable' else 'positive' end as polarity,
  case pk % 4 when 0 then 'human' when 1 then 'animal' when 2 then 'human' else null end as domain_a,
  case when pk % 10 = 0 then 'environment' else null end as domain_b,
  case pk % 7 when 0 then 'hantavirus' when 1 then null when 2 then ' Hantavirus ' when 3 then ' ' when 4 then '' else 'dengue' end as disease_verbatim,
  case sk % 6 when 0 then 'virus Andes' when 1 then null when 2 then 'Orthohantavirus andesense' when 3 then 'hantavirus' when 4 then '' else 'flavivirus' end as pathogen_verbatim,
  case qty % 6 when 0 then 'human' when 1 then 'animal' when 2 then 'wildlife' when 3 then 'human' when 4 then 'vector' else 'other' end as subject_type,
  case qty % 7 when 0 then 'los casos confirmados' when 1 then 'personal del ministerio' when 2 then 'granjas' when 3 then null else 'subject ' || cast(sk % 4 as string) end as subject_verbatim,
  case when qty % 5 = 0 then 'Taxon ' || cast(sk % 3 as string) else null end as subject_name,
  'AR' as loc_iso2, 'Adm ' || cast(sk % 3 as string) as loc_admin1, case when pk % 3 = 0 then 'Town ' || cast(sk % 5 as string) else null end as loc_locality,
  case sk % 4 when 0 then 'event_location' when 1 then 'current_location' when 2 then 'reporting_jurisdiction' else 'laboratory_location' end as loc_role,
  case when pk % 4 = 1 then 'event_location' else null end as loc2_role,
  case when pk % 3 = 0 then null else cast(shipped as string) end as event_start, case when pk % 3 = 0 then 'unknown' when pk % 3 = 1 then 'day' else 'month' end as event_precision,
  case qty % 4 when 0 then 'historical_period' when 1 then 'unknown' when 2 then 'season' else 'surveillance_period' end as period_type,
  case when qty % 8 < 4 then 2019 else null end as period_from, case when qty % 8 < 5 then 2021 else null end as period_to,
  case when qty % 9 = 0 then 'last season' else null end as period_verbatim,
  pk % 2 = 0 as metric_reported, case pk % 6 when 0 then 'new_cases' when 2 then 'deaths' when 4 then 'confirmed_cases' else null end as metric_name,
  case when pk % 2 = 0 then cast(qty % 5 as double) else null end as metric_value,
  case when pk % 8 = 0 then '2024' when pk % 8 = 2 then '2024-05' when pk % 8 = 4 then '2024-05-06' else null end as metric_date,
  sk % 5 = 0 as test_reported, case sk % 7 when 0 then 'positive' when 1 then 'negative' when 2 then 'pending' when 3 then null when 4 then 'positive' else 'unknown' end as test_result,
  case when sk % 9 = 0 then 'Cepa de ORIGEN' else null end as test_target,
  qty % 3 = 0 as sequenced, case when qty % 12 = 0 then 'L1' else null end as lineage,
  case qty % 10 when 0 then 'documented' when 1 then 'refuted' else 'unknown' end as human_to_human, case disc when 3 then 'refuted' when 4 then 'possible' else 'unknown' end as animal_to_human,
  case disc when 0 then 'confirmed' when 1 then 'probable' when 2 then 'suspected' when 3 then 'refuted' when 4 then 'unknown' else 'reported' end as verification_status,
  case qty % 13 when 0 then 'Capacitación de equipos' when 1 then 'Se está investigando el origen del brote' when 2 then 'Variante viral no descripta previamente en casos humanos, diferente'
    when 3 then '  ' when 4 then 'Vigilancia del NOA de hantavirus' when 5 then 'Total a nivel nacional' else 'Claim ' || cast(pk % 5 as string) end as summary,
  case pk % 3 when 0 then 'quote' when 1 then 'excerpt' else 'table' end as evidence_type, 'obs ' || cast(qty as string) || case when qty % 11 = 0 then ' virus Andes' else '' end as evidence_text,
  case when pk % 5 = 0 then 'obs common ' || doc else null end as evidence2_text,
  case when pk % 13 = 0 then null else round(disc / 10.0, 1) end as confidence
from {line}
"""

# Adjudicated signals and predictions of the same lines: some dropped, some altered.
VIEWS["gold"] = """
select doc, n_doc, cast(ord - 1 as int) as idx, pk, sk, qty, 'G' || doc || '-' || cast(ord as string) as local_signal_id,
  case pk % 4 when 0 then 'background_context' when 1 then 'negative_evidence' else 'primary_event' end as signal_role,
  case pk % 5 when 0 then 'outbreak' when 1 then 'case_report' when 2 then 'laboratory_result' when 3 then 'intervention' else 'cluster' end as signal_type,
  case pk % 3 when 0 then 'Hantavirus disease' when 1 then null else 'Dengue' end as disease_name, case when pk % 2 = 0 then 'hantavirus' else ' Dengue  fever' end as disease_verbatim,
  case sk % 3 when 0 then 'Andes  virus' when 1 then null else '' end as pathogen_verbatim,
  case pk % 4 when 0 then 'new_cases' when 1 then 'cases_new' when 2 then 'deaths' else null end as metric_name, case when qty % 4 = 0 then null else cast(qty % 5 as double) end as metric_value,
  case qty % 3 when 0 then 'persons' when 1 then 'doses' else null end as metric_unit, cast(case when qty % 2 = 0 then 2024 else null end as int) as metric_year,
  'Adm ' || cast(sk % 4 as string) as admin1, 'event_location' as loc_role,
  case when pk % 3 = 0 then null else cast(shipped as string) end as event_start, case pk % 2 when 0 then 'season' else 'unknown' end as period_type,
  case qty % 3 when 0 then 'positive' when 1 then 'unknown' else null end as test_result,
  case pk % 3 when 0 then 'human' when 1 then 'animal' else 'wildlife' end as domain_a, case when qty % 2 = 0 then 'environment' else null end as domain_b,
  'Host ' || cast(qty % 3 as string) as host_name, case when qty % 2 = 0 then 'human' else 'wildlife' end as host_type,
  case pk % 3 when 0 then 'quote' when 1 then 'text' else 'excerpt' end as evidence_type,
  'Se confirmaron ' || cast(qty as string) || ' casos nuevos en la provincia de Adm ' || cast(sk % 4 as string) || case when pk % 6 = 0 then '; 2 probables' else '' end as evidence_text
from {line}
"""

VIEWS["pred"] = """
select doc, n_doc, idx, pk, sk, qty, 'P' || substr(local_signal_id, 2) as local_signal_id,
  case when sk % 10 = 1 then 'surveillance_baseline' else signal_role end as signal_role, case when sk % 10 = 2 then 'other' else signal_type end as signal_type,
  case when sk % 10 = 3 then null else disease_name end as disease_name, case when sk % 10 = 4 then 'HANTAVIRUS' else disease_verbatim end as disease_verbatim, pathogen_verbatim,
  case when metric_name = 'new_cases' and sk % 2 = 0 then 'cases_new' else metric_name end as metric_name, case when sk % 10 = 5 then metric_value + 1 else metric_value end as metric_value,
  case when metric_unit = 'persons' then 'cases' when sk % 10 = 6 then 'vials' else metric_unit end as metric_unit, cast(case when sk % 10 = 7 then 2023 else metric_year end as int) as metric_year,
  case when sk % 10 = 8 then 'Adm 9' else admin1 end as admin1, loc_role, case when sk % 10 = 9 then null else event_start end as event_start, period_type,
  case when sk % 9 = 1 then 'negative' else test_result end as test_result, domain_a, case when sk % 7 = 2 then 'animal' else domain_b end as domain_b, host_name,
  case when sk % 7 = 3 then 'vector' else host_type end as host_type, case when sk % 7 = 4 then 'document_text' else evidence_type end as evidence_type,
  case sk % 8 when 1 then 'Se confirmaron ' || cast(qty as string) || ' casos nuevos' when 2 then 'No ' || lower(evidence_text) when 3 then 'Se confirmaron ' || cast(qty + 1 as string) || ' casos nuevos en la provincia'
    when 4 then upper('se confirmaron  ') || substr(evidence_text, 16) when 5 then '2 probables' when 6 then 'Parte: ' || evidence_text || ' hoy' else evidence_text end as evidence_text
from {gold} where pk % 11 <> 0
"""

_REFERENCE = re.compile(r"\{([a-z_]+)\}")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remembered(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse an already analysed lazy plan of this session; no data is held, and the plans end with the session."""
    plans = spark.__dict__.setdefault("_derived_view_plans", {})
    if (sf_dir, name) not in plans:
        plans[sf_dir, name] = build()
    return plans[sf_dir, name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or derived view as a lazy DataFrame."""
    if name not in VIEWS:
        return remembered(spark, sf_dir, name, lambda: _rows(spark, sf_dir, name))
    return remembered(spark, sf_dir, name, lambda: run_sql(spark, sf_dir, VIEWS[name]))


def run_sql(spark: SparkSession, sf_dir: str, text: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """``text`` over the views it names; ``given`` frames stand in for the views of their names."""
    names = [n for n in dict.fromkeys(_REFERENCE.findall(text)) if n in VIEWS or n in TABLES]
    parts = {n: view(spark, sf_dir, n) for n in names} | (given or {})
    for n in names:
        text = text.replace("{" + n + "}", "{v_" + n + "}")
    text = text.replace("'{}'", "'{{}}'")
    return spark.sql(text, **{"v_" + n: df for n, df in parts.items()})


def _needed(text: str, seen: list[str]) -> None:
    for name in _REFERENCE.findall(text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)


def with_views(body: str, ctes: str = "") -> str:
    """Render ``body`` as one SQL text whose views are common table expressions.

    ``ctes`` holds further expressions (``name as (...)``) that may use the views.
    """
    seen: list[str] = []
    _needed(ctes + body, seen)
    chain = [f"{n} as ({_plain(VIEWS[n])})" for n in seen]
    if ctes.strip():
        chain.append(_plain(ctes.strip().rstrip(",")))
    return ("with recursive " + ",\n".join(chain) + "\n" if chain else "") + _plain(body)


def _plain(text: str) -> str:
    return _REFERENCE.sub(lambda m: m.group(1) if m.group(1) in VIEWS or m.group(1) in TABLES else m.group(0), text)
