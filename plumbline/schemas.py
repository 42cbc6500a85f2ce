"""Schemas of the tables that operators read and write, as DDL."""

RESULT = "struct<rank:int,section_rank:int,provider_order:int,url:string,title:string,snippet:string,published_date:string,date_semantics:string,source:string,oracle_snippet_gold:boolean>"
STEP = f"struct<type:string,query:string,tokens:double,results:array<{RESULT}>>"
TRAJECTORY_ROW = (
    "row_id string, condition string, task_key string, expected array<string>, "
    f"output struct<final_answer:string,decision_surface:string,used_searches:int,used_clicks:int,trajectory:array<{STEP}>>, "
    "metadata struct<link:string,articles:array<struct<url:string,link:string>>,event_date:string,date:string,search_budget:int,answer_aliases:array<string>,exclusion_requested:boolean>"
)
SPAN = (
    "id string, root_span_id string, span_id string, is_root boolean, span_attributes struct<name:string,purpose:string>, "
    "origin struct<object_type:string,object_id:string,id:string>, input variant, expected array<string>, output variant, error string, "
    "metadata variant, metrics map<string,double>, scores map<string,double>, line_no bigint"
)
EXPORT_RECORD = "id string, root_span_id string, condition string, task_key string, dataset_record_id string, dataset_row_id string, score variant, scores variant, input variant, expected array<string>, output variant, metadata variant, metrics variant, line_no bigint"
CANONICAL_ROW = "task_key string, condition string, study_id string, dataset_name string, dataset_version string, category string, score double, searches double, answer_words double, total_cost_usd double, line_no bigint"
VARIABLE_ROW = (
    "condition string, model string, arm string, task_key string, dataset_row_id string, category string, question_type string, question string, expected array<string>, "
    "event_date string, evaluated_at string, event_age_days int, gated double, judge double, qa_match double, dealbreaker_gate double, snippet_sufficiency double, "
    "evidence_precision double, token_discounted_gain double, temporal_grounding double, domain_entropy double, compression_redundancy double, used_searches double, "
    "answer_words double, latency_s double, zero_search boolean, search_failed boolean, search_degraded boolean, refused boolean, truncated boolean"
)
FACT_EVENT = (
    "entity_id string, entity_name string, entity_type string, attribute string, old_value string, new_value string, effective_ts timestamp, observed_ts timestamp, "
    "source_url string, source_type string, resolver_id string, attester_id string, attester_role string, authority_family string, compliance_source_id string, "
    "distribution_rights_confirmed boolean, aliases array<string>, line_no bigint"
)
TRAP_OBSERVATION = "trap_id string, question string, entity_id string, entity_name string, entity_type string, attribute string, scheduled_resolution_ts timestamp, observed_ts timestamp, source_url string, source_type string, resolver_id string, attester_id string, authority_family string, compliance_source_id string, distribution_rights_confirmed boolean, line_no bigint"
COVERAGE = "entity_id string, attribute string, new_value string, reference_engine string, query string, queried_ts timestamp, top_k int, answer_bearing_domains array<string>, compliance_source_id string, storage_rights_confirmed boolean, evidence_artifact_sha256 string"
FILING_CANDIDATE = "cik string, entity_name string, accession_number string, filing_date date, report_date date, acceptance_ts timestamp, primary_document string, filing_url string, items array<string>"
OWNERSHIP_REF = "issuer_cik string, form_type string, accession_number string, filing_date date, period_of_report date, primary_document string, filing_url string, paired array<string>"
SPORTS_CANDIDATE = "source_event_id string, sport string, competition string, season string, event_start_ts timestamp, observed_ts timestamp, home_team string, away_team string, home_score int, away_score int, source_url string, source_type string, resolver_id string, authority_family string, compliance_source_id string"
SPORTS_DECISION = "decision_id string, approved boolean, canonical_event_id string, canonical_home_team string, canonical_away_team string, effective_ts timestamp, observations array<struct<resolver_id:string,source_event_id:string,reverse_teams:boolean>>"
