"""Schemas of the engine's tables as DDL strings."""

BINDING = "struct<scope:string,ref:string>"
VARIANT = "struct<form:string,provenance:string,count:int,last_seen:timestamp>"
GUARD = "struct<kind:string,form:string,support_tokens:array<string>,veto_tokens:array<string>,applies_to_forms:array<string>,reverts:int,scope:string,synthesised:boolean,note:string>"
LEXEMES = (
    f"lexeme_id string, canonical string, kind string, instruction string, variants array<{VARIANT}>, guards array<{GUARD}>, bindings array<{BINDING}>, "
    "prior_alpha double, prior_beta double, alpha double, beta double, state string, learning_enabled boolean, first_seen timestamp, last_used timestamp"
)
OBSERVATIONS = (
    "id string, source string, polarity string, at timestamp, before_form string, after_form string, scope string, scope_ref string, utterance_id string, "
    "surrounding_text string, lexeme_id string, phonetic_distance double, accepted boolean, note string, meta map<string,string>"
)
UTTERANCES = "utterance_id string, asr_text string, formatted_text string, app string, persona string, surrounding_text string"
EDGES = "a string, b string, rel string, weight double"
TOMBSTONES = "id string, reason string, canonical string, match_forms array<string>, source_lexeme_id string, replacement_lexeme_id string, created_at timestamp"
OUTCOME = "struct<policy:string,signal:string,weight:double,reason:string>"
DECISIONS = (
    "utterance_id string, at timestamp, app string, persona string, asr_text string, formatted_text string, output_text string, gate_passed boolean, intervened boolean, verifier_rejected boolean, "
    f"resolutions array<struct<lexeme_id:string,span_start:int,span_end:int,span_text:string,replacement:string,via:string,score:double,verdict:string,reason:string,outcomes:array<{OUTCOME}>>>, primary_reason string, observation_watermark timestamp"
)
PERSONA = (
    "persona struct<name:string,role:string,location:string,apps:array<string>,clock:string>, "
    "lexemes array<struct<id:string,canonical:string,kind:string,instruction:string,variants:array<struct<form:string,provenance:string,count:int>>,"
    "guards:array<struct<kind:string,payload:struct<form:string,support_tokens:array<string>,veto_tokens:array<string>,applies_to_forms:array<string>>,note:string>>,"
    "state:string,confidence:struct<alpha:double,beta:double>,bindings:array<struct<scope:string,ref:string>>,learning_enabled:boolean,last_used:string>>, "
    "edges array<struct<a:string,b:string,rel:string,weight:double>>"
)
CASES = (
    "case_id string, kind string, class string, tier string, rationale string, expect string, "
    "given struct<asr:string,formatted:string,app:string,persona:string,surrounding_text:string,clock:string,memory_overrides:map<string,struct<state:string,learning_enabled:boolean,last_used:string>>>, "
    "then struct<output:string,changes:array<struct<`from`:string,`to`:string,lexeme_id:string>>,reason:string,max_llm_calls:int,must_not_contain:array<string>>"
)
