"""Typed payloads: what each event type and command holds, and where a JSON text departs from it (P-12).

Fields are written ``name kind bounds``: ``?`` after a kind admits null and absence, ``~`` absence
alone; bounds are ``>0``, ``>=0`` and ``0..1``.  Checking is one expression over variants for
all types: no row is taken apart, no UDF runs, and the fields are looked up by the row's type.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import bound

#: The fields of each event's payload.
EVENTS = {
    "ApplicationSubmitted": "application_id str, requested_amount_usd float >0, applicant_id str?, loan_purpose str?, submission_channel str?, submitted_at str?",
    "DocumentUploadRequested": "application_id str, requested_at str, requested_by str?, document_path str?",
    "DocumentUploaded": "application_id str, uploaded_at str, uploaded_by str?, document_path str?",
    "PackageCreated": "application_id str, package_id str, created_at str",
    "DocumentAdded": "application_id str, document_path str, document_type str, added_at str",
    "DocumentFormatValidated": "application_id str, document_path str, format str, is_supported bool",
    "ExtractionStarted": "application_id str, document_path str, started_at str, pipeline str",
    "ExtractionCompleted": (
        "application_id str, document_path str, facts dict, fact_provenance dict~, extraction_context dict~, field_confidence dict[float], extraction_notes list~, completed_at str"
    ),
    "QualityAssessmentCompleted": (
        "application_id str, overall_confidence float 0..1, is_coherent bool, anomalies list~, critical_missing_fields list~, reextraction_recommended bool, auditor_notes str?"
    ),
    "PackageReadyForAnalysis": "application_id str, package_id str, ready_at str",
    "CreditAnalysisRequested": "application_id str, assigned_agent_id str?, requested_at str?, priority str?, source str?, docpkg_stream_id str?",
    "FraudScreeningRequested": "application_id str, assigned_agent_id str?, requested_at str?, priority str?, source str?, docpkg_stream_id str?",
    "AgentContextLoaded": "agent_id str, session_id str, model_version str, context_source str?, event_replay_from_position int? >=0, context_token_count int? >0",
    "AgentSessionStarted": "agent_id str, session_id str, model_version str, context_source str, context_token_count int >0, started_at str?",
    "AgentSessionRecovered": "agent_id str, session_id str, recovered_from_session_id str, context_source str, recovered_at str?",
    "CreditAnalysisCompleted": (
        "application_id str, agent_id str, session_id str, recommended_limit_usd float? >0, input_data_hash str?, model_version str?, confidence_score float? 0..1, "
        "risk_tier str?, analysis_duration_ms int? >=0, regulatory_basis str?"
    ),
    "FraudScreeningCompleted": (
        "application_id str, agent_id str, fraud_score float 0..1, anomaly_flags list~, screening_model_version str, input_data_hash str, session_id str?"
    ),
    "ComplianceCheckRequested": "application_id str, regulation_set_version str, checks_required list",
    "ComplianceRulePassed": "application_id str, rule_id str, rule_version str, evaluation_timestamp str?, evidence_hash str?",
    "ComplianceRuleFailed": "application_id str, rule_id str, rule_version str, failure_reason str, remediation_required bool~",
    "ComplianceCheckCompleted": "application_id str, overall_verdict str, completed_checks int >=0, total_checks int >=0, failed_rule_ids list~, completed_at str?",
    "DecisionRequested": "application_id str, requested_at str, requested_by str?, required_inputs list~",
    "DecisionGenerated": (
        "application_id str, recommendation str, orchestrator_agent_id str?, confidence_score float? 0..1, contributing_agent_sessions list~, decision_basis_summary str?, "
        "model_versions dict[str]~, compliance_status str?, assessed_max_limit_usd float?"
    ),
    "HumanReviewRequested": "application_id str, requested_at str, requested_by str?, recommendation str?",
    "HumanReviewCompleted": "application_id str, reviewer_id str, final_decision str, override bool~, override_reason str?",
    "ApplicationApproved": "application_id str, approved_amount_usd float >0, interest_rate float?, conditions list~, approved_by str?, effective_date str?",
    "ApplicationDeclined": "application_id str, decline_reasons list~, declined_by str?, adverse_action_notice_required bool~",
    "AuditIntegrityCheckRun": "entity_id str, events_verified_count int >=0, integrity_hash str, check_timestamp str?, previous_hash str?, chain_valid bool?, tamper_detected bool?",
}

_TRACE = ", correlation_id str?, causation_id str?"
#: The arguments of each command.
COMMANDS = {
    "submit_application": (
        "application_id str, applicant_id str, requested_amount_usd float >0, loan_purpose str, submission_channel str, submitted_at time, document_path str?, document_paths list~, "
        "process_documents_after_submit bool~" + _TRACE
    ),
    "start_agent_session": "agent_id str, session_id str, context_source str, event_replay_from_position int >=0, context_token_count int >0, model_version str" + _TRACE,
    "record_credit_analysis": (
        "application_id str, agent_id str, session_id str, model_version str, confidence_score float 0..1, risk_tier str, recommended_limit_usd float >0, analysis_duration_ms int >=0, "
        "input_data_hash str" + _TRACE
    ),
    "record_fraud_screening": (
        "application_id str, agent_id str, session_id str, fraud_score float 0..1, anomaly_flags list, screening_model_version str, input_data_hash str" + _TRACE
    ),
    "record_compliance_check": (
        "application_id str, regulation_set_version str, rule_id str, rule_version str, passed bool, checks_required list~, failure_reason str?, remediation_required bool~" + _TRACE
    ),
    "generate_decision": (
        "application_id str, orchestrator_agent_id str, recommendation str, confidence_score float 0..1, decision_basis_summary str, contributing_agent_sessions list, "
        "model_versions dict[str]" + _TRACE
    ),
    "record_human_review": (
        "application_id str, reviewer_id str, override bool~, final_decision str, override_reason str?, approved_amount_usd float?, interest_rate float?, conditions list~, "
        "effective_date str?, decline_reasons list~" + _TRACE
    ),
    "run_integrity_check": "entity_type str, entity_id str, role str" + _TRACE,
}

_FIELD = re.compile(r"(?P<name>\w+) (?P<kind>str|float|int|bool|time|list|dict)(\[(?P<of>str|float)\])?(?P<lax>[?~]?)( (?P<bound>\S+))?$")
_ENTRY = "array<struct<name:string,kind:string,of:string,lax:string,above:double,least:double,most:double>>"
TRUTH = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")


def fields(text: str) -> list[dict]:
    """A model's fields as records."""
    out = []
    for part in text.split(", "):
        found = _FIELD.match(part)
        if found is None:
            raise ValueError(f"no field: {part}")
        bound = found["bound"] or ""
        record = {k: found[k] for k in ("name", "kind", "of", "lax")}
        record["above"] = float(bound[1:]) if re.fullmatch(r">\d+", bound) else None
        record["least"] = float(bound[2:]) if bound.startswith(">=") else float(bound.split("..")[0]) if ".." in bound else None
        record["most"] = float(bound.split("..")[1]) if ".." in bound else None
        out.append(record)
    return out


def _error(loc: Column, code: Column | str) -> Column:
    return F.struct(loc.alias("loc"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def _number(x: Column, t: Column) -> Column:
    """(text, value) of a number; numeric texts and truth values count as numbers."""
    text = F.trim(F.try_variant_get(x, "$", "string"))
    value = F.when(t == "STRING", text.try_cast("double")).when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).otherwise(F.try_variant_get(x, "$", "double"))
    return F.struct(text.alias("text"), value.alias("value"))


def _number_code(n: Column, t: Column, kind: str) -> Column:
    """Why a value is no number, by its ``_number``."""
    value = n["value"]
    scalar = (t == "STRING") | (t == "BOOLEAN") | t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    code = F.when(~scalar, f"{kind}_type").when(value.isNull() | F.isnan(value), f"{kind}_parsing")
    if kind == "int":
        code = code.when((t == "STRING") & ~n["text"].rlike(r"^[+-]?[0-9]+(\.0*)?$"), "int_parsing").when(value != F.floor(value), "int_from_float")
    return code


def _value_errors(x: Column, t: Column, f: Column) -> Column:
    """Errors of a value that is there and isn't null."""
    kind, loc = f["kind"], f["name"]

    def of_number(n: Column) -> Column:
        number = n["value"]
        bounds = (
            F.when(f["above"].isNotNull() & ~(number > f["above"]), "greater_than").when(f["least"].isNotNull() & (number < f["least"]), "greater_than_equal")
            .when(f["most"].isNotNull() & (number > f["most"]), "less_than_equal")
        )
        truth = F.when(t == "BOOLEAN", None).when(t == "STRING", F.when(~F.lower(n["text"]).isin(*TRUTH), "bool_parsing"))
        truth = truth.when(t.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.when(~number.isin(0.0, 1.0), "bool_parsing")).otherwise("bool_type")
        return (
            F.when(kind == "float", F.coalesce(_number_code(n, t, "float"), bounds)).when(kind == "int", F.coalesce(_number_code(n, t, "int"), bounds)).otherwise(truth)
        )

    moment = F.when(t != "STRING", "datetime_type").when(F.try_to_timestamp(F.try_variant_get(x, "$", "string")).isNull(), "datetime_from_date_parsing")
    code = (
        F.when(kind == "str", F.when(t != "STRING", "string_type")).when(kind.isin("float", "int", "bool"), bound(_number(x, t), of_number))
        .when(kind == "time", moment).when(kind == "list", F.when(~F.startswith(t, F.lit("ARRAY")), "list_type"))
        .when(kind == "dict", F.when(~F.startswith(t, F.lit("OBJECT")), "dict_type"))
    )
    items = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda v, i: F.when(F.schema_of_variant(v) != "STRING", _error(F.concat(loc, F.lit("."), i.cast("string")), "string_type")))
    pairs = F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))

    def pair_code(v: Column) -> Column:
        of_kind = lambda t: F.when((f["of"] == "str") & (t != "STRING"), "string_type").when(f["of"] == "float", bound(_number(v, t), lambda n: _number_code(n, t, "float")))
        return bound(F.schema_of_variant(v), of_kind)

    values = F.transform(pairs, lambda e: bound(pair_code(e["value"]), lambda c: F.when(c.isNotNull(), _error(F.concat(loc, F.lit("."), e["key"]), c))))
    inner = F.when(kind == "list", items).when((kind == "dict") & f["of"].isNotNull(), values)
    none = F.array().cast("array<struct<loc:string,code:string>>")
    return bound(code, lambda c: F.when(c.isNotNull(), F.array(_error(loc, c))).otherwise(F.array_compact(F.coalesce(inner, none))))


def violations(kind: str | Column, payload: str | Column, models: dict[str, str] = EVENTS) -> Column:
    """Where a payload departs from its type's fields: array of (loc, code), in the order of the fields, then extra keys.

    An unknown type is one error, as is a text that is no JSON object; a null payload is no object.
    """
    kind, payload = (F.col(c) if isinstance(c, str) else c for c in (kind, payload))
    table = F.from_json(F.lit(json.dumps({name: fields(text) for name, text in models.items()})), f"map<string,{_ENTRY}>")
    none = F.array().cast("array<struct<loc:string,code:string>>")

    def of_field(f: Column, held: Column, keys: Column) -> Column:
        there = F.coalesce(F.array_contains(keys, f["name"]), F.lit(False))
        wrong_null = F.when(
            f["lax"] != "?", F.array(_error(f["name"], F.when(f["kind"] == "str", "string_type").when(f["kind"] == "time", "datetime_type").otherwise(F.concat(f["kind"], F.lit("_type")))))
        )
        # A null value is null after the cast to a map, or a null variant.
        of_value = lambda y: F.when(y["x"].isNull() | (y["t"] == "VOID"), F.coalesce(wrong_null, none)).otherwise(_value_errors(y["x"], y["t"], f))
        value = bound(F.try_element_at(held, f["name"]), lambda x: bound(F.struct(x.alias("x"), F.schema_of_variant(x).alias("t")), of_value))
        return F.when(~there, F.when(f["lax"] == "", F.array(_error(f["name"], "missing"))).otherwise(none)).otherwise(value)

    def of_payload(p: Column) -> Column:
        wanted, held = p["wanted"], p["held"]
        extra = F.transform(F.array_sort(F.array_except(p["keys"], wanted["name"])), lambda k: _error(k, "extra_forbidden"))
        whole = F.concat(F.flatten(F.transform(wanted, lambda f: of_field(f, held, p["keys"]))), extra)
        return F.when(wanted.isNull(), F.array(_error(F.lit("event_type"), "unknown_type"))).when(held.isNull(), F.array(_error(F.lit(""), "model_type"))).otherwise(whole)

    # The text is parsed once, and a value taken out of it once.
    held = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    keyed = lambda h: F.struct(F.try_element_at(table, kind).alias("wanted"), h.alias("held"), F.map_keys(h).alias("keys"))
    return bound(bound(held, keyed), of_payload)


def example(text: str) -> dict:
    """A payload that fits a model."""
    values = {"str": "x", "float": 0.5, "int": 1, "bool": True, "time": "2024-01-01T00:00:00", "list": ["x"], "dict": {"k": 1}}
    return {f["name"]: {"k": 0.5 if f["of"] == "float" else "v"} if f["of"] else values[f["kind"]] for f in fields(text)}
