import random

import pytest

from tallyfold.operators import lifecycle

LOAN = (
    "application_id long, global_position long, event_type string, recommendation string, confidence double, requested_amount double, override boolean, approved_amount double, "
    "compliance_status string, limit_amount double, override_reason string"
)
KINDS = ["ApplicationSubmitted", "CreditAnalysisRequested", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined", "Other"]


def plain_loan(events, ruled, limited, reasons):
    state, reviewed, cleared, limit = "EMPTY", False, False, None
    for at, kind, said, confidence, asked, override, amount, named, cap, why in events:
        error = None
        said = said.upper() if said else None
        if kind == "Other":
            continue
        allowed = {"ApplicationSubmitted": ("EMPTY",), "CreditAnalysisRequested": ("SUBMITTED", "AWAITING_ANALYSIS"), "DecisionGenerated": lifecycle.OPEN}.get(kind, lifecycle.REVIEWABLE)
        now = cleared if not (kind == "DecisionGenerated" and named) else named.upper() == "CLEARED"
        if state not in allowed:
            error = f"{kind} invalid in {state}"
        elif kind == "ApplicationSubmitted" and not (asked is not None and asked > 0):
            error = "requested amount must be positive"
        elif kind == "DecisionGenerated" and said not in ("APPROVE", "DECLINE", "REFER"):
            error = "unknown recommendation"
        elif kind == "DecisionGenerated" and confidence is not None and confidence < 0.6 and said != "REFER":
            error = "low confidence must refer"
        elif ruled and kind == "DecisionGenerated" and said == "APPROVE" and not now:
            error = "approval needs cleared compliance"
        elif reasons and kind == "HumanReviewCompleted" and override and not why:
            error = "override needs a reason"
        elif kind.startswith("Application") and kind != "ApplicationSubmitted" and not reviewed:
            error = "no human review before final event"
        elif ruled and kind == "ApplicationApproved" and not cleared:
            error = "compliance is not cleared"
        elif limited and kind == "ApplicationApproved" and amount is not None and limit is not None and amount > limit:
            error = "amount exceeds the assessed limit"
        if error:
            return state, error, at
        if kind == "DecisionGenerated":
            cleared, limit = now, cap if cap is not None else limit
            state = {"APPROVE": "APPROVED_PENDING_HUMAN", "DECLINE": "DECLINED_PENDING_HUMAN"}.get(said, "PENDING_DECISION")
        reviewed = reviewed or kind == "HumanReviewCompleted"
        state = {"ApplicationSubmitted": "SUBMITTED", "CreditAnalysisRequested": "AWAITING_ANALYSIS", "ApplicationApproved": "FINAL_APPROVED", "ApplicationDeclined": "FINAL_DECLINED"}.get(kind, state)
    return state, None, None


@pytest.mark.parametrize("ruled,limited,reasons", [(True, True, True), (False, False, False), (True, False, True)])
def test_loans_equal_a_plain_replay(spark, ruled, limited, reasons):
    draw, streams, at = random.Random(9), {}, 0
    usual = ["ApplicationSubmitted", "CreditAnalysisRequested", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved"]
    for app in range(400):
        kinds = list(usual)
        for _ in range(draw.randrange(4)):
            kinds.insert(draw.randrange(len(kinds) + 1), draw.choice(KINDS))
        for _ in range(draw.randrange(2)):
            kinds.pop(draw.randrange(len(kinds)))
        for kind in kinds:
            at += 1
            streams.setdefault(app, []).append((
                at, kind, draw.choice(["approve", "APPROVE", "DECLINE", "refer"] * 4 + ["x", None]), draw.choice([0.9, 0.8, None] * 3 + [0.2]), draw.choice([5.0] * 8 + [0.0, None]), draw.choice([True, False, None]),
                draw.choice([1.0, 2.0, 9.0]), draw.choice(["CLEARED", "cleared", "FAILED", "", None]), draw.choice([5.0, 8.0, None]), draw.choice(["why", "why", "", None]),
            ))
    rows = [(app, *e) for app, own in streams.items() for e in own]
    log = spark.createDataFrame(rows, LOAN).repartition(4)
    log = log.drop(*[c for c, there in (("compliance_status", ruled), ("limit_amount", limited), ("override_reason", reasons)) if not there])
    got = {r.application_id: (r.end_state, r.first_error, r.error_position) for r in lifecycle.loan_lifecycle(log).collect()}
    want = {app: plain_loan(own, ruled, limited, reasons) for app, own in streams.items() if any(e[1] != "Other" for e in own)}
    assert got == want and len({w[1] for w in want.values()}) >= 6


def plain_record(events):
    status, checks, passed, failed = "NOT_STARTED", None, set(), set()
    for at, kind, mandatory, rule in events:
        if kind == "ComplianceCheckRequested":
            error = "check requested twice" if checks is not None else None if mandatory else "no checks required"
        elif checks is None:
            error = "stream not initialized"
        else:
            error = "rule is not mandatory" if rule not in checks else "rule has failed already" if kind == "ComplianceRulePassed" and rule in failed else None
        if error:
            return status, len(passed), len(failed), error, at
        if kind == "ComplianceCheckRequested":
            checks = set(mandatory)
        elif kind == "ComplianceRulePassed":
            passed.add(rule)
        else:
            failed.add(rule)
            passed.discard(rule)
        status = "FAILED" if failed else "CLEARED" if passed == checks else "PENDING"
    return status, len(passed), len(failed), None, None


def test_records_equal_a_plain_replay(spark):
    draw, streams, at = random.Random(4), {}, 0
    for app in range(400):
        kinds = ["ComplianceCheckRequested"] * draw.choice([1, 1, 1, 1, 2, 0]) + [draw.choice(["ComplianceRulePassed"] * 4 + ["ComplianceRuleFailed"]) for _ in range(draw.randrange(6))]
        if draw.random() < 0.15:
            draw.shuffle(kinds)
        for kind in kinds:
            at += 1
            mandatory = draw.choice([["a", "b"], ["a", "b"], ["a"], ["b", "a", "b"], [], None]) if kind == "ComplianceCheckRequested" else None
            streams.setdefault(app, []).append((at, kind, mandatory, None if kind == "ComplianceCheckRequested" else draw.choice(["a", "b", "a", "b", "a", "b", "c"])))
    rows = [(app, *e) for app, own in streams.items() for e in own]
    log = spark.createDataFrame(rows, "application_id long, global_position long, event_type string, mandatory array<string>, rule_id string").repartition(4)
    got = {r.application_id: (r.status, r.passed, r.failed, r.first_error, r.error_position) for r in lifecycle.compliance_record(log).collect()}
    want = {app: plain_record(own) for app, own in streams.items()}
    assert got == want and len({w[3] for w in want.values()}) == 6
