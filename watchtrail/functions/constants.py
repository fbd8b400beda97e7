"""Lists, tables, weights and wording whose exact text is the contract."""

from __future__ import annotations

# --- fixed values: the model's inputs, in trained order ---------------------------
FEATURES = (
    "hour_of_day",
    "is_weekend",
    "failed_call",
    "sensitive_operation",
    "unusual_hour",
    "external_ip",
    "outside_home_region",
    "calls_last_5m",
    "failed_calls_last_5m",
    "unique_services_last_1h",
    "iam_calls_last_1h",
    "api_risk_score",
)
TARGET = "label_binary"
DEFAULT_THRESHOLD_KEY = "anomaly_threshold"
HOME_REGION = "us-east-1"
SCHEMA_VERSION = "1.0"
IDENTITY = ("principal_id", "source_ip", "event_name", "service", "region")

# --- fixed values: longest accepted text per field --------------------------------
EVENT_LENGTHS = {
    "event_id": 128,
    "principal_id": 256,
    "source_ip": 64,
    "event_name": 256,
    "service": 128,
    "region": 64,
}
RAW_LENGTHS = {
    "event_id": 128,
    "principal_id": 256,
    "event_name": 256,
    "service": 128,
    "user_agent": 512,
}
ACCOUNT_PATTERN = r"^\d{12}$"
REGION_PATTERN = r"^[a-z]{2}(?:-gov)?-[a-z]+-\d$"

# --- fixed values: score blend and cutoffs ----------------------------------------
MODEL_WEIGHT = 0.70
RULE_WEIGHT = 0.30
HIGH_RISK = 0.70
MEDIUM_RISK = 0.40
API_RISK_WEIGHT = 0.25
API_RISK_REASON_FROM = 0.70
DEFAULT_API_RISK = 0.5

# --- fixed values: rule weight and sentence, in reporting order -------------------
RULES = (
    ("sensitive_operation", 0.20, "The event performed a sensitive operation."),
    ("unusual_hour", 0.15, "The event happened at an unusual time."),
    ("external_ip", 0.20, "The activity came from an external IP."),
    ("outside_home_region", 0.10, "The activity occurred outside the home Region."),
    ("failed_call", 0.10, "The AWS API call failed."),
)
API_RISK_REASON = "The AWS API action has a high security risk."
MODEL_REASON = "The machine-learning model marked the behavior as unusual."
NO_FINDING_REASON = "No major security-warning rules were triggered."

# --- fixed values: promotion gates ------------------------------------------------
QUALITY_GATES = {"recall": 0.70, "precision": 0.70, "pr_auc": 0.65}

# --- fixed values: address prefixes treated as internal ---------------------------
INTERNAL_PREFIXES = ("10.", "192.168.", "127.", "169.254.", "172.16.", "172.31.")

# --- fixed values: attack categories and the API calls that name them -------------
ATTACK_CATEGORIES = {
    "credential-compromise": (
        "createaccesskey", "consolelogin", "getsessiontoken", "assumerole",
    ),
    "privilege-escalation": (
        "attachuserpolicy", "attachrolepolicy", "putrolepolicy", "putuserpolicy",
        "updateassumerolepolicy", "createpolicyversion",
    ),
    "reconnaissance": (
        "listusers", "listroles", "describesecuritygroups", "getcalleridentity",
        "describeinstances",
    ),
    "data-exfiltration": (
        "getobject", "selectobjectcontent", "batchgetitem", "createdbsnapshot",
        "copysnapshot",
    ),
    "defense-evasion": (
        "stoplogging", "deletetrail", "puteventselectors", "deleteflowlogs",
        "deleteloggroup",
    ),
    "public-exposure": (
        "putbucketpolicy", "putpublicaccessblock", "deletepublicaccessblock",
        "authorizesecuritygroupingress", "putbucketacl",
    ),
}

# --- fixed values: service that implies a category when the call is unknown -------
SERVICE_CATEGORIES = {
    "credential-compromise": ("iam", "sts", "signin"),
    "data-exfiltration": ("s3", "dynamodb", "rds"),
    "defense-evasion": ("cloudtrail",),
}
ENUMERATION_PREFIXES = ("list", "describe")
DATA_READ_CALLS = ("query", "scan", "getobject", "batchgetitem")

# --- fixed values: calls and services that are sensitive whatever the category ----
SENSITIVE_CALLS = (
    "createaccesskey", "deleteaccesskey", "updateaccesskey", "attachuserpolicy",
    "attachrolepolicy", "putrolepolicy", "putuserpolicy", "updateassumerolepolicy",
    "createpolicyversion", "createuser", "createrole", "deleteuser", "deleterole",
    "stoplogging", "deletetrail", "puteventselectors", "putbucketpolicy",
    "putpublicaccessblock", "deletepublicaccessblock",
)
SENSITIVE_SERVICES = ("iam", "sts", "cloudtrail", "organizations", "kms")

# --- fixed values: explanation cutoffs --------------------------------------------
HIGH_ANOMALY = 0.70
REPEATED_FAILURES = 2
WORKING_HOURS = (8, 19)

# --- fixed values: correlation weights, in reporting order ------------------------
CORRELATION_WEIGHTS = {
    "principal_id": 5,
    "source_ip": 5,
    "attack_category": 3,
    "event_name": 2,
    "service": 1,
    "region": 1,
}
MIN_CORRELATION = 2
RELATED_LIMIT = 25

# --- fixed values: advice per category --------------------------------------------
PLAYBOOKS = {
    "credential-compromise": (
        "Disable or rotate the affected access key",
        "Review recent activity by the principal",
        "Invalidate active sessions",
        "Check for unauthorized IAM changes",
        "Preserve CloudTrail evidence",
    ),
    "privilege-escalation": (
        "Review the policy or role change and revert it if unauthorized",
        "Identify which principal made the change and on whose behalf",
        "Audit the principal's effective permissions for further escalation",
        "Invalidate active sessions for the affected role",
        "Preserve CloudTrail evidence",
    ),
    "data-exfiltration": (
        "Verify data access patterns for the principal",
        "Review the affected S3 bucket policy or database permissions",
        "Check CloudTrail and S3 access logs for large or unusual transfers",
        "Confirm whether the accessed data was sensitive or regulated",
        "Preserve CloudTrail evidence for the associated resources",
    ),
    "defense-evasion": (
        "Re-enable the disabled trail, flow log, or log group immediately",
        "Determine the logging gap and what activity it may have hidden",
        "Review all activity by the principal during the gap",
        "Restrict CloudTrail and logging permissions to break-glass roles",
        "Preserve any remaining CloudTrail evidence",
    ),
    "public-exposure": (
        "Confirm whether the resource is currently reachable from the internet",
        "Restore the public access block or restrictive resource policy",
        "Review the security group or bucket policy change that opened access",
        "Check access logs for requests during the exposure window",
        "Preserve CloudTrail evidence",
    ),
    "reconnaissance": (
        "Review the full sequence of enumeration calls by the principal",
        "Establish whether the principal normally performs discovery calls",
        "Watch for follow-on privilege escalation or data access",
        "Confirm the credential used is still expected to be active",
        "Preserve CloudTrail evidence",
    ),
}
DEFAULT_ACTIONS = (
    "Review recent activity by the principal",
    "Confirm the activity with the resource owner",
    "Inspect VPC Flow Logs for related network activity",
    "Preserve CloudTrail evidence",
)
ESCALATION = "Escalate to the on-call security responder for containment approval"
