"""Fixed values that results depend on."""

# Delinquency event and horizon.
EVENT_DAYS_LATE = 30
HORIZON_MONTHS = 12
UNPAID_DAYS_LATE = 9999

# Ordered split fractions.
TRAIN_FRACTION = 0.70
CALIB_FRACTION = 0.10

# Exclusive upper PD bound of each grade, best first.
GRADE_BANDS = (
    (0.01, "A"),
    (0.02, "B"),
    (0.04, "C"),
    (0.07, "D"),
    (0.12, "E"),
    (0.20, "F"),
    (1.01, "G"),
)
GRADES = ("A", "B", "C", "D", "E", "F", "G")
HIGH_RISK_GRADES = ("E", "F", "G")

# Recommended action of each grade.
GRADE_ACTIONS = {
    "A": "Normal monitoring cadence",
    "B": "Normal monitoring cadence",
    "C": "Monthly review; enter Watch List",
    "D": "Monthly review; enter Watch List",
    "E": "Enhanced monitoring; proactive restructuring offer",
    "F": "Enhanced monitoring; proactive restructuring offer",
    "G": "Immediate intervention; exposure-limitation protocol",
}

# What a borrower is told about each grade.
BORROWER_LANGUAGE = {
    "A": "routine monitoring — no action needed on your side",
    "B": "routine monitoring — no action needed on your side",
    "C": "monthly review — your lender will check in with you more often",
    "D": "monthly review — your lender will check in with you more often",
    "E": "enhanced monitoring — your lender may reach out to discuss support options",
    "F": "enhanced monitoring — your lender may reach out to discuss support options",
    "G": "immediate attention — please contact your relationship manager",
}
BORROWER_NO_SUGGESTION = (
    "A single specific improvement suggestion is not available for your account type right "
    "now — your relationship manager can walk you through what would help."
)

# Expected loss per unit of exposure.
LOSS_GIVEN_DEFAULT = 0.45

# Population-stability thresholds.
PSI_RETRAIN = 0.2
PSI_SCORE_TOLERANCE = 0.1
PSI_BINS = 10
PSI_FLOOR = 1e-4

# Confidence bands.
WIDE_HALF_WIDTH = 0.10
MIN_COMPARABLE = 50
DISAGREEMENT_MARGIN = 0.15
Z_95 = 1.96
BAND_BINS = 8
MIN_ROWS_FOR_BINS = 200
GLOBAL_SEGMENT = "__global__"

# Graph features.
ANCHOR_PERCENTILE = 0.8
SEPARABILITY_MIN_AUC = 0.80

# Fairness flag and data richness.
DISPARITY_FLAG = 1.25
MIN_BUREAU_RECORDS = 2
THIN_FILE = "ntc_ntb"
ESTABLISHED = "established"

# Applicant tenure.
EMPLOYED_SENTINEL = 365243
DAYS_PER_YEAR = 365.25

# Contract type to segment.
LOAN_TYPES = {
    "Cash loans": "term_loan_proxy",
    "Revolving loans": "working_capital_proxy",
}
OTHER_LOAN_TYPE = "other_proxy"

# Organisation type to sector.
SECTORS = {
    "Manufacturing": tuple(f"Industry: type {i}" for i in range(1, 14)) + ("Construction",),
    "Retail_Trade": tuple(f"Trade: type {i}" for i in range(1, 8)) + ("Restaurant", "Realtor", "Hotel"),
    "Services_IT": (
        "Business Entity Type 1",
        "Business Entity Type 2",
        "Business Entity Type 3",
        "Bank",
        "Insurance",
        "Legal Services",
        "Advertising",
        "Telecom",
        "Mobile",
        "Services",
        "Cleaning",
        "Security",
        "Self-employed",
    ),
    "Agriculture_Allied": ("Agriculture",),
}
OTHER_SECTOR = "Other_Public"

# Defaults after the feature joins.
FEATURE_DEFAULTS = {
    "bureau_active_count": 0,
    "bureau_overdue_flag": 0,
    "n_installments": 0,
    "late_installment_rate": 0.0,
    "max_days_late": 0,
    "avg_days_late": 0.0,
}

# Plain-language feature names.
FEATURE_LABELS = {
    "credit_income_ratio": "Credit-to-income ratio",
    "annuity_income_ratio": "Annuity-to-income ratio",
    "bureau_active_count": "Active credit lines (bureau)",
    "bureau_overdue_flag": "Existing overdue on other credits (bureau)",
    "ext_source_1": "External credit score 1",
    "ext_source_2": "External credit score 2",
    "ext_source_3": "External credit score 3",
    "age_years": "Applicant age (years)",
    "employed_years": "Employment tenure (years)",
    "prior_late_rate": "Late-payment rate on earlier loans",
    "prior_n_installments": "Installments observed on earlier loans",
}

# Features of the hazard model, of its structure, and its segments.
CORE_FEATURES = (
    "credit_income_ratio",
    "annuity_income_ratio",
    "bureau_active_count",
    "bureau_overdue_flag",
    "ext_source_1",
    "ext_source_2",
    "ext_source_3",
    "age_years",
    "employed_years",
    "prior_late_rate",
    "prior_n_installments",
)
STRUCTURAL_FEATURES = ("months_since_origination",)
SEGMENT_COLUMNS = ("loan_type_segment", "sector_segment", "data_richness")

# Levers a borrower can move, the risk-reducing way, and the bound.
LEVERS = {
    "credit_income_ratio": ("down", 0.0),
    "annuity_income_ratio": ("down", 0.0),
    "bureau_active_count": ("down", 0.0),
    "bureau_overdue_flag": ("down", 0.0),
    "prior_late_rate": ("down", 0.0),
    "ext_source_1": ("up", 1.0),
    "ext_source_2": ("up", 1.0),
    "ext_source_3": ("up", 1.0),
}
INTEGER_LEVERS = ("bureau_active_count", "bureau_overdue_flag")
MAX_LEVERS = 3
GRID_STEPS = 10

# Risk direction of each scorecard feature.
WOE_TRENDS = {
    "credit_income_ratio": "ascending",
    "annuity_income_ratio": "ascending",
    "late_installment_rate": "ascending",
    "max_days_late": "ascending",
    "avg_days_late": "ascending",
    "bureau_active_count": "ascending",
    "bureau_overdue_flag": "ascending",
    "ext_source_1": "descending",
    "ext_source_2": "descending",
    "ext_source_3": "descending",
    "age_years": "descending",
    "employed_years": "descending",
}
WOE_MIN_BIN = {"bureau_overdue_flag": 0.005}

# Text rules.
DISTRESS_PATTERN = "delay|disput|stoppage|closure"
TEXT_COMPONENTS = 12

# Event types and their default feature changes.
EVENT_TYPES = ("gst_filing", "bank_transaction", "repayment")
RATIO_INFLATION = 1.4
LATE_STEP = 0.2
LATE_RELIEF = 0.8

# What the gate before serving asks of the feature table.
GATE_COLUMNS = ("loan_type_segment", "data_richness")
GATE_NULL_RATES = {"credit_income_ratio": 0.05}
GATE_RANGES = {"late_installment_rate": (0.0, 1.0), "age_years": (18.0, 100.0)}

# Officer decisions.
DECISIONS = ("accept", "modify", "override")
REASON_REQUIRED = ("modify", "override")

# Labels never served online.
SERVING_EXCLUDED = ("target",)

# Overdue ladder and early-warning states.
SMA_LADDER = ((30, "SMA-0"), (60, "SMA-1"), (90, "SMA-2"))
NPA = "NPA"
EWS_STATES = ("Performing", "WatchList", "HighAlert", "Critical", "NPA_Stage3")
WATCH_PD, ALERT_PD, CRITICAL_PD = 0.20, 0.50, 0.75

# Trigger, indicator and action wording.
REGULATORY_MAP = (
    (
        "GST turnover drop >X% month-over-month",
        "'Default in payment to statutory bodies' family of EWS indicators",
        "Feeds existing bank EWS/RFA workflow",
    ),
    (
        "Sudden spike in cash withdrawal relative to account activity",
        "'Heavy cash withdrawal in loan accounts'",
        "Existing RFA escalation path",
    ),
    (
        "Large RTGS transfer to an unrelated, newly-added counterparty",
        "'High-value RTGS to unrelated parties'",
        "Existing RFA escalation path",
    ),
    (
        "Repeated ad-hoc credit-limit requests",
        "'Frequent ad-hoc sanction requests'",
        "Existing RFA escalation path",
    ),
    (
        "PD crosses Stage-1 -> Stage-2 threshold",
        "Ind AS 109 'significant increase in credit risk'",
        "Triggers lifetime-ECL provisioning review",
    ),
)

# Wording shown with every score.
DISCLOSURE = (
    "AI-assisted assessment. This risk score was generated by a machine-learning "
    "model and translated from verified model attributions. A human officer holds "
    "final decision authority and may override it."
)
