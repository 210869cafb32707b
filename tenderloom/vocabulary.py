"""Fixed values of the procurement domain: code lists, weights and the texts shown to users.

Every value here is fixed by the domain and must be kept exactly as it is for results to agree.
"""

from __future__ import annotations

# The 27 federation units, in their customary order.
STATES = [
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA",
    "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
]

# The closed segment vocabulary.
SEGMENTS = [
    "CIVIL_WORKS",
    "CONSTRUCTION_MATERIALS",
    "IT_SERVICES",
    "IT_HARDWARE",
    "OFFICE_SUPPLIES",
    "FOOD_AND_CATERING",
    "HEALTHCARE_SUPPLIES",
    "VEHICLES_AND_FLEET",
    "CLEANING_AND_MAINTENANCE",
    "FURNITURE",
    "EDUCATION_AND_TEACHING_MATERIALS",
    "SECURITY_SERVICES",
    "ENERGY_AND_UTILITIES",
    "PROFESSIONAL_SERVICES",
    "OTHER",
]
OTHER_SEGMENT = "OTHER"

# Economic activity division (first two digits of a CNAE) to segment.
CNAE_DIVISIONS = {
    "41": "CIVIL_WORKS",
    "42": "CIVIL_WORKS",
    "43": "CIVIL_WORKS",
    "16": "CONSTRUCTION_MATERIALS",
    "23": "CONSTRUCTION_MATERIALS",
    "25": "CONSTRUCTION_MATERIALS",
    "62": "IT_SERVICES",
    "63": "IT_SERVICES",
    "26": "IT_HARDWARE",
    "17": "OFFICE_SUPPLIES",
    "18": "OFFICE_SUPPLIES",
    "10": "FOOD_AND_CATERING",
    "56": "FOOD_AND_CATERING",
    "21": "HEALTHCARE_SUPPLIES",
    "32": "HEALTHCARE_SUPPLIES",
    "86": "HEALTHCARE_SUPPLIES",
    "29": "VEHICLES_AND_FLEET",
    "45": "VEHICLES_AND_FLEET",
    "49": "VEHICLES_AND_FLEET",
    "81": "CLEANING_AND_MAINTENANCE",
    "31": "FURNITURE",
    "85": "EDUCATION_AND_TEACHING_MATERIALS",
    "80": "SECURITY_SERVICES",
    "35": "ENERGY_AND_UTILITIES",
    "36": "ENERGY_AND_UTILITIES",
    "69": "PROFESSIONAL_SERVICES",
    "70": "PROFESSIONAL_SERVICES",
    "71": "PROFESSIONAL_SERVICES",
}

# Rule names in evaluation order, with the standard weights (they add up to 100).
KEYWORD = "KEYWORD"
SEGMENT = "SEGMENT"
ESTIMATED_VALUE = "ESTIMATED_VALUE"
STATE = "STATE"
PROPOSAL_DEADLINE = "PROPOSAL_DEADLINE"
RULES = [KEYWORD, SEGMENT, ESTIMATED_VALUE, STATE, PROPOSAL_DEADLINE]
STANDARD_WEIGHTS = {
    KEYWORD: 30,
    SEGMENT: 30,
    ESTIMATED_VALUE: 15,
    STATE: 15,
    PROPOSAL_DEADLINE: 10,
}

# What a rule, a scored pair, an ingested delivery and a mapped notice can come out as.
CONTRIBUTED, SILENT, UNAVAILABLE, PENDING = "CONTRIBUTED", "SILENT", "UNAVAILABLE", "PENDING"
MATCHED, BELOW_THRESHOLD, DISQUALIFIED = "MATCHED", "BELOW_THRESHOLD", "DISQUALIFIED"
STORED, UNCHANGED, STALE = "stored", "unchanged", "stale"
MAPPED, NOT_BIDDABLE, REJECTED = "mapped", "not_biddable", "rejected"
SCHEDULED, MANUAL = "SCHEDULED", "MANUAL"
RELEVANT, NOT_RELEVANT = "RELEVANT", "NOT_RELEVANT"

# The zone notices are published in, the message version, and report parameters.
PUBLICATION_ZONE = "America/Sao_Paulo"
MESSAGE_VERSION = 1
UNKNOWN_NOTICE = "unknown"
QUOTE_LENGTH = 500
STUCK_ATTEMPTS = 8
LATENESS_BUCKETS = [1, 2, 3, 4, 5, 7, 14]
PEAK_MULTIPLIER = 1.44
NATIONAL_MULTIPLIER = 6.0

# Sentences of the scoring rules (format strings where they carry a value).
NO_KEYWORDS = "the profile declares no keywords"
NO_KEYWORD_HIT = "none of the %d profile keywords appear in the object description"
KEYWORD_HITS = "matched %d of %d keywords: %s"
NO_CNAES = "the profile declares no CNAEs, so no segment can be derived for the company"
NOT_ENRICHED = "the procurement has not been enriched, so its segment is unknown"
SEGMENT_SERVED = "inferred segment %s is one the company serves, inferred with %s%% confidence"
SEGMENT_NOT_SERVED = "inferred segment %s is not one the company serves [%s]"
NO_RANGE = "the profile declares no value range"
SECRET_BUDGET = "the procurement carries no estimated value, the budget is secret"
VALUE_INSIDE = "estimated at %s, inside the %s to %s the profile asks for"
VALUE_OUTSIDE = "estimated at %s, outside the %s to %s the profile asks for"
NO_STATES = "the profile names no states, so geography cannot tell procurements apart"
STATE_WANTED = "published in %s, which the profile asks for"
STATE_NOT_WANTED = "published in %s, which the profile does not ask for"
DEADLINE_OPEN = "proposals close at %s, %d days away"
DEADLINE_CLOSED = "the proposal window closed at %s, before the evaluation at %s"

# Sentences of notice mapping.
FIELD_ABSENT = "required field is absent from the payload"
FIELD_NULL = "required field is present but null"
FIELD_BLANK = "required field is present but blank"
FIELD_MISDECODED = (
    "the text contains a Unicode replacement character, so it was decoded wrongly"
)
NOT_WHOLE = "required field is not a whole number: "
UNIT_MISSING = "the field is absent or null"
NOT_A_STATE = "not a Brazilian state code: "
NOT_A_NUMBER = "not a number: "
NEGATIVE_VALUE = "a monetary value must not be negative but was "
MODALITY_NOT_POSITIVE = "a modality code must be positive but was "
NOT_A_TIMESTAMP = "not a PNCP timestamp, expected a naive ISO local date time: "
NO_WINDOW = "no proposal window: PNCP published neither an opening nor a closing date"
NO_CLOSING = (
    "half a proposal window: dataAberturaProposta is present but dataEncerramentoProposta is not"
)
NO_OPENING = (
    "half a proposal window: dataEncerramentoProposta is present but dataAberturaProposta is not"
)
CLOSES_FIRST = "the proposal window closes before it opens: %s then %s"
EMPTY_BODY = "<empty body>"
