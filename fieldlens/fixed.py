"""The rule tables, word lists, patterns and texts results must agree with."""

from __future__ import annotations

# ---- schema comparison -------------------------------------------------------------

CHANGE_TYPES = (
    "ADDED", "REMOVED", "TYPE_CHANGED", "CARDINALITY_CHANGED", "RESTRICTION_CHANGED",
    "FIELD_CLASS_CHANGED", "ENUMERATION_CHANGED", "RULEBOOK_CHANGED", "USAGE_RULES_CHANGED",
    "FIXED_VALUE_CHANGED", "DEFAULT_VALUE_CHANGED",
)
SEVERITIES = ("HIGH", "MEDIUM", "LOW")

# field class before, after, severity, direction, impact
CLASS_TRANSITIONS = (
    ("YELLOW", "WHITE", "HIGH", "Downgraded", "Field classification DOWNGRADED from Yellow (mandatory for scheme) to White (optional). Business impact: field may no longer be required."),
    ("WHITE", "YELLOW", "HIGH", "Upgraded", "Field classification UPGRADED from White (optional) to Yellow (mandatory for scheme). Business impact: field is now required."),
    ("NA", "YELLOW", "MEDIUM", "New Yellow", "Field now classified as Yellow (mandatory for scheme)."),
    ("NA", "WHITE", "LOW", "New White", "Field now classified as White (optional)."),
    ("YELLOW", "NA", "MEDIUM", "Removed", "Field classification removed (was Yellow). May indicate field is no longer part of scheme specification."),
    ("WHITE", "NA", "LOW", "Removed", "Field classification removed (was White). May indicate field is no longer part of scheme specification."),
)
CLASS_OTHER = ("MEDIUM", "Changed", "Field classification changed.")

# ---- guides ------------------------------------------------------------------------

RULE_COLUMNS = ("mult", "length", "usage_rule", "rulebook", "format_rule", "code_restrictions")
RULE_LABELS = {
    "mult": "Multiplicity", "length": "Length", "usage_rule": "Usage Rules", "rulebook": "Rulebook",
    "format_rule": "Format Rules", "code_restrictions": "Code Restrictions", "status": "Status",
}
COLOUR_STATUS = {"yellow": "Yellow/Core", "red": "Red/NotPermitted", "white": "White/Optional"}

# category, meaning, action; in report order
GAPS = (
    ("ALIGNED", "Schema and guide agree on status, rules, and multiplicity", "No action needed"),
    ("STATUS_DIFF", "Schema and guide disagree on field status", "Investigate: the schema is the structural ground truth"),
    ("RULES_DIFF", "Usage rule, format rule or length differs", "Review both sources and follow the stricter rule"),
    ("EXCLUDED", "Field is in the guide but the schema excludes it", "Do not send"),
    ("XSD_ONLY", "Field is in the schema but not in the guide", "Verify whether it must be implemented"),
    ("MULT_DIFF", "Multiplicity differs", "Check occurrence handling"),
    ("BOTH_DIFF", "Both status and rules differ", "High priority"),
)

# mandatory count above, text
PRIORITIES = ((50, "High priority"), (10, "Medium priority"))
PRIORITY_REST = "Lower priority"

# ---- message validation ------------------------------------------------------------

# parent, exclusive children, rule text, at most, preferred in synthesis
EITHER_OR = (
    ("RmtInf", ("Ustrd", "Strd"), "Either 'Unstructured' or 'Structured' may be present, not both", 1, "Ustrd"),
    ("FinInstnId", ("BICFI", "LEI"), "Either 'BICFI' or 'LEI' is allowed for identification", 1, "BICFI"),
    ("OrgId", ("AnyBIC", "LEI", "Othr"), "Either 'AnyBIC', 'LEI' or 'Other' is allowed", 1, "Othr"),
    ("PrvtId", ("DtAndPlcOfBirth", "Othr"), "Either 'Date and Place of Birth' or 'Other' is allowed", 1, "Othr"),
)

# exclusive children when messages are made up: the rules above and the long name of the first
PICK_ONE = (*EITHER_OR[:1], ("RemittanceInformation", *EITHER_OR[0][1:]), *EITHER_OR[1:])

FORMATS = {
    "IBAN": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}$",
    "BIC": r"^[A-Z]{6}[A-Z2-9][A-NP-Z0-9]([A-Z0-9]{3})?$",
    "LEI": r"^[A-Z0-9]{18}[0-9]{2}$",
    "CountryCode": r"^[A-Z]{2}$",
    "CurrencyCode": r"^[A-Z]{3}$",
    "ISODate": r"^\d{4}-\d{2}-\d{2}$",
    "ISODateTime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "UUID": r"^[a-f0-9]{8}-[a-f0-9]{4}-4[a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}$",
}
FORMAT_HINTS = {
    "IBAN": "IBAN should be 2 letters + 2 digits + up to 30 alphanumeric (e.g., DE89370400440532013000)",
    "BIC": "BIC should be 8 or 11 characters (e.g., DEUTDEFF or DEUTDEFFXXX)",
    "LEI": "LEI should be 20 characters: 18 alphanumeric + 2 digits",
    "CountryCode": "Use 2-letter ISO 3166 country code (e.g., DE, FR, GB)",
    "CurrencyCode": "Use 3-letter ISO 4217 currency code (e.g., EUR, USD, GBP)",
    "ISODate": "Use format YYYY-MM-DD (e.g., 2024-01-15)",
    "ISODateTime": "Use format YYYY-MM-DDThh:mm:ss (e.g., 2024-01-15T14:30:00)",
    "UUID": "UETR must be UUID v4 format (e.g., 123e4567-e89b-42d3-a456-426614174000)",
}
TAG_FORMATS = {
    "IBAN": "IBAN", "BICFI": "BIC", "BIC": "BIC", "AnyBIC": "BIC", "LEI": "LEI",
    "Ctry": "CountryCode", "CtryOfBirth": "CountryCode", "CtryOfRes": "CountryCode",
    "Ccy": "CurrencyCode", "CreDtTm": "ISODateTime", "AccptncDtTm": "ISODateTime",
    "IntrBkSttlmDt": "ISODate", "ReqdExctnDt": "ISODate", "UETR": "UUID",
}
AMOUNT_TAGS = ("Amt", "IntrBkSttlmAmt", "TtlIntrBkSttlmAmt", "InstdAmt", "EqvtAmt")
SINGLE_TAGS = ("MsgId", "CreDtTm", "NbOfTxs", "TtlIntrBkSttlmAmt", "IntrBkSttlmDt")

# children that identify a repeated sibling, first match wins
IDENTIFIERS = ("Id", "MsgId", "EndToEndId", "TxId", "InstrId", "IBAN", "BICFI")

# ---- catalogs ----------------------------------------------------------------------

ENTITIES = {
    "Dbtr": "Debtor (Payer/Originator)",
    "Cdtr": "Creditor (Payee/Beneficiary)",
    "DbtrAgt": "Debtor Agent (Originating Bank)",
    "CdtrAgt": "Creditor Agent (Beneficiary Bank)",
    "IntrmyAgt": "Intermediary Agent",
    "GrpHdr": "Group Header (Message-level info)",
    "MsgId": "Message Identifier",
    "CreDtTm": "Creation Date Time",
    "NbOfTxs": "Number of Transactions",
    "IntrBkSttlmAmt": "Interbank Settlement Amount",
    "IntrBkSttlmDt": "Interbank Settlement Date",
    "SttlmInf": "Settlement Information",
    "PmtTpInf": "Payment Type Information",
    "CdtTrfTxInf": "Credit Transfer Transaction",
    "PmtId": "Payment Identification",
    "InstrId": "Instruction Identification",
    "EndToEndId": "End to End Identification",
    "IBAN": "International Bank Account Number",
    "BIC": "Bank Identifier Code (SWIFT)",
    "Nm": "Name",
    "PstlAdr": "Postal Address",
    "Ctry": "Country Code",
    "RmtInf": "Remittance Information",
    "Ustrd": "Unstructured (Free text)",
    "Strd": "Structured (Formatted data)",
}
ENTITY_PATTERNS = (
    ("Agt", None, "Agent (Financial Institution)"),
    ("Acct", None, "Account Information"),
    ("Amt", None, "Amount"),
    ("Dt", "Tm", "Date"),
    ("Id", None, "Identifier"),
)

MAPPING_SAMPLES = {
    "MsgId": "MSG20240115123456", "CreDtTm": "2024-01-15T10:30:00", "NbOfTxs": "1",
    "TtlIntrBkSttlmAmt": "1000.00", "IntrBkSttlmDt": "2024-01-15", "EndToEndId": "E2E20240115001",
    "TxId": "TX20240115001", "InstrId": "INSTR20240115001",
    "UETR": "eb6305c9-1f7f-49de-aed0-16487c27b42d", "IntrBkSttlmAmt": "1000.00",
    "InstdAmt": "1000.00", "ChrgBr": "SLEV", "Nm": "John Smith",
    "IBAN": "DE89370400440532013000", "BICFI": "DEUTDEFF", "BIC": "DEUTDEFF", "Ctry": "DE",
    "Ccy": "EUR", "StrtNm": "Main Street", "BldgNb": "123", "PstCd": "10115",
    "TwnNm": "Berlin", "Ustrd": "Payment for Invoice 12345", "Cd": "SALA", "Prtry": "PROPRIETARY",
}
GUIDE_SAMPLES = {
    "MsgId": "MSG20240115-001", "InstrId": "INSTR-20240115-001", "EndToEndId": "E2E-20240115-001",
    "TxId": "TX-20240115-001", "UETR": "eb6305c9-1f7f-49de-aed0-16487c27b42d",
    "CreDtTm": "2024-01-15T10:30:00", "IntrBkSttlmDt": "2024-01-15", "NbOfTxs": "1",
    "TtlIntrBkSttlmAmt": "1000.00", "IntrBkSttlmAmt": "1000.00", "InstdAmt": "1000.00",
    "ChrgBr": "SLEV", "Nm": "Acme Corporation", "IBAN": "DE89370400440532013000",
    "BICFI": "DEUTDEFFXXX", "BIC": "DEUTDEFFXXX", "Ctry": "DE", "Ccy": "EUR",
    "StrtNm": "Hauptstrasse", "BldgNb": "42", "PstCd": "10115", "TwnNm": "Berlin",
    "Ustrd": "Payment for Invoice INV-2024-001", "Cd": "SALA", "Prtry": "PROPRIETARY001",
    "RmtInf": "Invoice INV-2024-001",
}
SOURCE_SYSTEMS = {
    "MsgId": "Internal/Generated", "CreDtTm": "Internal/Generated", "NbOfTxs": "Internal/Generated",
    "InstrId": "Internal/Generated", "UETR": "Internal/Generated", "TxId": "Internal/Generated",
    "EndToEndId": "Originating System", "IntrBkSttlmAmt": "Originating System",
    "IntrBkSttlmDt": "Originating System", "InstdAmt": "Originating System",
    "Nm": "CRM / Customer DB", "IBAN": "Account System", "BICFI": "BIC Directory",
    "BIC": "BIC Directory", "Ctry": "CRM / Customer DB", "Ustrd": "Originating System",
    "RmtInf": "Originating System",
}
GUIDE_DEFAULTS = {"ChrgBr": "SLEV", "Ccy": "EUR", "SvcLvl": "SEPA", "LclInstrm": "INST", "CtgyPurp": ""}

# tag -> default of a migrated mandatory field; {stamp}, {now} and {today} come from the clock
MIGRATION_DEFAULTS = {
    "MsgId": "MSG{stamp}", "CreDtTm": "{now}", "NbOfTxs": "1", "IntrBkSttlmDt": "{today}",
    "ChrgBr": "SLEV", "Ccy": "EUR", "Ctry": "DE",
}

FACET_TAGS = (
    "minLength", "maxLength", "length", "pattern", "enumeration", "minInclusive", "maxInclusive",
    "minExclusive", "maxExclusive", "fractionDigits", "totalDigits", "whiteSpace",
)

# ---- change logs -------------------------------------------------------------------

# pattern, label; first match wins, case-insensitive
DATASETS = (
    (r"DS-02|Inter-PSP Payment|pacs\.008|Credit Transfer V08", "DS-02  pacs.008  (Credit Transfer)"),
    (r"Negative Confirmation|DS-03.*Neg|pacs\.002", "DS-03  pacs.002  (Negative Confirmation)"),
    (r"Positive Confirmation|DS-03.*Pos", "DS-03  pacs.002  (Positive Confirmation)"),
    (r"DS-05|Recall.*Dataset|camt\.056|Payment Cancellation", "DS-05  camt.056  (Recall Request)"),
    (r"DS-06|Response.*Recall.*Neg|camt\.029|Resolution.*Inv", "DS-06  camt.029  (Negative Recall Response)"),
    (r"DS-06|Response.*Recall.*Pos|pacs\.004|Payment Return", "DS-06  pacs.004  (Positive Recall Response)"),
    (r"DS-07|Status Investigation|pacs\.028", "DS-07  pacs.028  (Status Investigation)"),
    (r"DS-08|Request for Recall.*Originator", "DS-08  camt.056  (Recall by Originator)"),
    (r"DS-09|Negative Response.*Originator", "DS-09  camt.029  (Negative Response - Originator Recall)"),
    (r"DS-10|Positive Response.*Originator", "DS-10  pacs.004  (Positive Response - Originator Recall)"),
    (r"DS-11|Status Update.*Recall", "DS-11  pacs.028  (Status Update - Originator Recall)"),
)
GENERAL_DATASET = "General / Cross-Message"
LOG_TYPES = ("CHAN", "CLAR", "TYPO")
LOG_STATUS = ("ACC", "REJ", "PEN", "PEND", "")
LOG_HEADERS = ("n", "no", "#", "section /", "message", "element", "")
LOG_PREFIX = {
    "CHAN": "Content change — may require implementation update.",
    "CLAR": "Clarification only — no functional change expected; review for alignment.",
    "TYPO": "Typo/layout fix — no functional impact expected.",
}
# pattern on the lower-cased description, note
LOG_NOTES = (
    (r"mandatory|1\.\.1|made yellow", "Field is now MANDATORY — must always be populated."),
    (r"\bmade white\b|now optional", "Field is now OPTIONAL — not required."),
    (r"not permitted|forbidden|removed from ig|made red", "Field BLOCKED — do not include."),
    (r"new (section|attribute|field|element|sub)", "New element added — implement handling."),
    (r"remov(ed?|al)\b", "Element removed — stop sending for this scheme."),
    (r"length|max \d+|\d+\s*\.\.\s*\d+", "Length constraint changed — revalidate field values."),
    (r"usage rule", "Usage rule updated — re-read constraint."),
    (r"format rule", "Format rule changed — check regex/pattern validation."),
    (r"amount|currency", "Monetary field impacted — review amount/currency logic."),
    (r"timestamp|datetime", "Timestamp rule changed — check date/time formatting."),
    (r"address|postal", "Address handling impacted — review structured vs unstructured logic."),
    (r"reason code|r-message|rjct|rtn", "Reason code/R-message affected — update code validation lists."),
    (r"\buetr\b", "UETR handling changed — check end-to-end transaction ID logic."),
    (r"iban|account.*id|bic", "Account/BIC handling affected — verify validation logic."),
    (r"charge|fee", "Charges/fees impacted — review charge bearer logic."),
    (r"purpose", "Purpose code affected — check allowed purpose values."),
    (r"remittance", "Remittance information changed — update remittance handling."),
)

# ---- guide extraction --------------------------------------------------------------

# labels of a requirement block, longest first
REQUIREMENT_LABELS = (
    r"SEPA Usage Rule\(s\)", r"SEPA Format Rule\(s\)", "SEPA Code Restrictions", "SEPA FractDigits",
    "SEPA Inclusive", "SEPA Rulebook", "SEPA Length", r"NPC Usage Rule\(s\)", r"NPC Format Rule\(s\)",
    "NPC Code Restrictions", "NPC FractDigits", "NPC Inclusive", "NPC Rulebook", "NPC Length",
    "ISO Definition", "ISO Length", "ISO Name", "XML Tag", r"Type(?=\s+[A-Z])",
)
SECTION_PATTERN = r"(?i)((?:\d+\.)+\d+)[\.\s]+Use of\s+(.+?)\s*\(([a-z]{2,8}\.\d{3}\.\d{3}\.\d{2,3})\)"
# colour, red, green, blue, tolerance
RECT_COLOURS = (
    ("yellow", 0.98, 0.99, 0.37, 0.05), ("yellow", 1.00, 0.96, 0.80, 0.04),
    ("red", 1.0, 0.0, 0.0, 0.02), ("red", 0.97, 0.57, 0.63, 0.04),
)

# ---- API specifications ------------------------------------------------------------

HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options")

# ---- files -------------------------------------------------------------------------

UPLOAD_EXTENSIONS = ("xsd", "xml", "zip", "pdf", "yaml", "yml", "json")
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_FILES = 50

# ---- samples of synthetic messages --------------------------------------------------

SAMPLE_BICS = ("DEUTDEFF", "BNPAFRPP", "BARCGB22", "CRESCHZZ")
SAMPLE_IBANS = ("DE89370400440532013000", "FR7630006000011234567890189")
SAMPLE_NAMES = ("John Smith", "Jane Doe", "Global Corp Ltd")
SAMPLE_COUNTRIES = ("DE", "FR", "GB", "NL", "ES", "IT")
