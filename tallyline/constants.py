"""Thresholds, vocabularies and declared document layouts."""

# Fixed values ------------------------------------------------------------------------------------------------------

AUTO, REVIEW, WEAK, CORE_GATE = 0.86, 0.68, 0.58, 0.72
OCR_TIER_SLACK, OCR_GATE_SLACK = 0.04, 0.06

TITLES = "M/S MESSRS MS MR MRS MISS THIRU TMT SELVI SHRI SRI SMT DR ADV ADVOCATE LEARNED COUNSEL SENIOR SR PROF".split()
ROLES = ["FOR", "APPEARING", "ON BEHALF OF", "TAKES NOTICE", "ACCEPTS NOTICE", "GP", "SPP", "SGP", "AGP", "PP", "SC", "ASG", "AAG", "GOVERNMENT PLEADER", "PUBLIC PROSECUTOR", "STANDING COUNSEL", "AMICUS", "CURIAE", "PARTY IN PERSON", "PIP"]
PARTY_SEPARATORS = ["AGAINST", "VERSUS", "VS", "V/S", "AND OTHERS", "AND ANOTHER", "OTHERS", "ANOTHER", "ANR", "ORS", "AND"]
#: Openers that may be a salutation or initials, longest first.
OPENERS = "MRS SMT ADV SRI TMT MR MS DR SR".split()

#: Transliteration rules, in order.
SKELETON_RULES = [
    ("KSH", "X"), ("CHH", "S"), ("SHH", "S"), ("THH", "T"),
    ("KH", "K"), ("GH", "G"), ("CH", "S"), ("TH", "T"), ("DH", "D"), ("PH", "F"),
    ("BH", "B"), ("JH", "J"), ("SH", "S"), ("ZH", "L"), ("NG", "N"), ("NY", "N"),
    ("OO", "U"), ("EE", "I"), ("AA", "A"), ("AI", "I"), ("AU", "O"), ("OU", "O"),
    ("W", "V"), ("Y", "I"), ("Z", "S"), ("Q", "K"), ("X", "KS"),
]

OCR_DIGITS = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "|": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "T": "7", "A": "4"}
OCR_LETTERS = {"0": "O", "1": "I", "5": "S", "8": "B", "6": "G", "2": "Z", "4": "A", "7": "T"}

#: Neighbours on a keyboard, and characters that look alike.
KEY_NEIGHBOURS = {
    "A": "QSZW", "B": "VGHN", "C": "XDFV", "D": "SERFCX", "E": "WSDR", "F": "DRTGVC", "G": "FTYHBV", "H": "GYUJNB",
    "I": "UJKO", "J": "HUIKNM", "K": "JIOLM", "L": "KOP", "M": "NJK", "N": "BHJM", "O": "IKLP", "P": "OL", "Q": "WA",
    "R": "EDFT", "S": "AWEDXZ", "T": "RFGY", "U": "YHJI", "V": "CFGB", "W": "QASE", "X": "ZSDC", "Y": "THGU", "Z": "ASX",
}
LOOKALIKES = {
    "B": "8PR", "D": "OQ", "E": "F", "G": "6C", "I": "1JL", "J": "I", "L": "I1", "M": "N", "N": "MH", "O": "0DQ",
    "P": "RB", "Q": "OG", "R": "PB", "S": "5", "U": "V", "V": "UW", "W": "V", "Z": "2",
}

INITIALS_SCORES = {"both-absent": 0.50, "absent-in-list": 0.45, "absent-in-query": 0.45, "exact": 1.00, "partial": 0.80, "subset": 0.75, "flip-plausible": 0.50, "flip-other": 0.12, "transposed": 0.70, "different": 0.15}

RAW_SHARE, SKELETON_SHARE, TOKEN_SHARE, HEAD_PENALTY = 0.30, 0.40, 0.30, 0.55
INITIALS_FLOOR, INITIALS_SPAN = 0.62, 0.38

SIGNAL_WEIGHTS = {"caseNumber": 1.00, "cnr": 1.00, "enrolment": 0.95, "partyName": 0.70, "cluster": 0.65}
PARTY_MIN, PARTY_FALLBACK_MIN, PARTY_FALLBACK_MARGIN = 0.80, 0.88, 0.05
RANGE_CAP = 500
CNR_MIN_LENGTH, ENROLMENT_MIN_LENGTH = 12, 5

OCR_MIN_CHARS, THIN_CHARS, LINE_TOLERANCE, COLUMN_FALLBACK = 40, 200, 2.0, 0.55
NAME_MAX_CHARS, LOW_PAGE_HITS, LOW_FILE_SHARE = 45, 3, 0.20
PROBE_DENSITY, PROBE_CELLS = 0.20, 8
NOISE_WORDS = ["ROAD", "STREET", "NAGAR", "PIN", "DT:", "VIDE", "NOTICE", "FILED", "ORDERED", "EX-PARTE", "ISSUES FRAMED", "W/S", "TAPAL", "UNSERVED", "UNCLAIMED", "MEMO"]

HEADER_MIN = 0.75
ROSTER_HEADERS = {
    "name": ["advocate", "name", "counsel", "advocate name", "name of the advocate"],
    "enrolment": ["enrol", "enrolment", "enrollment", "bar", "bar council", "reg no", "bar enrolment", "enrolment no"],
    "role": ["role", "designation", "type"],
}
REGISTER_HEADERS = {
    "diary_no": ["diaryno", "diary no", "diary"],
    "case_type": ["casetype", "case type", "type"],
    "case_no": ["caseno", "case no", "case number", "number"],
    "year": ["year"],
    "court": ["court", "forum"],
    "cause_title": ["causetitle", "cause title", "title"],
    "counsel_for": ["counselfor", "counsel for", "appearing for", "side"],
    "party_name": ["partyname", "party name", "party", "client"],
    "mobile": ["mobile", "phone", "contact"],
    "reference": ["reference", "referred by"],
    "status": ["status"],
    "date": ["date", "filing date"],
    "fees": ["fees", "fee"],
    "remarks": ["remarks", "remark"],
    "attended_by": ["attendedby", "attended by", "advocate"],
    "next_date": ["nextdate", "next date"],
    "next_stage": ["nextstage", "next stage", "stage"],
    "status_remark": ["statusremark", "status remark"],
    "cnr": ["cnr", "cnr number", "cnr no"],
}
STALE_DAYS, STALER_DAYS = 14, 45
LEDGER_CAP = 5000

EVIDENCE_LABELS = {
    "caseNumber": "Case number", "cnr": "CNR", "causeTitle": "Cause title", "parties": "Parties", "advocate": "Advocate",
    "side": "Side", "nextStage": "Next stage", "where": "Where found",
}
EXPORT_COLUMNS = [
    "Date", "Court", "Hall", "ItemNo", "CaseNumber", "CauseTitle", "Petitioner", "Respondent", "FirmAdvocate", "PrintedName",
    "MatchRole", "Side", "SideDetail", "Tier", "Confidence", "Signals", "DiaryNo", "NextStage", "Adjourned", "RepostedTo",
    "SourceFile", "SourceMarkedOfficial", "PageNo", "WasOCR", "RegisterWarning",
]

#: Document layouts: id, kind, signatures, columns (name, role, side, label). A new forum is a new entry.
COUNSEL_ROLES = ["counsel", "party+counsel"]
PROFILES = [
    {
        "id": "tribunal.hrce",
        "kind": "causelist",
        "detect": [r"(?i)Before the Commissioner,?\s*HR\s*&\s*CE", r"(?i)HR\s*&\s*CE\s*Admn\.?\s*Department", r"(?i)Petitioner and his\s*Advocate.?s Name", r"(?i)Thiruvalargal"],
        "columns": [("serial", "index", None, None), ("caseNo", "caseNumber", None, None), ("petitioner", "party+counsel", "petitioner", None), ("respondent", "party+counsel", "respondent", None), ("underSec", "extra", None, "Under Section"), ("temple", "extra", None, "Temple"), ("subject", "extra", None, "Subject matter")],
    },
    {
        "id": "causelist.hc",
        "kind": "causelist",
        "detect": [r"(?i)HIGH COURT OF JUDICATURE", r"(?i)COURT\s*NO\.?\s*\d+", r"(?i)HON'?’?BLE"],
        "columns": [("item", "index", None, None), ("caseNo", "caseNumber", None, None), ("parties", "party", None, None), ("counsel", "counsel", None, None)],
    },
    {
        "id": "adjournment",
        "kind": "adjournment",
        "detect": [r"(?i)Adjournment\s*Notice\s*No\.?", r"(?i)stand\s+reposted\s+as\s+follows", r"(?i)are\s+hereby\s+reposted\s+as\s+follows"],
        "columns": [("serial", "index", None, None), ("caseNo", "caseNumber", None, None), ("repostedTo", "extra", None, "Reposted to")],
    },
]
#: Connectors between a party and its counsel, either way round.
PARTY_FIRST = r"(?<!(?i:break|walk|fall|see))(?:(?i:represented)\s*(?i:by|through)|(?i:rep)\.?\s*(?i:by|through)|(?i:thr)(?i:ough|u|o)|(?i:thorugh|throuh|thruogh))(?![a-z])"
COUNSEL_FIRST = r"(?i)\b(?:for|on\s+behalf\s+of|appearing\s+for)\s+(?=R-?\d|D-?\d|P-?\d|A-?\d|the\s+(?:petitioner|respondent|appellant|plaintiff|defendant|complainant)|petitioner|respondent|appellant|plaintiff|defendant|complainant)"
HONORIFIC = r"(?i)^(?:M/s|Messrs|Thiru|Tmt|Selvi|Shri|Sri|Smt|Dr|Mr|Mrs|Adv|Advocate)\.?\s*"
ITEM_START = r"^\s*(\d{1,4})\s+.*?([A-Z][A-Z.\s]{0,12}/\s*\d+\s*/\s*\d{4})"
HALL = r"(?i)COURT\s*(?:HALL|NO\.?)\s*[:\-]?\s*([0-9IVX]+)"
CORAM = r"(HON'BLE|HON’BLE|\.J\s*$|\bJ\.\s*$)"
LIST_TYPE = r"(?i)\(\d{2}/\d{2}/\d{4}\)\s*-\s*(.+LIST)"
#: Cells of an index column, and of a column of cases.
INDEX_CELL = r"^\s*\d{1,4}\s*\.?\s*$"
CASE_CELL = r"\d{1,6}\s*(?:/|of)\s*\d{4}"
DIVIDER = r"^\s*-{6,}\s*$"
REPOST_DATE = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
REPOST_TIME = r"(?i)(\d{1,2}[.:]\d{2}\s*(?:a\.?m|p\.?m)\.?)"
CASE_IN_TEXT = r"(?i)\b([A-Z][A-Z.\s]{0,10}?)\s*\.?\s*(?:NOS?\.?)?\s*(\d+(?:\s*(?:TO|AND|&|,)\s*\d+)*)\s*(?:/|\s+OF\s+)\s*(\d{4})\b"
TYPE_PREFIX = r"(?:[A-Z]{1,4}(?:\.[A-Z]){0,3}\.?|SMR|S\.M\.R\.?|R\.C\.?|I\.A\.?|O\.A\.?|M\.P\.?)"
# -------------------------------------------------------------------------------------------------------------------
