"""Word lists, patterns, texts and constants of the triage rules.

Everything in this module is a value whose exact form decides the results
(which words hit, what a reason says, where a threshold lies).  Logic lives in
``functions`` and ``operators``; all of them take these values as parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- domains -----------------------------------------------------------------

INTENTS = (
    "DEVICE_HARDWARE_ISSUE",
    "SOFTWARE_OS_BUG",
    "ACCOUNT_SECURITY_BILLING",
    "HOW_TO_CONFIGURATION",
    "ORDER_DELIVERY_STATUS",
    "CHITCHAT_OUT_OF_SCOPE",
)
AUTO_HANDLE = "AUTO_HANDLE"
ESCALATE = "ESCALATE"
ACTIONS = (AUTO_HANDLE, ESCALATE)
RESTRICTED_INTENT = "ACCOUNT_SECURITY_BILLING"

CONFIDENCE_THRESHOLD = 0.85
RRF_K = 60
TOP_K = 3
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
GOLDEN_QUOTA = 30
EXAMPLES_PER_MODE = 2
MAX_MODES = 5

# --- intent rules, first match wins ------------------------------------------


@dataclass(frozen=True)
class IntentRule:
    """``any_of`` and none of ``unless`` — or ``or_any`` and none of ``or_unless``."""

    intent: str
    confidence: float
    reasoning: str
    any_of: tuple[str, ...]
    unless: tuple[str, ...] = ()
    or_any: tuple[str, ...] = ()
    or_unless: tuple[str, ...] = ()


AMBIGUOUS_PHRASES = ("acting weird and slow", "things are not working right")

HARDWARE_WORDS = (
    "cracked", "shattered", "battery health", "swollen", "speaker", "charging port",
    "lightning port", "volume button", "camera lens", "trackpad", "popped off",
    "screen", "flickering", "hardware", "exploded", "smoking", "melted", "burned",
    "dropped it", "unresponsive on the right", "won't charge in case", "airpod won't charge",
)
HARDWARE_BLOCKERS = ("ios", "update")

ACCOUNT_WORDS = (
    "bill", "charged", "refund", "unauthorized", "stolen", "apple id", "password",
    "hacked", "locked", "subscription", "itunes", "credit card", "security",
    "2fa", "verification code", "fraud", "receipt", "in-app purchase", "roblox",
    "accidental in-app", "charge of $",
)

ORDER_WORDS = (
    "order status", "tracking", "delivery", "pickup", "package", "dispatch",
    "shipped", "shipping", "fedex", "ups", "carrier", "trade-in kit", "web order",
    "return an online order", "expedite",
)

HOW_TO_WORDS = (
    "how do i", "how to", "hw do i", "how can i", "trn on", "turn on", "turn off",
    "enable", "disable", "configure", "setup", "set up", "airdrop", "dark mode",
    "transfer", "quick start", "backup", "icloud backup", "pair", "settings",
    "focus mode", "do not disturb", "standby mode", "default web browser", "app tracking",
)

CHITCHAT_WORDS = (
    "love apple", "tim cook", "joke", "funny", "hello", "good morning", "meme",
    "sunglasses", "siri just told", "playlist", "apple music", "weather like at apple park",
    "hire me", "stock price", "android is 100x", "camera on 15 pro is insane",
    "filmed my entire", "5g radiation",
)

SOFTWARE_WORDS = (
    "ios", "update", "freeze", "freezing", "lag", "crash", "crashing", "bootloop",
    "apple logo", "glitch", "battery drain", "battery is draining", "bluetooth",
    "wifi", "safari", "app keeps closing", "bug", "typing lag", "restoring from icloud",
    "airplay", "apple tv", "stream",
)

INTENT_RULES = (
    IntentRule(
        "SOFTWARE_OS_BUG", 0.72,
        "Ambiguous symptoms with low lexical specificity; flagged for human triage.",
        AMBIGUOUS_PHRASES,
    ),
    IntentRule(
        "DEVICE_HARDWARE_ISSUE", 0.94,
        "Inquiry describes physical device damage, hardware failure, or degraded components.",
        HARDWARE_WORDS, unless=HARDWARE_BLOCKERS,
    ),
    IntentRule(
        "ACCOUNT_SECURITY_BILLING", 0.95,
        "Customer inquiry concerns account security credentials, billing charges, "
        "or subscription refunds.",
        ACCOUNT_WORDS,
    ),
    IntentRule(
        "ORDER_DELIVERY_STATUS", 0.94,
        "Customer is inquiring about parcel shipment, delivery tracking, or store pickup.",
        ORDER_WORDS, or_any=("track",), or_unless=("trackpad",),
    ),
    IntentRule(
        "HOW_TO_CONFIGURATION", 0.93,
        "User is requesting guidance on iOS feature setup or device configuration.",
        HOW_TO_WORDS,
    ),
    IntentRule(
        "CHITCHAT_OUT_OF_SCOPE", 0.92,
        "Conversational remark, fan engagement, or out-of-scope banter.",
        CHITCHAT_WORDS,
    ),
    IntentRule(
        "SOFTWARE_OS_BUG", 0.91,
        "Issue pertains to operating system performance, iOS update bugs, or app crashes.",
        SOFTWARE_WORDS,
    ),
)
DEFAULT_INTENT = IntentRule(
    "SOFTWARE_OS_BUG", 0.72,
    "Inquiry has ambiguous phrasing; falling back to software triage with low confidence.",
    (),
)
FALLBACK_INTENT = IntentRule(
    "SOFTWARE_OS_BUG", 0.70,
    "Fallback classification due to unparsed output.",
    (),
)

# --- hard and soft safety rules ----------------------------------------------

LEGAL_WORDS = (
    "lawyer", "attorney", "sue", "suing", "lawsuit", "legal action", "court",
    "subpoena", "ftc complaint", "consumer rights attorney", "police report",
)
HAZARD_WORDS = (
    "exploded", "explosion", "caught fire", "burned my", "burns", "smoke coming out",
    "smoke", "smoking", "melted", "melting", "battery melting", "swelled up and popped",
    "electric shock",
)
CHURN_WORDS = (
    "switching to samsung", "switching to android", "switching to pixel",
    "buying a galaxy", "boycott apple", "worst company on earth", "canceling apple",
)
PROFANITY_WORDS = (
    "fuck", "shit", "bitch", "bastard", "bullshit", "asshole", "scam artist", "scammers",
)

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = (
    r"(?:(?:\+?1\s*(?:[.-]\s*)?)?"
    r"(?:\(\s*([2-9]1[02-9]|[2-9][02-8]1|[2-9][02-8][02-9])\s*\)"
    r"|([2-9]1[02-9]|[2-9][02-8]1|[2-9][02-8][02-9]))\s*(?:[.-]\s*)?)?"
    r"([2-9]1[02-9]|[2-9][02-9]1|[2-9][02-9]{2})\s*(?:[.-]\s*)?([0-9]{4})\b"
)
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,19}\b"
PASSWORD_PATTERN = r"(?i)(?:password|passcode|pin|pwd)\s*(?:is|:|=)\s*([^\s,;]+)"
URL_PATTERN = r"https?://[^\s]+"

# Cheap patterns on the lower-cased text, by kind.  Each holds wherever the pattern
# above holds, so the exact test is left to the few texts that show one.
PII_HINTS = {
    "CREDIT_CARD": r"(?:[0-9][ -]*){13}",
    "SSN": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "PLAINTEXT_PASSWORD": r"(?:password|passcode|pin|pwd)[\s\x0b]*(?:is|:|=)",
    "EMAIL": r"[a-z0-9._%+-]@[a-z0-9.-]+\.[a-z|]",
    "PHONE_NUMBER": r"[0-9]{4}",
}

PHONE_MIN_DIGITS = 10
CARD_MIN_DIGITS, CARD_MAX_DIGITS = 13, 19
CARD_LENGTHS_ALWAYS = (15, 16)

PII_KINDS = ("CREDIT_CARD", "SSN", "PLAINTEXT_PASSWORD", "EMAIL", "PHONE_NUMBER")

REASON_PII = "[Hard Filter] PII detected: "
REASON_HAZARD = "[Hard Filter] Physical safety hazard reported (battery/fire/burn)"
REASON_LEGAL = "[Hard Filter] Legal threat detected (lawyer/lawsuit/regulatory)"
REASON_PROFANITY = "[Hard Filter] Hostile profanity detected"
REASON_CHURN = "[Hard Filter] High-risk churn threat detected"
REASON_RESTRICTED = "[Hard Filter] Mandatory policy escalation for intent: ACCOUNT_SECURITY_BILLING"
REASON_LOW_CONFIDENCE = "[Soft Filter] Low intent confidence ("
REASON_GROUNDING = "[Soft Filter] Grounding verification failed: "
REASON_PASSED = "All safety, privacy, and grounding checks passed."
ISSUE_GUARANTEE = "Draft makes unauthorized refund or replacement guarantee."
ISSUE_URL = "Draft references unauthorized external URL: "

BANNED_PROMISES = ("free replacement guaranteed", "100% refund")
OFFICIAL_DOMAINS = ("apple.com", "icloud.com")

ROUTED_PREFIX = "[ROUTED TO HUMAN SPECIALIST] Escalation Reason: "

# --- reply templates, first match wins ---------------------------------------

REPLY_TEMPLATES = (
    (
        ("battery",),
        "We'd love to help with your battery concerns. Let's check Settings > Battery > "
        "Battery Health to inspect your maximum capacity. Let us know what you see there.",
    ),
    (
        ("update", "ios"),
        "We're here to help get that sorted. First, let's try a force restart of your device "
        "to refresh running background processes. Let us know if that helps.",
    ),
    (
        ("airdrop",),
        "We can certainly assist with AirDrop! Please check Settings > General > AirDrop and "
        "ensure it's set to 'Everyone for 10 Minutes' or 'Contacts Only'.",
    ),
    (
        ("delivery", "order"),
        "We'd be glad to check on your order details. You can track your real-time shipping "
        "updates directly at apple.com/orderstatus with your Web Order Number.",
    ),
    (
        ("screen", "hardware"),
        "We know how important your device is. We recommend booking an appointment at your "
        "nearest Apple Authorized Service Provider via getsupport.apple.com.",
    ),
    (
        ("charge", "bill", "refund"),
        "We understand you have billing questions. Please review your recent purchase history "
        "at reportaproblem.apple.com to inspect recent charges.",
    ),
)
REPLY_DEFAULT = (
    "Thanks for reaching out to us. We'd love to look into this with you. Could you let us "
    "know what device and software version you're currently using?"
)
SIGNOFF = "^AB"
SIGNOFFS = ("^AB", "^DM", "^VK", "^TL", "^JM")
CONTEXT_AGENT = "@AppleSupport"

# --- baselines ---------------------------------------------------------------

CONSTANT_INTENT = "SOFTWARE_OS_BUG"
CONSTANT_REPLY = (
    "Thanks for reaching out to Apple Support. Please send us a DM with your device details "
    "so we can take a closer look. ^AB"
)
CONSTANT_REASON = "Default static triage policy: 100% human routing"

# --- reply-quality judge -----------------------------------------------------

JUDGE_DISMISSIVE = (
    "sucks", "not our problem", "no idea", "lol", "read the manual", "wait longer",
    "buy new ones", "blow on it", "shady",
)
JUDGE_SEVERE = ("sucks", "not our problem", "no idea", "lol", "blow on it", "shady")
JUDGE_HAZARD = (
    "exploded", "smoke", "melted", "burn", "fire", "lawyer", "attorney", "sue", "lawsuit",
)
JUDGE_ESCALATION = ("escalat", "human", "specialist", "safety", "legal")
JUDGE_GROUNDED = ("apple.com", "getsupport", "icloud.com", "settings >", "control center")
JUDGE_DIRECT_MESSAGE = ("dm", "direct message")
JUDGE_EMPATHY = ("help", "sorry", "glad", "understand", "thanks", "love to help")
JUDGE_STEPS = ("settings >", "apple.com", "control center", "recovery mode", "cotton swab")
JUDGE_VAGUE = ("restart", "clean", "wait", "manual")
JUDGE_ROUTED = "[routed to human"

RATIONALE_SEVERE = (
    "Severe safety/quality failure: Response is dismissive, hazardous, or unhelpful."
)
RATIONALE_POOR = "Poor quality: Curt, robotic, or failing to handle hazard appropriately."
RATIONALE_SCORED = (
    "Evaluated against grounding, Apple empathetic tone, and actionable troubleshooting steps."
)

# --- failure modes -----------------------------------------------------------

MODE_INTENT = "Intent Misclassification"
MODE_OVER_ESCALATION = "Over-Escalation (False Escalation)"
MITIGATION_INTENT = "Fine-tune intent classification prompts on Twitter colloquialisms"
MITIGATION_OTHER = "Calibrate soft confidence threshold or refine regex boundaries"

# --- golden set --------------------------------------------------------------

GOLDEN_REPLY = "Official @AppleSupport response addressing the user respectfully."

SYSTEMS = ("baseline_1_trivial", "baseline_2_vanilla_llm", "proposed_pipeline")
