"""Which (predicate, object) pairs hold one value at a time, and what a statement says about time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of single-valued predicates (anywhere in the name, the whole name, one token),
# tokens of additive predicates, and the patterns of quantified objects and of past statements.
SINGLE_CUES = (
    "live", "reside", "home", "based", "located", "current_", "work_at", "works_at", "employ", "employer", "job_title", "occupation", "role_at", "age",
    "marital", "married", "spouse", "status", "blocked", "runs_on", "can_handle", "capacity", "deployed_", "version", "recommended_action", "quota",
    "threshold", "timeout", "max_", "min_", "count_of",
)
SINGLE_EXACT = ("uses", "recommended", "recommendation")
SINGLE_TOKENS = ("rate", "limit")
ADDITIVE_TOKENS = (
    "visited", "visit", "did", "met", "meets", "likes", "liked", "like", "owns", "own", "attended", "attends", "watched", "read", "tried", "went", "ate",
    "played", "bought", "experienced", "activity", "hobby", "enjoys",
)
QUANTIFIED = r"^\s*(?:~|≈|<=|>=|<|>)?\s*[$€£]?\d[\d,.]*\s*(?:[a-zA-Z%/][\w\s/%.-]*)?$"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"\b(\d{{4}}-\d{{2}}-\d{{2}}|{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\.?\s+\d{{4}}|{MONTH}\.?\s+\d{{4}})\b"
PAST_STATE = r"\b(lived|resided|worked|used to|had been|formerly|previously|originally|back in|at the time|grew up)\b"
PAST_VERB = r"\b(was|were)\b"
PAST_YEAR = r"\b(?:in|since|during|until|till|before|after|from|by|circa|around|throughout)\s+(?:(?:early|late|mid)[- ])?(?:19|20)\d\d\b"
PAST_TIME = (
    r"\b(ago|back then|in the past|at one point|at that time|in those days|last (?:year|decade|century)|as an? (?:child|kid|teen|teenager|student|youngster)|"
    r"when (?:i|he|she|we|they|you) (?:was|were) (?:young|little|a kid|a child|younger|growing up)|in (?:my|his|her|their|our) (?:youth|childhood|twenties|teens))\b"
)
CHANGE = (
    r"\b(?:was|were|has been|have been|is now|are now|got)\s+(?:changed|updated|raised|increased|lowered|reduced|set|switched|moved|renamed|bumped|upgraded|"
    r"downgraded|adjusted|revised)\b"
)
REVERSAL = (
    r"\b(no longer|not anymore|declined|rejected|not recommended|instead|switched to|switching to|resolved|unblocked|cancelled|canceled|called off|reverted|rolled back)\b"
)
SALIENT_STOP = (
    "this", "that", "with", "from", "have", "been", "were", "will", "longer", "anymore", "after", "before", "into", "over", "under", "they", "them", "their",
    "there", "when", "what", "which", "while", "would", "could", "should", "about", "because", "very", "more", "most", "some", "such", "than", "then", "only",
    "also", "just", "like", "being", "does", "doing", "still", "instead", "switched", "switching", "resolved", "unblocked", "cancelled", "canceled", "called",
    "reverted", "rolled", "declined", "rejected", "recommended",
)


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive search; a null text matches nothing."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def _tokens(predicate: Column) -> Column:
    return F.split(F.lower(predicate), "[^a-z0-9]+")


def _any_of(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def is_single_valued(predicate: Column) -> Column:
    """Whether a subject holds one object of this predicate at a time."""
    p = F.lower(F.coalesce(predicate, F.lit("")))
    return p.isin(*SINGLE_EXACT) | p.rlike("|".join(SINGLE_CUES)) | _any_of(_tokens(p), SINGLE_TOKENS)


def supersedable(predicate: Column, obj: Column) -> Column:
    """Whether a new object closes the old one: single-valued, or quantified and not additive."""
    p = F.coalesce(predicate, F.lit(""))
    quantified = F.coalesce(obj.rlike(QUANTIFIED), F.lit(False))
    return (p != "") & (is_single_valued(p) | (quantified & ~_any_of(_tokens(p), ADDITIVE_TOKENS)))


def is_historical(statement: Column) -> Column:
    """Whether a statement tells of the past only; a phrase of change always speaks of the present."""
    past = has(statement, PAST_STATE) | (has(statement, PAST_VERB) & (has(statement, PAST_TIME) | has(statement, DATE) | has(statement, PAST_YEAR)))
    return ~has(statement, CHANGE) & past


def reversal_cue(statement: Column) -> Column:
    return has(statement, REVERSAL)


def salient_tokens(statement: Column) -> Column:
    """Distinct content words of four letters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(statement, F.lit(""))), F.lit("[a-z0-9][a-z0-9_-]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, SALIENT_STOP)))
