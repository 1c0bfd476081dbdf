"""Limits, word lists and wordings that results depend on."""

NOT_SPECIFIED = "Not specified"

# Page intake
MIN_PAGE_CHARS = 50
URL_KEY_CHARS = 80

# Voice
RELIABLE_DOCS = 2
MIN_TRANSITIONS, MAX_TRANSITIONS = 3, 8
FILLER_WORDS = [
    "leverage",
    "delve",
    "tapestry",
    "testament to",
    "I am passionate about",
    "utilize",
    "synergize",
    "impactful",
    "innovative",
    "dynamic",
    "results-driven",
]
DEFAULT_SECTIONS = ["Summary", "Experience", "Education", "Skills"]
DEFAULT_VOICE = {
    "tone": "Professional and confident",
    "sentence_structure": "Clear, action-oriented sentences",
    "vocabulary_level": "Standard professional vocabulary",
    "formatting_quirks": "Standard bullet points",
}
DEFAULT_TRANSITIONS = ["Additionally", "Furthermore"]
DEFAULT_RESUME_STRUCTURE = {
    "bullet_style": "STAR method, action-verb first",
    "metric_usage": "Used to quantify achievements",
    "density": "Balanced and scannable",
}

# Postings
WORK_ARRANGEMENTS = ["Remote", "Hybrid", "On-site", NOT_SPECIFIED]

# Strategy
MIN_ROLES, MAX_ROLES = 2, 4
MIN_BULLETS, MAX_BULLETS = 2, 4
HOOKS = 3
MIN_HOOKS = 2  # the record schema accepts two or three, the rule asks for three
NO_REFRAME = "no credible reframe"

# Letters and resumes
MIN_LETTER_WORDS, MAX_LETTER_WORDS = 280, 350
MIN_BODY_PARAGRAPHS, MAX_BODY_PARAGRAPHS = 4, 5
BANNED_OPENINGS = [
    "I am writing to apply for",
    "I am excited about",
    "I would like to express my interest",
]
BANNED_CLOSINGS = [
    "I would be thrilled",
    "I hope to hear from you soon",
    "Thank you for your consideration",
    "I look forward to the opportunity to",
]
GENERIC_GREETING = "Dear Hiring Manager,"
DEFAULT_SIGN_OFF = "Best regards,"
SKILL_GROUP_LIMIT = 8
ONE_PAGE_YEARS = 7

# Words that say what kind of company it is, not which one
LEGAL_FORMS = ["ag", "co", "corp", "corporation", "gmbh", "inc", "limited", "llc", "ltd", "plc"]

# Completion
MAX_ATTEMPTS = 3
FIRST_WAIT_SECONDS = 1.0
CHEAP_TIER, STRONG_TIER = "fast", "strong"
