"""Words, tags and patterns of marketplace pages, stated as they must be matched."""

from __future__ import annotations

LISTING_START = "Apply this search for all"
LISTING_END = "Log in to Load More"
CARD_MARKERS = ("Trading For", "Make an Offer")
TRADE_START = "They Give"
TRADE_DONE_MARKERS = ("Sold For", "Traded For", "Closed For")
NOISE_LINES = ("join akrew pro for an ad free experience!", "pro", "marketplace", "community", "add listing", "log in", "sign up")
CARD_TAGS = (
    "pc", "softcore", "hardcore", "ladder", "non ladder", "playstation", "xbox", "nintendo switch", "reign of the warlock", "resurrected",
    "lord of destruction", "classic (base game)", "rare", "classic", "penta", "magic", "monarch", "sun", "dot", "orange",
)
TRADE_TAGS = (
    "pc", "softcore", "hardcore", "ladder", "non ladder", "xbox", "playstation", "nintendo switch", "reign of the warlock",
    "lord of destruction", "classic (base game)", "resurrected",
)
STAT_TERMS = ("better chance", "all skills", "to life", "to mana", "damage reduced", "required level")
_DATE = (
    r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{1,2},? [0-9]{4}"
)
_UNITS_ZH = "秒|分鐘|小时|小時|天|週|周|個月|月|年"
CARD_TIME = (
    r"(?i)^(?:[a-z ]*(?:[0-9]+|a|an)\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?|s|m|h|d|"
    + _UNITS_ZH + r")s?\s*(?:ago|前)|just now|剛剛|" + _DATE + ")$"
)
TRADE_TIME = (
    r"(?i)^(?:[0-9]+\s*(?:" + _UNITS_ZH + r")前|(?:[a-z ]*)?(?:[0-9]+|a|an) ?(?:second|minute|hour|day|week|month|year|s|m|h|d)s? ago"
    r"|just now|剛剛|" + _DATE + ")$"
)
#: Line ends of visible text.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: White space that is trimmed from lines.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
#: Affix lines: what is none, tokens in brackets, how a misread percent sign ends, gaps between characters, leech words.
NOT_AN_AFFIX = r"(?i)需要等級|Required Level|耐久|Durability|出售價格|Shift|Ctrl|\["
REQUIREMENT = "需要|需求|要(力量|敏捷|體力|精力|等級)"
BRACKETED_TOKEN = r"\([A-Za-z0-9]+\)"
MISREAD_PERCENT = ("96", "06", "09")
CJK_GAP = r"(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])"
NO_CJK = r"[^\x{3400}-\x{9fff}]"
AFFIX_WORDS = "無法凍結|無形|技能"
LEECH = {"ml": "竊取.*法力|法力.*竊取", "ll": "竊取.*生命|生命.*竊取"}
