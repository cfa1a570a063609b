"""Default parameter tables: word lists, patterns, weights and thresholds. Every operator takes its own instead."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that the scores depend on.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were will with "
    "after amid into over says said new latest update updates report reports reported according about around across "
    "india indian ltd limited group company companies corp corporation plc inc"
).split()

POSITIVE = (
    "gain gains growth record strong improve improved improvement win wins won award awarded launch launched commission commissioned "
    "expand expansion profit profitable approval approved upgrade upgraded partnership tie-up investment invest innovation leader leadership "
    "self-reliance sustainable renewable milestone positive boost rises rise surge surges secure secured acquire acquisition"
).split()

NEGATIVE = (
    "loss losses decline falls fall drop drops debt default probe investigation fraud fine penalty lawsuit court regulator recall accident "
    "fire death deaths injury injuries strike layoff layoffs resign resignation crisis risk warning downgrade negative miss misses delay delayed "
    "breach complaint controversy dispute slump weak violation allegation alleged unconfirmed"
).split()

#: Term and weight; company and family names belong into a deployment's own table.
MATERIALITY = {
    "acquisition": 28, "acquire": 25, "merger": 28, "sale": 18, "stake": 18, "investment": 20, "capex": 20, "crore": 10, "billion": 16, "financing": 22, "loan": 18,
    "results": 18, "revenue": 14, "profit": 18, "loss": 18, "ebitda": 16, "rating": 12, "downgrade": 22, "upgrade": 14, "default": 35,
    "chairman": 22, "ceo": 20, "cfo": 20, "md": 14, "director": 12, "resign": 30, "appointed": 20, "appointment": 20, "leadership": 18,
    "court": 24, "regulator": 25, "sebi": 28, "cci": 28, "rbi": 28, "trai": 26, "nclt": 28, "nclat": 28, "supreme court": 32, "high court": 28, "tax": 16,
    "accident": 32, "fire": 30, "fatal": 38, "death": 38, "injury": 30, "strike": 24, "protest": 22, "fraud": 38, "probe": 30, "investigation": 28, "recall": 30,
    "launch": 10, "commissioned": 18, "expansion": 18, "plant": 14, "capacity": 14, "5g": 14, "spectrum": 18, "subscriber": 12, "partnership": 10, "promoter": 24,
}

CERTAINTY_UP = ["announced", "disclosed", "filing", "official", "confirmed", "approved", "commissioned", "appointed", "completed", "signed", "exchange filing", "press release"]
CERTAINTY_DOWN = ["reportedly", "sources said", "people familiar", "may", "might", "could", "exploring", "considering", "talks", "likely", "rumour", "rumor", "unconfirmed", "appears"]

CANONICAL = {
    "commissions": "commission", "commissioned": "commission", "opens": "commission", "opened": "commission", "open": "commission",
    "facility": "plant", "facilities": "plant", "rollout": "expansion", "expands": "expansion", "expanded": "expansion",
    "accelerates": "acceleration", "accelerated": "acceleration", "targets": "target", "plans": "plan", "planning": "plan",
    "precipitated": "ppt", "aluminium": "aluminum", "cities": "city",
}

# Headlines of routine market talk, of mere price moves, of corporate events and of questions.
_MOVES = "rise|rises|rose|fall|falls|fell|jump|jumps|surge|surges|slip|slips|gain|gains|drop|drops"
ROUTINE_MARKET = [
    r"\b(stocks?|shares?)\s+to\s+(buy|sell|watch)\b",
    r"\b(buy|sell|hold)\s+(call|rating|recommendation)\b",
    r"\btarget\s+price\b",
    r"\bprice\s+target\b",
    r"\bshare\s+price\s+(target|forecast|prediction|today|outlook)\b",
    r"\b(multibagger|intraday|technical\s+analysis|trading\s+strategy)\b",
    r"\b(top|best)\s+\d*\s*(stocks?|shares?)\b",
    r"\bmarket\s+(movers?|roundup|wrap|live)\b",
    r"\b(brokerage|analyst)\s+(call|pick|recommendation)\b",
    r"\bshould\s+(you|i|investors?)\s+(buy|sell|hold)\b",
]
PRICE_MOVE = [rf"\bshares?\s+({_MOVES})\b", rf"\bstock\s+({_MOVES})\b"]
CORPORATE_EVENT = [
    r"\b(announces?|announced|discloses?|disclosed|filing|results?|revenue|profit|loss|ebitda)\b",
    r"\b(acquisition|acquires?|merger|stake|divest|sale|funding|financing|investment|capex)\b",
    r"\b(appoints?|appointed|resigns?|resigned|chairman|chief executive|ceo|cfo|managing director|board)\b",
    r"\b(sebi|rbi|trai|cci|nclt|nclat|court|regulator|penalty|fine|probe|investigation|order)\b",
    r"\b(plant|capacity|commissioned|launches?|launched|partnership|contract|spectrum|subscriber)\b",
    r"\b(accident|fatal|fire|strike|protest|recall|breach|fraud|allegation)\b",
    r"\b(upgrade|downgrade|credit rating|sustainability|renewable|emission)\b",
]
PUBLIC_QUESTION = [
    r"^(why|what|when|where|who|how|is|are|do|does|did|can|could|should|would|has|have)\b",
    r"\b(anyone|thoughts|opinion|review|experience|help|advice)\b",
    r"\?$",
]
# Categories by pattern, the first that fits counts, and what needs attention at once.
CATEGORIES = [
    ("Leadership", "chairman|ceo|cfo|md |director|appointed|resign"),
    ("Regulatory", "sebi|rbi|trai|cci|regulator|court|nclt|nclat|tax"),
    ("Financial", "results|revenue|profit|loss|ebitda|loan|financing|debt|rating"),
    ("M&A", "acquisition|acquire|merger|stake|buyout|sale"),
    ("Operations", "plant|capacity|commission|factory|mine|smelter|network|5g"),
    ("Brand", "campaign|brand|launch|customer|consumer|retail"),
    ("Reputation", "controversy|fraud|probe|accident|fire|strike|protest|narrative"),
    ("Sustainability", "esg|renewable|sustainable|green|emission|certification"),
    ("Technology", "ai |artificial intelligence|digital|technology|virtual"),
]
IMMEDIATE = "court|regulator|resign|accident|fatal|fraud|probe|fire|strike"

# Why a headline matters, by pattern; {} is the leading entity. Then for momentum, materiality and the rest.
WHY = [
    ("court|sebi|rbi|trai|cci|regulator|nclt|tax", "This could affect {}'s regulatory, legal or financial position and merits verified senior-level awareness."),
    ("acquisition|merger|stake|financing|loan|investment", "This may alter {}'s capital allocation, ownership or strategic growth trajectory."),
    ("ceo|cfo|chairman|director|resign|appointed", "Senior-leadership developments can change governance, accountability and external narrative around {}."),
    ("accident|fire|fraud|probe|strike|protest", "The development may create operational or reputation exposure; facts and response posture should be reviewed quickly."),
]
WHY_MOMENTUM = "Coverage is accelerating across independent sources and may become more consequential even if the underlying facts remain unchanged."
WHY_MATERIAL = "The subject has sufficient strategic, financial or reputation consequence to change today's picture of {}."
WHY_OTHERWISE = "Relevant to the Group record, but it does not yet materially change today's operating or reputation picture."

# The summary of an event; {} is the leading entity, then the number of domains and their plural.
SUMMARY_OFFICIAL = "An official source has published this development concerning {}."
SUMMARY_COVERAGE = ("Published coverage across ", " distinct source domain", " identifies this development concerning {}.")
SUMMARY_END = (
    " {} has grouped the available items as one event and retained every source link for verification. Live discovery may expose only headlines or short extracts, "
    "so details that are not consistent across the evidence remain unconfirmed rather than being completed by the system."
)
# What to do about a narrative that drifts far, or less far.
CLARIFY = "Clarify the verified institutional frame before the shorthand hardens."
MONITOR = "Monitor the framing and prepare a fact-based clarification if divergence accelerates."

# Classes of sources by their registry name, by tier, and the groups that reports show.
SOURCE_CLASS = {
    "official": "official", "official-filing": "official", "exchange": "exchange", "regulator": "regulator", "court": "court", "ratings": "rating", "major-media": "major_media", "specialist-media": "specialist_media",
    "regional": "regional", "international": "international", "wire": "major_media", "discovery-index": "discovery", "public-conversation": "signal", "closed-social-optional": "signal",
}
TIER_CLASS = {0: "official", 1: "major-media", 2: "specialist-media"}
COVERAGE_GROUP = {
    "official": "Official company / IR", "official-filing": "Official company / IR", "exchange": "Exchanges & regulators", "regulator": "Exchanges & regulators", "major-media": "Major journalism",
    "specialist-media": "Specialist & regional media", "regional": "Specialist & regional media", "discovery-index": "Open discovery",
}


#: Titles of links that lead to no article.
NOISE_TITLES = (
    "read more", "view all", "learn more", "press releases", "media", "news", "investors", "download", "click here", "home", "contact us", "share",
    "menu", "search", "previous", "next", "back", "close", "subscribe",
)


@dataclass(frozen=True)
class Params:
    stop_words: list[str] = field(default_factory=lambda: list(STOP_WORDS))
    canonical: dict[str, str] = field(default_factory=lambda: dict(CANONICAL))
    positive: list[str] = field(default_factory=lambda: list(POSITIVE))
    negative: list[str] = field(default_factory=lambda: list(NEGATIVE))
    materiality: dict[str, int] = field(default_factory=lambda: dict(MATERIALITY))
    certainty_up: list[str] = field(default_factory=lambda: list(CERTAINTY_UP))
    certainty_down: list[str] = field(default_factory=lambda: list(CERTAINTY_DOWN))
    context_phrase: str = ""
    #: How texts call the service and, where no entity leads, the subject.
    service: str = "This service"
    subject: str = "the Group"
    categories: list[tuple[str, str]] = field(default_factory=lambda: list(CATEGORIES))
    immediate: str = IMMEDIATE
    routine_market: list[str] = field(default_factory=lambda: list(ROUTINE_MARKET))
    price_move: list[str] = field(default_factory=lambda: list(PRICE_MOVE))
    corporate_event: list[str] = field(default_factory=lambda: list(CORPORATE_EVENT))
    public_question: list[str] = field(default_factory=lambda: list(PUBLIC_QUESTION))
    #: Fallback tiers by pattern where no registry row matches a domain.
    domain_tiers: list[tuple[str, int]] = field(default_factory=lambda: [(r"^(nseindia|bseindia|sebi|rbi|trai|cci|sec)\.", 0), ("reuters|bloomberg|ft\\.com|wsj", 1)])


DEFAULT = Params()
