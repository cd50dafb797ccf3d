"""Fixed values.

Word lists, lookup tables, patterns and thresholds that the results depend on.
They are data: operators take them from here and hold no literals of their own.
"""

# ---- token normalisation -------------------------------------------------
STORY_ALIASES = [
    ("cease-fire", "ceasefire"), ("cease fire", "ceasefire"),
    ("rate-cut", "ratecut"), ("rate cut", "ratecut"),
    ("rate-hike", "ratehike"), ("rate hike", "ratehike"),
    ("nominee", "nominate"), ("nominees", "nominate"), ("nominated", "nominate"),
    ("nomination", "nominate"), ("candidate", "nominate"), ("candidates", "nominate"),
    ("elections", "election"), ("midterms", "midterm"), ("mid-term", "midterm"),
    ("mid term", "midterm"),
]
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "by", "with", "from", "at", "as", "will", "be",
    "is", "are", "was", "were", "has", "have", "had", "it", "its", "that", "this", "these", "those", "what", "which",
    "how", "many", "within", "next", "current", "before", "after", "into", "about", "than", "their", "they", "them",
    "his", "her", "our", "your", "who", "whom", "if", "all", "more", "less", "least", "most", "over", "under", "full",
    "period", "initial", "officially", "publicly", "announce", "announced", "agreement",
]
MONTH_WORDS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
]

# ---- source weights and lookups ------------------------------------------
SOURCE_WEIGHTS = {
    "federal_register": 3.0, "congress": 3.0, "sec_edgar": 3.0, "bls": 3.0, "fred": 2.5, "eia": 2.5,
    "reuters": 2.0, "bbc": 2.0, "politico": 2.0, "gdelt": 1.5, "polymarket": 1.5, "kalshi": 1.5,
    "reddit": 1.0, "hackernews": 1.0, "wikipedia": 0.8,
}
DEFAULT_SOURCE_WEIGHT = 1.0
BLS_SERIES = {
    "CUUR0000SA0": "CPI-U (All Urban Consumers)", "LNS14000000": "Unemployment Rate",
    "CES0000000001": "Total Nonfarm Payrolls", "JTS000000000000000JOR": "JOLTS Job Openings Rate",
}
FRED_SERIES = {
    "FEDFUNDS": "Federal Funds Rate", "T10Y2Y": "10-Year/2-Year Treasury Spread",
    "UNRATE": "Unemployment Rate", "CPIAUCSL": "CPI (All Items)", "GDP": "Gross Domestic Product",
    "DGS10": "10-Year Treasury Yield",
}
EIA_SERIES = {
    "PET.RWTC.W": "WTI Crude Oil Price (Weekly)",
    "NG.RNGWHHD.W": "Henry Hub Natural Gas Spot Price (Weekly)",
    "PET.WCESTUS1.W": "U.S. Crude Oil Stocks (Weekly)",
}

# ---- topic priors, profile A (substring hits) ------------------------------
TOPIC_TERMS = {
    "macro": [
        "federal reserve", "fed ", "fomc", "interest rate", "rate cut", "rate hike", "cpi", "inflation",
        "pce", "gdp", "recession", "treasury", "yield", "unemployment", "nonfarm payroll", "jobs report",
        "bls", "fred",
    ],
    "crypto": [
        "bitcoin", "btc", "ethereum", "eth", "solana", "xrp", "dogecoin", "stablecoin", "defi", "staking",
        "token", "spot etf", "crypto", "coinbase", "binance", "kraken",
    ],
    "finance": [
        "earnings", "revenue", "guidance", "dividend", "ipo", "merger", "acquisition", "buyback",
        "bankruptcy", "antitrust", "stock", "shares", "nasdaq", "s&p 500", "dow", "sec filing", "8-k",
        "10-q", "10-k",
    ],
    "politics": [
        "election", "primary", "white house", "congress", "senate", "house", "governor", "president",
        "prime minister", "parliament", "cabinet", "referendum", "biden", "trump", "democrat", "republican",
    ],
    "sports": [
        "nba", "nfl", "mlb", "nhl", "ncaa", "fifa", "uefa", "world cup", "super bowl", "playoff",
        "playoffs", "championship", "grand slam", "olympics", "formula 1", "ufc", "wimbledon",
    ],
    "major_news": [
        "tariff", "sanction", "ceasefire", "war", "conflict", "ai", "artificial intelligence", "nato",
        "china", "taiwan", "israel", "gaza", "ukraine", "earthquake", "hurricane", "wildfire", "pandemic",
        "vaccine", "outbreak",
    ],
}
EVENT_TYPE_PRIORS = {
    "macro_release": 1.00, "crypto": 1.00, "election": 0.98, "earnings": 0.92, "merger": 0.92,
    "sports": 0.98, "geopolitics": 0.92, "policy": 0.72, "court_case": 0.75, "tech": 0.82,
    "business": 0.82, "health": 0.65, "science": 0.60, "other": 0.45,
}
MAJOR_OUTLETS = [
    "reuters", "bbc", "nyt", "new york times", "wsj", "wall street journal", "financial times", "ft",
    "politico", "npr", "sky", "al jazeera",
]
BENCHMARK_SOURCES = ["polymarket", "kalshi"]
PROCEDURAL_TERMS = [
    "paperwork reduction act", "information collection", "notice inviting comments",
    "public comment period", "request for information", "notice of submission", "meeting notice",
    "workshop notice", "draft guidance", "proposed information collection",
    "extension of a currently approved collection",
]

# ---- topic priors, profile B (whole-word hits, tiered) -----------------------
TIERED_TERMS = [
    (1.0, ["federal reserve", "fed", "fomc", "cpi", "inflation", "pce", "gdp", "nonfarm payroll",
           "jobs report", "unemployment", "treasury", "yield", "rate cut", "rate hike", "interest rate",
           "bls", "fred", "ecb", "boj"]),
    (0.98, ["bitcoin", "btc", "ethereum", "eth", "solana", "xrp", "dogecoin", "crypto", "cryptocurrency",
            "stablecoin", "coinbase", "binance", "etf", "token", "defi", "staking"]),
    (0.92, ["earnings", "revenue", "profit", "eps", "stock", "share price", "shares", "ipo", "merger",
            "acquisition", "m&a", "guidance", "dividend", "sec", "8-k", "10-q", "10-k", "nasdaq", "nyse",
            "s&p", "dow", "market cap"]),
    (0.9, ["election", "white house", "president", "senate", "house", "congress", "parliament",
           "prime minister", "cabinet", "referendum", "campaign", "democrat", "republican", "biden",
           "trump", "supreme court", "bill", "governor", "mayor", "vote", "voting"]),
    (0.86, ["nba", "nfl", "mlb", "nhl", "fifa", "uefa", "world cup", "super bowl", "playoffs", "finals",
            "championship", "grand slam", "formula 1", "premier league", "champions league",
            "stanley cup", "olympics"]),
    (0.8, ["war", "sanctions", "ceasefire", "tariff", "earthquake", "wildfire", "outbreak", "pandemic",
           "nato", "united nations", "airstrike", "missile", "evacuation", "strike", "hostage"]),
]
TIERED_OUTLETS = [
    "reuters", "bbc", "nyt", "new york times", "politico", "ap", "associated press", "ft",
    "financial times", "al jazeera", "npr",
]
TIERED_PROCEDURAL = [
    "paperwork reduction act", "public comment period", "request for comments", "information collection",
    "notice of submission", "proposed information collection", "federal register notice",
    "omb approval notice", "docket", "comments invited", "extension of a currently approved collection",
    "information collection request",
]

# ---- gate pack ----------------------------------------------------------------
AMBIGUOUS_TERMS = ["significant", "major", "substantial", "likely", "expected", "meaningful"]
GENERIC_SOURCE_TERMS = [
    "official source", "news reports", "media reports", "public sources", "internet", "various sources",
    "reputable sources", "official statements",
]
GENERIC_NEWS_ONLY_TERMS = [
    "reported by media", "reported by the media", "reported in the press", "press release", "press releases",
]
TRUSTED_MEDIA_TERMS = [
    "reuters", "associated press", "ap", "bbc", "financial times", "wall street journal", "wsj",
    "bloomberg", "al jazeera", "haaretz",
]
AUTHORITATIVE_TERMS = [
    "sec.gov", "edgar", "8-k", "10-q", "10-k", "federal reserve", "fomc", "bls.gov", "fda.gov",
    "clinicaltrials.gov", "congress.gov", "federal register", "court opinion", "court docket",
    "election commission", "central election commission", "government gazette", "official gazette",
    "cec.bg", "dv.parliament.bg", "state.gov", "gov.il", "government.se", "nato.int", "un.org",
    "who.int", "cdc.gov", "sec filing", "stock exchange", "nasdaq", "nyse", "league official",
    "official results", "investor relations", "company investor relations",
]
CREDIBLE_REPORTING_CATEGORIES = ["geopolitics", "other"]
AUTHORITATIVE_CATEGORIES = [
    "politics", "finance", "business", "sports", "legal", "health", "science", "technology", "energy",
    "environment", "space",
]
GENERIC_FALLBACK_TERMS = [
    "or reputable news sources", "or reputable sources", "or news sources", "or media reports",
    "or official statements",
]
STATEMENT_ANCHORS = ["official statement", "official statements", "government", "ministry", "spokesperson"]
DISPUTED_TERMS = [
    "primary reason", "main reason", "who is responsible", "who was responsible", "to blame", "blame for",
    "first violated", "first violation", "declare the ceasefire a success",
    "acknowledge the ceasefire's success", "acknowledge the ceasefire success",
]
WEAK_CRITERIA_TERMS = [
    "as expected", "as likely", "if confirmed", "if announced broadly", "if widely reported",
    "if official confirmation appears",
]
BINARY_LEAD = r"(?i)^\s*(will|is|are|was|were|does|do|did|has|have|had|can|could|should|would)\b"
VIOLENCE_TERMS = [
    "assassinate", "assassinated", "assassination", "murder", "murdered", "killing", "killed", "die",
    "dies", "death", "dead", "suicide", "self-harm", "mass shooting", "school shooting", "shooting",
    "bomb", "bombing", "bombed", "attack", "attacked", "execute", "executed", "execution", "torture",
    "tortured", "kidnap", "kidnapped", "kidnapping", "hostage",
]
SEVERE_VIOLENCE_TERMS = [
    "assassinate", "assassination", "murder", "mass shooting", "school shooting", "execute", "execution",
    "torture", "kidnap", "kidnapping", "hostage",
]
TERRORISM_TERMS = [
    "terrorist", "terrorism", "terror attack", "bioterrorism", "cyberterrorism", "jihad", "jihadist",
    "extremist attack", "extremist violence", "car bomb", "suicide bomb", "suicide bomber", "ied",
    "improvised explosive", "anthrax", "sarin", "nerve agent", "dirty bomb", "radiological weapon",
]
ILLEGAL_TERMS = [
    "drug trafficking", "drug cartel", "human trafficking", "money laundering", "child exploitation",
    "child abuse", "child pornography", "sex trafficking", "arms trafficking", "weapons smuggling",
]
QUESTION_STARTS = ["will", "is", "are", "does", "can", "could"]
DEATH_PATTERNS = [
    r"(?i)\bwill\b.{0,60}\b(die|pass away)\b",
    r"(?i)\bwill\b.{0,60}\b(be (killed|assassinated|murdered))\b",
    r"(?i)\b(how many|total number of|number of)\b.{0,30}\b(deaths|casualties|fatalities|killed|dead)\b",
]
# one of these stands wherever a death pattern matches
DEATH_WORDS = ["die", "pass away", "killed", "assassinated", "murdered", "deaths", "casualties", "fatalities", "dead"]
STATE_ACTION_PATTERNS = [
    r"(?i)\b(airstrike|airstrikes|military strike|military action|drone strike|bombing campaign)\b",
    r"(?i)\b(sanctions|sanction|embargo|trade war|ceasefire|peace deal|peace agreement)\b",
    r"(?i)\b(nato|un security council|united nations|congress|parliament|senate)\b.{0,50}\b(vote|approve|pass|authorize)\b",
    r"(?i)\b(invade|invasion|withdraw|withdrawal|deploy|deployment)\b",
]
MORAL_HAZARD_PATTERNS = [
    r"(?i)\bwill there be a\b.{0,40}\b(attack|shooting|bombing|riot|massacre)\b",
    r"(?i)\bwill\b.{0,30}\b(commit|carry out|perpetrate)\b.{0,30}\b(attack|crime|fraud|violence)\b",
]
MANIPULATION_TERMS = [
    "insider trading", "insider information", "front-running", "front running", "pump and dump",
    "pump-and-dump", "market manipulation", "price manipulation", "wash trading", "wash trade",
]
MINOR_WORD_TERMS = ["underage", "juvenile", "child", "teenager", "teen", "high school student", "middle school"]
MINOR_CONTEXT = r"\bminor\b.{0,30}\b(athlete|player|student|child|person|individual)\b"
MINOR_AGE = r"\b(\d{1,2})[\s-]?year[\s-]?old\b"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
SALVAGEABLE_FLAGS = [
    "ambiguous_wording", "weak_resolution_source", "weak_resolution_criteria", "invalid_deadline_window",
    "unclear_binary_condition", "low_resolution_confidence", "low_source_independence",
    "low_timing_reliability",
]
NON_SALVAGEABLE_PREFIXES = [
    "prohibited_topic", "manipulation_risk", "minor_involvement", "pii_exposure", "already_resolved",
    "excessive_deadline",
]

# ---- admission pack ---------------------------------------------------------------
BLOCKED_TERMS = [
    "fuck", "shit", "asshole", "bitch", "cunt", "dick", "pussy", "nigger", "nigga", "faggot", "retard",
    "whore", "bastard",
]
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
VAGUE_DEADLINES = ["soon", "tbd", "unknown", "n/a", "not specified", "to be determined"]
YES_WORDS = ["yes", "true", "correct", "affirmative"]
NO_WORDS = ["no", "false", "incorrect", "negative"]
SPORTSBOOK_TERMS = ["final score", "upcoming game"]
SPORTSBOOK_PATTERNS = [
    r"\bnext [a-z0-9' -]*game\b", r"\bwin (their|the) next game\b", r"\bscore at least \d+\b",
]
SPORTSBOOK_STAT = r"\b(points|rebounds|assists|goals|shots|threes)\b"

# ---- scoring pack ---------------------------------------------------------------------
HARD_EXCLUDE_PREFIXES = ["prohibited_topic", "manipulation_risk", "pii_exposure", "already_resolved"]
REGULATORY_EXACT = ["minor_involvement", "excessive_deadline"]
REGULATORY_EXACT_PENALTY = 0.15
REGULATORY_PREFIX_PENALTIES = [
    ("low_resolution_confidence", 0.10), ("low_source_independence", 0.10), ("low_timing_reliability", 0.05),
]
HOMEPAGE_PATHS = ["home", "homepage", "index.html", "index.htm"]
TRUSTED_DOMAINS = [
    ".gov", "sec.gov", "fda.gov", "ftc.gov", "bls.gov", "congress.gov", "federalregister.gov", "eia.gov",
    "whitehouse.gov", "treasury.gov", "supremecourt.gov", "ec.europa.eu", "who.int", "un.org",
    "binance.com", "finance.yahoo.com", "yahoo.com/finance", "nasdaq.com", "nyse.com", "cmegroup.com",
    "coingecko.com", "coinbase.com", "fred.stlouisfed.org", "investing.com", "fifa.com", "nba.com",
    "nfl.com", "mlb.com", "nhl.com", "premierleague.com", "uefa.com", "olympics.com", "espn.com",
]
PRICE_TERMS = [
    "bitcoin", "btc", "ethereum", "eth", "dogecoin", "tesla", "amazon", "stock", "closing price",
    "adjusted closing price", "split-adjusted closing price", "price",
]
MAJOR_SPORTS_TERMS = [
    "world series", "playoffs", "playoff", "championship", "final", "finals", "title", "relegated",
    "relegation", "super bowl", "world cup", "grand slam",
]
ORDINARY_MATCH_TERMS = ["next match", "upcoming match", "win against", "score more goals", "score more than"]
ORDINARY_MATCH_WORDS = ["match", "game", "fixture", "win", "score", "goals", "fc"]
ORDINARY_MATCH_DATE = r"\bby\s+\w+\s+\d{1,2}\s*,?\s*\d{4}\b"
MEDIA_TERMS = ["publish", "article", "story", "coverage", "headline", "editorial", "op-ed"]
OUTLET_TERMS = ["reuters", "bloomberg", "cnn", "fox", "nytimes", "bbc", "wired", "wsj", "guardian"]
PROMO_TERMS = [
    "sale", "discount", "promotion", "promo", "coupon", "bundle", "black friday", "cyber monday", "deal",
    "markdown", "cashback",
]
RETAIL_TERMS = ["% off", "discount", "coupon", "promotion", "promo", "sale", "bundle deal"]
LOW_SIGNIFICANCE_TERMS = [
    "homepage", "blog post", "announcement post", "teaser", "trailer", "merch", "giveaway", "sweepstakes",
    "app update", "feature rollout",
]
WEATHER_TERMS = [
    "weather", "temperature", "rain", "snow", "storm", "forecast", "heatwave", "cold front", "degrees",
]
INTEREST_SPORTS_TERMS = [
    "world series", "final", "finals", "championship", "playoff", "title", "grand slam", "world cup",
]
INTEREST_HIGH_TERMS = [
    "bitcoin", "btc", "ethereum", "eth", "crypto", "token", "spot etf", "price", "earnings", "revenue",
    "eps", "guidance", "rate cut", "fomc", "inflation", "cpi", "election", "vote", "ballot", "president",
    "prime minister", "parliament", "sanction", "ceasefire", "treaty", "nato", "un vote", "invasion",
    "fda approval", "pdufa", "supreme court", "ruling", "verdict", "championship", "final", "finals",
    "playoff", "world cup", "grand slam", "title",
]
INTEREST_LOW_TERMS = [
    "sale", "discount", "promotion", "promo", "coupon", "bundle", "deal", "publish", "article", "coverage",
    "announcement", "teaser", "weather", "temperature", "rain", "snow", "storm", "forecast", "degrees",
]
STRONG_HOSTS = [
    ".gov", "sec.gov", "fda.gov", "ftc.gov", "ec.europa.eu", "nasdaq.com", "nyse.com", "cmegroup.com",
    "fifa.com", "nba.com", "congress.gov", "bls.gov", "federalregister.gov", "fred.stlouisfed.org",
    "who.int", "un.org",
]
STRONG_PATHS = [
    "results", "standings", "scores", "edgar", "filing", "database", "data", "report", "statistics",
    "releases",
]
WEAK_NEWS_HOSTS = ["wired.com", "www.wired.com", "cnn.com", "www.cnn.com", "nytimes.com", "www.nytimes.com"]
WEAK_SOURCE_TEXT = ["official website", "news reports"]
EXPLANATIONS = {
    "promo": "Ranked lower because it resembles a promotional retail market and received quality penalties despite passing validation.",
    "strong": "Ranked highly because it has strong market interest, a strong resolution source, and no quality penalties.",
    "low_interest": "Ranked lower because it has limited market interest relative to major finance, geopolitics, or championship-style markets.",
    "weak_source": "Ranked in the middle because it is valid, but the resolution source appears weaker than top-ranked authoritative sources.",
    "horizon": "Ranked in the middle because the trading horizon is less practical than near-term markets with clearer timing.",
    "penalties": "Ranked in the middle because it is valid and resolvable, but quality penalties reduced its final score.",
    "middle": "Ranked in the middle because it is valid and clearly resolvable, but has lower market interest than top-tier markets.",
}

# ---- response contracts -----------------------------------------------------------------
EVENT_TYPES = [
    "election", "legislation", "court_case", "macro_release", "earnings", "merger", "policy", "crypto",
    "weather", "sports", "tech", "geopolitics", "public_health", "energy", "other",
]
QUESTION_CATEGORIES = [
    "politics", "finance", "technology", "geopolitics", "science", "health", "business", "sports",
    "energy", "legal", "environment", "space", "other",
]
QUESTION_TYPES = ["binary", "multiple_choice"]
# field -> (minimum length, maximum length or None)
EVENT_STRING_FIELDS = {
    "event_summary": (20, None), "event_type": (0, None), "outcome_variable": (5, None),
    "tradability": (0, None), "rejection_reason": (0, None), "market_angle": (0, None),
    "contradiction_details": (0, None), "time_horizon": (3, None),
}
# field -> (minimum items, required)
EVENT_LIST_FIELDS = {
    "entities": (1, True), "candidate_deadlines": (0, False), "resolution_sources": (1, True),
    "resolution_hints": (1, True),
}
QUESTION_STRING_FIELDS = {
    "question_text": (20, 500), "category": (0, None), "question_type": (0, None), "deadline": (5, 100),
    "deadline_source": (10, 500), "resolution_source": (10, 300), "resolution_criteria": (20, 1000),
    "rationale": (10, 500), "resolution_confidence_reason": (10, 300),
}
QUESTION_NUMBER_FIELDS = ["resolution_confidence", "source_independence", "timing_reliability"]

# ---- discovery views ------------------------------------------------------------------------
DISCOVERY_CATEGORIES = [
    "Politics", "Economics", "Technology", "Sports", "Entertainment", "Crypto", "Science", "World News",
    "Health", "Other",
]
CATEGORY_ALIASES = {
    "finance": "Economics", "business": "Economics", "economics": "Economics", "politics": "Politics",
    "technology": "Technology", "tech": "Technology", "sports": "Sports", "entertainment": "Entertainment",
    "crypto": "Crypto", "science": "Science", "space": "Science", "health": "Health",
    "world news": "World News", "international": "World News", "geopolitics": "World News",
    "legal": "World News",
}
TOPIC_SOURCES = {
    "Politics": ["Reuters politics desk", "official election calendars", "major polling trackers"],
    "Economics": ["BLS and FRED releases", "company filings", "major financial press"],
    "Technology": ["company launch blogs", "earnings calls", "developer conferences"],
    "Sports": ["league schedules", "team injury reports", "official standings pages"],
    "Entertainment": ["studio release calendars", "awards schedules", "trade publications"],
    "Crypto": ["exchange listings", "ETF or policy filings", "project and regulator announcements"],
    "Science": ["journal publications", "lab or agency updates", "conference schedules"],
    "World News": ["major wire services", "government statements", "multilateral organizations"],
    "Health": ["FDA calendars", "trial registries", "company and regulator updates"],
    "Other": ["primary source announcements", "major wire services", "specialist trade press"],
}
ADJACENT_TOPICS = {
    "Politics": ["campaign momentum", "regulatory follow-through", "cross-border reaction"],
    "Economics": ["rates and inflation", "employment sentiment", "policy spillovers"],
    "Technology": ["AI competition", "enterprise adoption", "regulatory pressure"],
    "Sports": ["injury volatility", "title odds", "broadcast narrative"],
    "Entertainment": ["release timing", "awards momentum", "social buzz"],
    "Crypto": ["ETF flows", "regulatory shifts", "exchange liquidity"],
    "Science": ["funding outlook", "commercialization", "policy adoption"],
    "World News": ["sanctions risk", "commodity impact", "diplomatic signaling"],
    "Health": ["trial timelines", "regulatory approval", "healthcare market response"],
    "Other": ["policy knock-on effects", "industry sentiment", "follow-up milestones"],
}
TOPIC_UNCERTAINTY = {
    "Politics": "Whether {t} turns into a measurable political shift or just a short-lived narrative spike.",
    "Economics": "Whether {t} changes the economic outlook enough to move expectations, pricing, or policy.",
    "Technology": "Whether {t} leads to a real launch, adoption milestone, or competitive response.",
    "Sports": "Whether {t} changes the competitive landscape in a way markets will quickly price in.",
    "Entertainment": "Whether {t} becomes a sustained audience and awards story rather than a one-cycle headline.",
    "Crypto": "Whether {t} becomes a concrete catalyst for price, regulation, or market structure.",
    "Science": "Whether {t} turns into a validated milestone with downstream commercial or policy consequences.",
    "Health": "Whether {t} develops into a verifiable regulatory or clinical milestone on a tradable timeline.",
    "World News": "Whether {t} escalates into a durable geopolitical development with clear downstream signals.",
    "Other": "What matters most is whether {t} develops into a concrete, verifiable signal rather than remaining narrative noise.",
}
TOPIC_WATCH = {
    "Politics": "Monitor official campaign, government, or election-calendar updates that convert narrative into a dated milestone.",
    "Economics": "Watch for scheduled data releases, policy meetings, or filings that turn the topic into a measurable macro signal.",
    "Technology": "Monitor launch dates, product notes, conference appearances, and executive comments for concrete confirmation.",
    "Sports": "Track official schedules, injury reports, standings changes, and matchup implications.",
    "Entertainment": "Watch release calendars, box-office reporting, ratings, and awards season catalysts.",
    "Crypto": "Monitor exchange, ETF, and regulator announcements that provide unambiguous market-moving confirmation.",
    "Science": "Track publication dates, conference readouts, and agency or lab statements.",
    "Health": "Watch trial readouts, FDA milestones, advisory-committee calendars, and sponsor guidance.",
    "World News": "Track sanctions, official statements, treaty votes, military posture changes, and multilateral responses.",
    "Other": "Monitor official source confirmation and follow-on second-order signals before treating the topic as durable.",
}
