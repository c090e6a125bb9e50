"""Default word lists (hotel domain) and helpers to pass word lists as tables.

Word lists are parameters.  The fixed ones are Python iterables; a list becomes an
``IN`` set that Catalyst compiles to a hash lookup inside whole-stage codegen
(no join, no shuffle).  Lists derived from data (spelling vocabulary, KPI
tokens) stay DataFrames and are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These lists must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Stop words of the n-gram keyword report.
NGRAM_STOPWORDS = frozenset(
    "a an and are as at be been by for from has he in is it its of on that the to was will with we i you "
    "they this but or had have very so can could would should there their them us our my me his her him "
    "were did do does am all any both each few more most other some such no nor not only own same than "
    "too up down out off over under again further then once here when where why how what which who if "
    "because until while about against between into through during before after above below now also "
    "just get got".split()
)

# Low-value review words (used by the n-gram report and the token cleaner).
IRRELEVANT_WORDS = frozenset(
    "day night time times week month year hour minute today yesterday tomorrow ago later early late first "
    "second third last next previous every always never sometimes usually often really quite pretty much "
    "many lot lots bit little big small large huge tiny place thing things way ways part side end "
    "beginning middle top bottom back front left right around near far close away sure yes ok okay well "
    "fine alright maybe perhaps probably definitely certainly".split()
)

# Quality adjectives of the n-gram report ('check-in' can never match: hyphens become spaces).
HOTEL_ADJECTIVES = frozenset(
    "excellent great good amazing wonderful fantastic awesome perfect outstanding brilliant fabulous superb "
    "magnificent beautiful lovely nice pleasant comfortable clean fresh delicious tasty friendly helpful "
    "professional courteous attentive responsive quick fast convenient easy smooth efficient bad poor "
    "terrible awful horrible disgusting dirty filthy noisy loud slow delayed late rude unhelpful "
    "unprofessional disappointing unsatisfactory unacceptable inconvenient difficult uncomfortable cramped "
    "small tiny old outdated broken damaged smelly cold hot expensive".split()
)

HOTEL_NOUNS = frozenset(
    "hotel room service staff food breakfast dinner lunch restaurant bar lobby reception check-in checkout "
    "bed bathroom shower wifi internet parking pool gym spa location view beach amenities facilities price "
    "value money cost booking reservation stay visit trip vacation holiday experience management "
    "housekeeping maintenance security concierge porter bellboy valet".split()
)

# Ordered business categories of the n-gram report; the last one is the default.
HOTEL_CATEGORIES = [
    ("Room Quality", "room bed bathroom shower clean comfortable spacious"),
    ("Service Quality", "service staff reception check helpful friendly professional"),
    ("Food & Dining", "food breakfast dinner lunch restaurant delicious tasty"),
    ("Location & Amenities", "location pool gym spa wifi parking beach view"),
    ("Value & Pricing", "price value money cost expensive cheap affordable"),
]
DEFAULT_CATEGORY = "Overall Experience"

# English stop words of the keyword pipeline (the common 179-word English list).
ENGLISH_STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he "
    "him his himself she she's her hers herself it it's its itself they them their theirs themselves what "
    "which who whom this that that'll these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain "
    "aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't "
    "ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't "
    "won won't wouldn wouldn't".split()
)

NOISE_NOUNS = frozenset(
    "item items request requests cleaning tidying tidy thing things stuff job jobs need needs charge charges "
    "fee fees floor floors person people work effort issue issues requester requesting management policy "
    "policies process processes case cases matter matters".split()
)

ABSTRACT_IDEA_NOUNS = frozenset(
    "time love idea happiness joy sadness anger freedom justice beauty information knowledge energy service "
    "experience quality value emotion feeling truth opinion issue problem satisfaction comfort management "
    "team performance feedback".split()
)

PRAISE_TARGETS = frozenset("job work effort team person people staff manager agent service support crew".split())

ABSTRACT_SUFFIXES = ("ness", "ity", "tion", "sion", "ment", "ance", "ence", "hood", "ship", "ology")

HOTEL_DOMAIN_NOUNS = frozenset(
    "hotel room suite apartment service staff food meal breakfast dinner lunch restaurant bar cafe buffet "
    "kitchen chef menu beverage drink lobby reception frontdesk check checkin checkout bed bedding mattress "
    "pillow linen bathroom toilet shower toiletries amenity amenities wifi internet network connection "
    "parking valet garage pool spa gym fitness sauna steam location view beach garden balcony housekeeping "
    "laundry maintenance cleaner security concierge porter bellboy transport transportation shuttle "
    "airport".split()
)

GENERIC_PHRASE_COMPONENTS = frozenset(
    "hotel stay guest experience place something anything everything everyone good great nice excellent "
    "amazing awesome wonderful best worst bad poor friendly unfriendly comfortable uncomfortable fantastic "
    "awful terrible horrible".split()
)

ASPECT_NOUN_WHITELIST = frozenset(
    "room staff service housekeeping concierge porter bellboy manager team breakfast dinner lunch meal buffet "
    "menu chef kitchen taste flavour flavor restaurant bar cafe beverage drink coffee tea dessert bathroom "
    "toilet shower toiletries towel linen bed bedding mattress pillow amenity amenities facility facilities "
    "wifi internet network connection parking valet garage pool spa gym fitness sauna steam location view "
    "checkout checkin booking reservation value price cost speed size hygiene cleanliness ambience ambiance "
    "music lighting aircon ac temperature noise security safety comfort transport transportation shuttle "
    "airport".split()
)

FUNCTIONAL_ADJECTIVES = frozenset(
    "clean dirty noisy quiet fast slow free paid available crowded spacious comfortable uncomfortable helpful "
    "unhelpful responsive unresponsive efficient inefficient friendly unfriendly".split()
)

# Word-net domains that decide the abstract-noun test.
ABSTRACT_DOMAINS = frozenset(
    ["noun.cognition", "noun.feeling", "noun.state", "noun.attribute", "noun.act", "noun.event"]
)
CONCRETE_DOMAINS = frozenset(
    ["noun.artifact", "noun.object", "noun.food", "noun.location", "noun.plant", "noun.animal", "noun.substance"]
)

# Aspect phrases never reported by the aspect programs.
STOP_ASPECTS = frozenset(
    "it this that thing something anything everything place hotel property experience stay time day night "
    "room".split()
)

# Words after which a new clause starts.
CONTRAST_WORDS = ("but", "however", "although", "though", "yet", "nevertheless")

# Default KPI and department names when no file is given.
DEFAULT_KPIS = ["Activities", "Amenities", "Customer Satisfaction", "Room", "Service", "FoodandBeverages"]
DEFAULT_DEPARTMENTS = ["Front Office", "Housekeeping", "Restaurant", "Room", "General"]

# Department hints, in order: (hint substring, department).
DEPARTMENT_HINTS = [
    ("food", "Restaurant"), ("dining", "Restaurant"), ("bar", "Bar/ Pub"), ("clean", "Housekeeping"),
    ("hygiene", "Housekeeping"), ("room", "Room"), ("service", "Front Office"), ("staff", "Front Office"),
    ("security", "Security"), ("safety", "Safety"), ("price", "Retail"), ("value", "Retail"),
    ("wifi", "Internet / Wifi"), ("pool", "Recreation"), ("location", "Location"), ("spa", "Spa"),
    ("gym", "Gym"), ("comfort", "Room"), ("smell", "Housekeeping"), ("ambience", "Restaurant"),
]

# KPI token synonyms, added to a rule at the synonym weight.
TOKEN_SYNONYMS = {
    "hygiene": ["cleanliness", "sanitation"],
    "clean": ["sanitary", "spotless", "hygienic"],
    "staff": ["personnel", "team", "crew", "associates", "employees"],
    "service": ["support", "assistance", "hospitality", "customer care"],
    "food": ["cuisine", "meal", "dining", "restaurant", "kitchen"],
    "taste": ["flavour", "flavor", "palate", "seasoning"],
    "buffet": ["spread", "banquet", "breakfast"],
    "breakfast": ["brunch", "morning meal"],
    "lunch": ["midday meal", "tiffin"],
    "dinner": ["supper", "evening meal"],
    "beverage": ["drink", "refreshment"],
    "location": ["proximity", "area", "neighbourhood", "neighborhood"],
    "room": ["suite", "bedroom", "accommodation", "lodging"],
    "amenities": ["facility", "amenity", "features", "utilities"],
    "safety": ["security", "protection"],
    "price": ["cost", "rate", "tariff", "value"],
    "comfort": ["comfortable", "relaxation"],
    "speed": ["latency", "response", "quickness"],
    "wifi": ["internet", "network", "wi-fi", "broadband"],
    "pool": ["swimming pool", "plunge"],
    "spa": ["wellness", "salon"],
    "parking": ["garage", "valet", "carpark"],
    "waiter": ["server", "steward"],
    "housekeeping": ["cleaning", "maid"],
    "check": ["checkin", "checkout", "registration"],
    "ambience": ["ambiance", "atmosphere", "vibe"],
    "music": ["soundtrack", "playlist"],
    "lighting": ["illumination", "lights"],
    "noise": ["sound", "volume"],
    "security": ["safety", "guard"],
    "transport": ["shuttle", "transfer", "pickup", "dropoff"],
    "value": ["pricing", "worth", "affordability"],
    "reservation": ["booking", "prebooking"],
}

# Entity types that make a noun chunk uninformative.
UNDESIRED_ENTITIES = frozenset(["PERSON", "DATE", "TIME", "QUANTITY", "CARDINAL", "ORDINAL"])

# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def in_words(col: Column, ws: Iterable[str]) -> Column:
    """``col IN (...)`` — Catalyst turns long literal lists into a hash set (InSet)."""
    ws = sorted(set(ws))
    if not ws:
        return F.lit(False)
    return col.isin(ws)


def word_table(spark, ws: Iterable[str], name: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(set(ws))], f"{name} string")
