"""Fixed values that results depend on."""

# fixed values: stop words of the token rule
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "with")
# fixed values: stop words of the keyword rule
KEYWORD_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "for", "from", "have", "how", "if", "in", "is", "it", "its", "let", "more", "not", "of", "on", "one", "or", "our", "so", "that", "the", "their",
    "this", "to", "use", "used", "using", "we", "what", "when", "which", "with", "you", "your",
)
# fixed values: entity types, descriptive then operational
ENTITY_TYPES = ("skill", "tool", "library", "framework", "platform", "database", "architecture", "protocol", "concept", "domain", "product", "state", "action", "goal", "agent", "evidence")
# fixed values: enumerations, and the order of costs
PRIORITIES = ("low", "medium", "high", "critical")
MEDIA_TYPES = ("text", "image", "video", "audio")
COSTS = {"low": 0, "medium": 1, "high": 2}
# fixed values: names too general for an entity
GENERIC_NAMES = ("system", "project", "tool", "computer", "work", "experience", "technology", "feature", "application", "problem", "task")
# fixed values: distance of an edge by relation; None is never walked
EDGE_WEIGHTS = {"REQUIRES": 1, "LEADS_TO": 1, "EVIDENCE": 2, "IMPLIES": 2, "SIMILAR": 3, "COMPLETED": None, "BLOCKED_BY": None}
DEFAULT_EDGE_WEIGHT = 2
UNKNOWN_DISTANCE = 9223372036854775807
# fixed values: limits, thresholds, scores and shares
TOP_K, MIN_SCORE, WORD_CAP = 3, 0.15, 80
MAX_CONTEXTS, TOP_KEYWORDS = 3, 8
SEEDS, SEED_FLOOR, DECAY = 4, 0.01, 0.65
BLEND = (0.35, 0.55, 0.10)
DENSITY_CAP = 3
JACCARD_NEAR, OPENER_OVERLAP, OPENER_WORDS = 0.6, 0.7, 15
CONTEXT_WORDS = (8, 50)
UBIQUITOUS_SHARE, MAX_LINKS = 0.8, 6
EDGE_SCORES = {"requires": 0.85, "other": 0.65, "inferred": 0.70}
MIN_MENTIONS = 5
# fixed values: relations of edges
RELATIONS = ("SIMILAR", "REQUIRES", "LEADS_TO", "EVIDENCE", "IMPLIES", "COMPLETED", "BLOCKED_BY")
# fixed values: types that act, and words that are never an entity's keywords
OPERATIONAL_TYPES = ("state", "action", "goal", "agent", "evidence")
LABEL_WORDS = ("name", "type", "context", "content", "related", "tags", "aliases")
