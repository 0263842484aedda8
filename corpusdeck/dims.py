"""Fixed values that results depend on: phrase lists, keyword lists, patterns and profile numbers, in their natural order."""

# ---- Fixed values: phrases of each sentence signal ----
SIGNAL_PHRASES = {
    "objective": ["understand", "learn", "able to", "by the end", "objective", "goal", "aim", "purpose", "you will", "students will", "learners will", "upon completion", "after this", "this module", "this lesson", "this slide", "this section"],
    "fact": ["important", "critical", "key", "essential", "fundamental", "note that", "remember", "significant", "must", "required", "primary", "main", "core", "vital", "crucial"],
    "process": ["process", "mechanism", "procedure", "operation", "system", "workflow", "pipeline", "sequence", "cycle", "algorithm", "method", "technique", "approach", "strategy", "protocol"],
    "advantage": ["advantage", "benefit", "pro", "strength", "merit", "positive", "plus", "upside", "gain", "reward", "asset", "virtue", "boon", "virtue", "opportunity"],
    "disadvantage": ["disadvantage", "drawback", "con", "weakness", "limitation", "challenge", "downside", "risk", "issue", "problem", "concern", "obstacle", "barrier", "cost", "penalty", "pitfall", "threat", "negative"],
    "example": ["for example", "for instance", "e.g.", "such as", "to illustrate", "consider", "as an example", "like", "including", "namely", "i.e."],
}
#: How many of each signal a unit keeps.
SIGNAL_CAPS = {"objective": 1, "fact": 8, "process": 6, "advantage": 6, "disadvantage": 6, "example": 6}
COMPARISON_PHRASES = ["vs", "versus", "compared to", "compared with", "unlike", "whereas", "on the other hand", "in contrast", "alternatively", "similarly", "different from", "same as", "as opposed to"]
CAUSE_PHRASES = ["because", "since", "due to", "as a result of", "owing to", "caused by"]
EFFECT_PHRASES = ["therefore", "thus", "hence", "consequently", "as a result", "leads to", "results in", "causes", "produces", "triggers", "enables", "allows", "so that"]
ORDINAL_WORDS = ["first", "second", "third", "fourth", "fifth", "initially", "then", "next", "subsequently", "finally", "previously", "before", "after", "during", "while", "earlier", "later", "eventually", "simultaneously", "following", "preceding"]
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who", "which", "can", "does", "is", "are", "do", "should", "will", "would", "could"]
TECHNICAL_TERMS = [
    "algorithm", "architecture", "bandwidth", "byte", "cache", "catalyst", "chromosome", "coefficient", "compiler", "database", "derivative", "ecosystem", "electrode", "entropy", "equilibrium", "firmware", "gradient", "hypothesis",
    "inference", "integral", "iteration", "kernel", "latency", "microcontroller", "middleware", "molecule", "neural", "nucleus", "optimization", "paradigm", "photosynthesis", "polymer", "protocol", "quantum", "recursion", "regression",
    "render", "repository", "runtime", "semiconductor", "serialization", "synthesis", "topology", "transformer", "variance", "velocity", "wavelength", "widget", "framework", "interface", "api", "sdk", "cpu", "gpu", "ram", "sql", "nosql",
    "cloud", "container", "microservice", "agile", "scrum", "devops", "ci", "cd", "saas", "paas", "iaas", "roi", "kpi", "erp", "crm",
]
#: Predicates of relationships and their verbs, in the order of preference.
LINK_VERBS = [
    ("IS_A", ["is a", "is an", "are a", "are an"]), ("PART_OF", ["is part of", "are part of", "belongs to"]), ("CAUSES", ["causes", "caused by", "triggers"]),
    ("LEADS_TO", ["leads to", "results in", "produces", "enables"]), ("DEPENDS_ON", ["depends on", "requires", "relies on"]),
    ("CONTRASTS_WITH", ["unlike", "versus", "compared to", "in contrast"]), ("SUPPORTS", ["supports", "enhances", "improves"]),
    ("DEFINED_BY", ["is defined as", "refers to", "means"]), ("INCLUDES", ["includes", "contains", "consists of", "comprises"]), ("FOLLOWS", ["follows", "precedes", "after", "before"]),
]

# ---- Fixed values: intents in enumeration order, with their keywords ----
INTENT_KEYWORDS = {
    "Definition": ["is defined as", "refers to", "known as", "means", "definition", "defined", "glossary", "terminology", "what is", "is a type of"],
    "Process": ["process", "mechanism", "procedure", "how it works", "operation", "method", "technique", "approach", "protocol"],
    "Workflow": ["workflow", "pipeline", "flow", "sequence of steps", "step by step", "systematic", "stage", "phase"],
    "Timeline": ["timeline", "history", "chronology", "evolution", "milestones", "year", "century", "decade", "era", "period", "date"],
    "Comparison": ["vs", "versus", "compared to", "comparison", "difference", "similarities", "unlike", "whereas", "contrast", "pros and cons"],
    "Table": ["table", "matrix", "grid", "spreadsheet", "rows", "columns"],
    "Statistics": ["statistics", "data", "percentage", "survey", "study found", "research shows", "according to", "percent", "rate", "ratio", "average", "median", "mean", "growth rate"],
    "Hierarchy": ["hierarchy", "level", "tier", "rank", "order", "classification", "taxonomy", "category", "sub-category", "breakdown"],
    "Cycle": ["cycle", "loop", "iteration", "recurring", "repeat", "circular", "continuous", "ongoing", "round", "rotation"],
    "Problem": ["problem", "challenge", "issue", "limitation", "obstacle", "barrier", "bottleneck", "pain point", "difficulty", "failure"],
    "Solution": ["solution", "resolve", "address", "mitigate", "fix", "answer", "approach", "remedy", "overcome", "solve"],
    "Architecture": ["architecture", "component", "layer", "module", "system design", "infrastructure", "framework", "stack", "platform", "design pattern"],
    "Formula": ["formula", "equation", "expression", "calculation", "theorem", "law of", "mathematical", "derivation", "proof"],
    "Case Study": ["case study", "real world", "scenario", "example company", "case of", "study of", "analysis of", "in practice"],
    "Summary": ["summary", "in summary", "to summarize", "recap", "overview", "key takeaways", "in brief", "to conclude", "at a glance"],
    "Conclusion": ["conclusion", "in conclusion", "therefore", "finally", "to sum up", "overall", "ultimately", "in the end"],
    "Checklist": ["checklist", "to-do", "action items", "tasks", "steps to follow", "requirements", "criteria", "check", "verify", "ensure"],
    "FAQ": ["faq", "frequently asked", "common questions", "q&a", "questions and answers", "q:", "a:"],
}
#: Structural bonus: intent, count that it looks at, least count, bonus; the bonuses of an intent add up to 1 at most.
INTENT_BONUS = [
    ("Table", "n_tables", 1, 0.8), ("Formula", "n_equations", 1, 0.9), ("Workflow", "step", 3, 0.5), ("Workflow", "n_diagrams", 1, 0.3), ("Timeline", "chronology", 2, 0.6), ("Comparison", "comparison", 1, 0.6),
    ("Definition", "definition", 1, 0.6), ("Statistics", "number", 2, 0.5), ("Process", "process", 1, 0.5), ("Checklist", "list_or_steps", 1, 0.4), ("FAQ", "faq", 1, 0.8), ("Hierarchy", "max_bullet_depth", 2, 0.4),
    ("Architecture", "n_diagrams", 1, 0.5), ("Architecture", "n_charts", 1, 0.2), ("Case Study", "example", 2, 0.4),
]
INTENT_LEAST, INTENT_MOST = 0.2, 4
#: Visual opportunities in the order of their rules, with their confidence.
OPPORTUNITIES = {
    "Flowchart": 0.90, "Timeline": 0.88, "Comparison Table": 0.85, "KPI Cards": 0.85, "Icon Grid": 0.80, "SmartArt": 0.75, "Cycle Diagram": 0.82, "Process Diagram": 0.78, "Checklist": 0.75, "Pyramid": 0.80,
    "Decision Tree": 0.72, "Image with Caption": 0.90, "Matrix": 0.70, "Roadmap": 0.82,
}
#: Words in a unit that call for a visual.
VISUAL_PHRASES = {
    "Cycle Diagram": ["loop", "cycle", "repeat", "circular"],
    "Checklist": ["task", "check", "verify", "ensure", "action"],
    "Pyramid": ["pyramid", "hierarchy", "tier", "level", "foundation"],
    "Decision Tree": ["if ", "else", "decision", "choice", "branch", "condition"],
    "Roadmap": ["phase", "release", "q1", "q2", "q3", "q4", "roadmap", "milestone"],
}
TOPIC_KEYWORDS = [
    ("emerald_academic", ["medical", "health", "biology", "science", "nature", "green", "environment"]),
    ("midnight_cyber", ["cyber", "code", "programming", "software", "tech", "data", "ai", "machine"]),
    ("swiss_corporate", ["business", "finance", "corporate", "swiss", "market", "management", "report"]),
    ("sunset_editorial", ["history", "art", "literature", "education", "humanities", "editorial"]),
    ("ocean_tech", ["ocean", "water", "cloud", "network", "system", "database"]),
    ("charcoal_gold", ["executive", "luxury", "gold", "premium", "strategic", "lead"]),
    ("warm_terracotta", ["architecture", "design", "warm", "terracotta", "craft"]),
    ("nordic_slate", ["nordic", "clean", "slate", "simple", "minimal"]),
    ("glass_indigo", ["glass", "indigo", "modern", "future"]),
]
TOPIC_DEFAULT = "brutalist_neon"

# ---- Fixed values: patterns that mean the same in Java's and RE2's dialects ----
HEADING = r"^(#{1,6})[ \t]+(.*)$"
LIST_MARKER = r"^[ \t]*([-*+]|[0-9]+[.)])[ \t]+"
STEP = (
    r"(?i)^[ \t]*((step|phase|stage|part|item|point)[ \t]*[0-9]+|[0-9]+[.:)][ \t]+|[a-z][.:)][ \t]+|[ivxlcdm]+[.:)][ \t]+|"
    r"(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b)"
)
NUMBER = (
    r"(?i)(\$[0-9,]+(\.[0-9]+)?|[0-9]+(\.[0-9]+)?\s*%|[0-9]+(,[0-9]{3})+(\.[0-9]+)?|"
    r"[0-9]+(\.[0-9]+)?\s*(billion|million|trillion|thousand|hundred|km|kg|mb|gb|tb|hz|mhz|ghz|ms|ns|\bx\b|px|pt|em|rem)|\b[0-9]{4}\b)"
)
DATE = (
    r"(?i)(\b(Jan(uary)?|Feb(ruary)?|Mar(ch)?|Apr(il)?|May|Jun(e)?|Jul(y)?|Aug(ust)?|Sep(tember)?|Oct(ober)?|Nov(ember)?|Dec(ember)?)\s+[0-9]{1,2}(,\s*[0-9]{4})?|"
    r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b|\b(19|20)[0-9]{2}\b)"
)
COLON_DEFINITION = r"^([A-Z][A-Za-z\s-]{2,35}):\s+(.{5,})"
DEFINITION = (
    r"(?i)([A-Z][A-Za-z\s\-]{2,40})\s*(?:is\s+defined\s+as|refers\s+to|is\s+known\s+as|means|can\s+be\s+defined\s+as|is\s+the\s+process\s+of|"
    r"is\s+an?\s+|:\s+|—\s+|–\s+)(.[^.\n]*)"
)
#: What a text needs for the pattern above to match: cheaper to look for first.
DEFINITION_CUE = r"(?i)means|refers\s+to|is\s+(?:an?\s|defined|known|the\s+process)|can\s+be\s+defined|[:—–]\s"
#: A point that no match of DEFINITION goes past: no cue can end right before it.
DEFINITION_END = r"\.(?<=[^sofSOF\s]\.)"
FORMULA_SIGNS = "=×÷^√∑∫±Δ→←↔≤≥≠∞∝∈∀∃"
FORMULA = r"[A-Za-z0-9\s]+[=×÷\^√∑∫±Δ→←↔≤≥≠∞∝∈∀∃][A-Za-z0-9\s+\-*/().]+"
FORMULA_WORD = r"(?i)(?:formula|equation|expression)\s*:?\s*(.[^.\n]*)"
DECORATIVE = (
    r"(?i)^\s*(?:slide\s+[0-9]+(?:\s*/\s*[0-9]+)?|page\s+[0-9]+(?:\s*/\s*[0-9]+)?|[0-9]+\s*/\s*[0-9]+|copyright\s+.*|all\s+rights\s+reserved|confidential|draft|"
    r"www\.[a-z0-9.\-]+\.[a-z]{2,}|https?://[^\s]+|[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4})\s*$"
)
DECORATIVE_PARTS = ["confidential", "draft", "all rights reserved", "internal use only"]
FILLER_PHRASES = [
    "as mentioned earlier", "please note that", "it is important to remember", "as shown in the figure", "refer to the next slide", "for more information", "click here to learn more", "this slide shows",
    "in this section we will", "as stated above", "continue to the next page",
]
QUANTITY = r"(?i)([$₹€£¥]\s?)?([0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s?(%|percent|percentage|x|k|bn|mn|m|cr|crore|lakh|years?|yrs?|months?|days?)?"
ABBREVIATIONS = [
    "no", "nos", "fig", "eq", "vs", "etc", "approx", "e.g", "i.e", "cf", "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vol", "ch", "sec", "min", "max", "avg", "std", "dept", "univ", "inc", "ltd", "co",
]
LABELLED = r"(?s)^\s*([A-Z][\w&/()\- ]{2,34}?)\s*[:–—-]\s+(\S.*)$"
META_LABELS = ["label", "item", "point", "bullet", "text", "title", "heading", "description", "desc", "value", "field", "key", "name", "content"]
LAYOUT_FLOW = r"step\s*1|\bfirst,|\bsecond,|\bprocess\b|\bworkflow\b|\bcycle\b|\balgorithm\b|\bsequence\b|\bpipeline\b|\bstage\b|\bmechanism\b"
LAYOUT_TABLE = r"\bvs\.?\b|\bversus\b|\bcomparison\b|\bcompared?\b|\bpros and cons\b|\bdifference between\b|\badvantages and disadvantages\b"
LAYOUT_METRIC = r"\b[0-9]+(\.[0-9]+)?%|\b[0-9]+\s*(percent|million|billion|k|x)\b"

# ---- Fixed values: density profiles ----
PROFILE_FIELDS = ("max_bullets", "max_words", "max_chars", "max_rows", "max_steps", "max_cards", "extras", "enhanced")
PROFILES = {"low": (3, 12, 90, 4, 3, 3, 0, False), "medium": (5, 20, 140, 6, 4, 4, 1, True), "heavy": (8, 32, 220, 10, 6, 4, 3, True)}
DEFAULT_PROFILE = "medium"
#: Sections stop merging beyond this many characters; chunks are cut to this many words; a document needs this many characters.
MERGED_CHARS, CHUNK_WORDS, LEAST_CHARS = 1800, 180, 120

# ---- Fixed values: transformation plans and visual specifications ----
#: Opportunities with a builder, the visual that each becomes, and the signals that it draws on.
BUILT = {
    "Flowchart": ("Flowchart", ["step", "process"]), "Timeline": ("Timeline", ["chronology"]), "Comparison Table": ("Comparison Table", ["advantage", "disadvantage"]), "KPI Cards": ("KPI Cards", ["number"]),
    "Icon Grid": ("Icon Grid", ["concept"]), "SmartArt": ("SmartArt", ["concept"]), "Cycle Diagram": ("Cycle Diagram", ["process"]), "Process Diagram": ("Process Diagram", ["step"]), "Checklist": ("Checklist", ["step"]),
    "Pyramid": ("SmartArt", ["concept"]), "Decision Tree": ("Decision Tree", ["process"]), "Matrix": ("Matrix", ["concept"]), "Roadmap": ("Timeline", ["chronology"]), "Image with Caption": ("AI Image", []),
}
#: Opportunities that a plan has no builder for.
UNBUILT = ["Image with Caption"]
FLOW_PREFIX = r"(?i)^(Step\s*[0-9]+\s*[:\-]?\s*|[0-9]+[.)]\s*)"
FLOW_DECISIONS = ["if", "whether", "verify", "validate", "check", "decide", "choose", "compare", "evaluate", "test", "confirm", "else", "otherwise"]
EVENT_DATE = r"(?i)(\b[0-9]{4}\b|\bQ[1-4]\b|\bPhase\s*[0-9]+\b|\bStep\s*[0-9]+\b|\bWeek\s*[0-9]+\b|\bMonth\s*[0-9]+\b|\bDay\s*[0-9]+\b)"
MILESTONES = ["launch", "release", "finish", "complete", "go-live", "milestone", "deploy", "ship", "publish", "final", "deadline", "due"]
CHART_CUES = {
    "bar": ["distribution", "comparison", "count", "frequency", "volume"], "line": ["trend", "growth", "over time", "change", "rate", "timeline"], "pie": ["proportion", "share", "percentage", "breakdown", "composition"],
    "radar": ["performance", "skills", "attributes", "score", "dimensions"], "scatter": ["correlation", "relationship", "vs", "against", "plot"],
}
CHART_NUMBER = r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?(?:\s*%)?|[0-9]+\.[0-9]+|[0-9]+)"
KPI_NUMBER = (
    r"(?i)(\b[0-9]+(?:\.[0-9]+)?\s*%|\b[0-9]+(?:\.[0-9]+)?\s*[xX]|\$\s*[0-9]+(?:[,0-9]*)?(?:\.[0-9]+)?(?:\s*[KMBT])?|"
    r"\b[0-9]+(?:[,0-9]*)(?:\.[0-9]+)?\s*(?:seconds?|mins?|hours?|days?|ms|GB|TB|MB)?|\b[0-9]+(?:\.[0-9]+)?)"
)
KPI_UNIT = r"(?i)\b(%|percent|seconds?|mins?|hours?|days?|x|ms|GB|TB|MB|KB|kg|km|°C|°F)\b"
TREND_UP = ["increase", "growth", "improve", "higher", "up", "more", "gain", "rise"]
TREND_DOWN = ["decrease", "reduce", "drop", "lower", "down", "less", "fall", "decline"]
SMARTART_INTENTS = {"Hierarchy": "Hierarchy", "Cycle": "Cycle", "Process": "Process", "Workflow": "Process", "Timeline": "Chevron", "Comparison": "Relationship"}
SMARTART_CUES = {
    "Hierarchy": ["hierarchy", "level", "tree", "parent", "child", "subordinate", "tier"], "Cycle": ["cycle", "loop", "repeat", "iterative", "continuous", "recurring"],
    "Process": ["process", "pipeline", "workflow", "sequence", "stage", "phase", "step"], "Pyramid": ["pyramid", "priority", "level", "foundation", "tier", "rank", "most important"],
    "Chevron": ["arrow", "flow", "direction", "forward", "progression", "advance"], "Relationship": ["relationship", "connect", "link", "depend", "interact", "between", "among"],
}
CHECKLIST_ACTIONS = ["ensure", "verify", "check", "validate", "confirm", "complete", "review"]
#: Icons and their keywords, in the order in which keywords are tried.
ICONS = [
    ("cpu", ["ai", "artificial", "algorithm", "machine", "neural", "model"]), ("book-open", ["learn", "student", "course", "education", "teach", "knowledge"]), ("database", ["data", "database", "storage"]),
    ("bar-chart-2", ["stat", "metric", "analytic", "report", "graph", "chart"]), ("activity", ["process", "flow", "pipeline", "workflow"]), ("zap", ["speed", "perform", "fast", "efficient", "optim"]),
    ("users", ["team", "collaborat", "social", "communic", "network"]), ("shield", ["secure", "protect", "safety", "auth", "trust"]), ("cloud", ["cloud"]), ("server", ["server", "deploy"]),
    ("dollar-sign", ["cost", "price", "money", "budget", "revenue"]), ("flask", ["science", "biology", "chemistry", "experiment", "lab"]), ("clock", ["time", "schedule", "deadline"]),
    ("check-square", ["verify", "task", "action", "ensure", "checklist"]),
]
ICON_DEFAULT = "circle"
ICON_PLACES = ["top-left", "top-center", "top-right", "middle-left", "center", "middle-right", "bottom-left", "bottom-center", "bottom-right"]
IMAGE_STYLES = {
    "Introductory": "Flat design illustration, minimal shapes, bold primary colours, friendly and approachable visual style",
    "Intermediate": "Modern minimalist educational infographic, clean line art, vibrant gradient accents (teal and deep blue)",
    "Advanced": "Technical schematic illustration, precise vector art, dark-mode background with neon accent highlights",
    "Expert": "High-detail scientific diagram style, isometric projection, monochromatic palette with strategic colour accent",
}
IMAGE_COMPOSITIONS = ["Centred single focal point, clean white studio background", "Triptych layout, three equal columns, minimal dividers", "Isometric grid composition, multiple concept zones, clear visual hierarchy"]
IMAGE_ANGLES = [
    (["Process", "Workflow"], "Top-down birds-eye view showing flow direction left to right"), (["Hierarchy"], "Slightly elevated angle showing hierarchical depth"), (["Statistics"], "Straight-on frontal view for data clarity"),
    ([], "Eye-level straight-on perspective"),
]
#: Labels of enhancements on slides, by the column that they come from, in order of preference.
EXTRAS = [("Example", "examples"), ("Analogy", "analogies"), ("In practice", "real_world_applications"), ("Watch out", "common_mistakes"), ("Recall", "revision_points")]

# ---- Fixed values: text actions of a transformation plan ----
#: A footer has one of these words and a number; legal lines are short; what ends a sentence.
FOOTER_WORDS, FOOTER_NUMBER = ["page", "slide", "copyright"], r"\b[0-9]+\b"
LEGAL_PHRASES = ["confidential", "internal use only", "draft", "all rights reserved"]
SENTENCE_END = r"(?<=[.!?])\s+"
TASK_WORDS = ["ensure", "verify", "check", "task", "action"]

# ---- Fixed values: enhancements ----
#: Slides of a deck that are enhanced at most.
MOST_ENHANCED = 12
#: List fields of a context: label, signal, items at most, separator.
CONTEXT_LISTS = [
    ("Steps", "step", 6, " → "), ("Formulas", "formula", 3, " | "), ("Key stats", "number", 4, ", "), ("Important facts", "fact", 3, " "),
    ("Processes", "process", 3, "; "), ("Advantages", "advantage", 3, "; "), ("Disadvantages", "disadvantage", 2, "; "),
]
