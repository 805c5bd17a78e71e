"""Levels, weights, thresholds and phrase lists."""

from __future__ import annotations

#: Levels and the reading ease that each aims at.
TARGETS = {"beginner": 63.0, "intermediate": 45.0, "advanced": 26.0}
LEVELS = tuple(TARGETS)
#: Weights of the parts of the total reward.
WEIGHTS = {"fmt": 0.15, "diff": 0.20, "term": 0.15, "copy": 0.25, "faith": 0.25}
PARTS = tuple(WEIGHTS)
JUDGE_GOOD = 3.5
AUTO_GOOD = 0.80
CONFIDENCE_BINS = 5
GATE = {"faith": 0.35, "diff": 0.40, "term": 0.5, "fmt": 0.7}
MIN_RANK_CELLS = 20
MIN_GAP_CELLS = 30
DIMS = ("difficulty", "meaning", "terminology", "fluency", "overall")
SEED = 42
BOOTSTRAP_SEED = 20260911

# Phrases that betray a reasoning preamble.
THINK_MARKERS = ["thinking process", "analyze the request", "thought process", "let me think", "思考过程", "分析需求", "here's a thinking", "<think"]

# Phrases of talk about the rewrite.
META_PHRASES = [
    "this rewrite", "this version", "this simplified", "this explanation", "in summary", "to summarize", "in conclusion", "as requested", "i hope this", "hope this helps",
    "i have rewritten", "i've rewritten", "the above", "this is a simplified", "this keeps the main ideas", "it simplifies", "the original legal text", "i have simplified",
    "here is", "below is", "this passage", "i tried", "let me know", "the user wants", "i need to", "i must", "i should", "i will structure", "the text covers", "the source text",
    "the provided text", "the input text", "reading difficulty", "reading level", "reading ease", "previous attempt", "the legal terms", "legal terms like", "let me structure", "drafting plan",
    "the rules are", "the goal is", "the target is", "i'm going to", "i am going to", "i plan to", "i understand", "the instruction says", "the retrieved", "key elements",
    "the following legal text", "here's my", "drafting", "analysis", "the source material", "original text", "key points", "overview", "the rules cover", "previous version", "the following are", "please note",
]

# Phrases that make the first 150 characters of a block commentary.
LEAD_PHRASES = [
    "the user wants", "this is a legal text rewriting task", "i need to", "i must", "i will", "i should", "i would", "let me", "the source text", "the provided text", "the input text", "reading difficulty",
    "reading level", "reading ease", "previous attempt", "the legal terms", "legal terms like", "i have rewritten", "this rewrite", "my goal", "my rewrite", "the target is", "the goal is", "i'm going to",
    "i am going to", "i plan to", "i understand", "drafting plan", "the instruction says", "the following legal text", "here's my", "here is my", "below is my", "^drafting", "^analysis", "^overview",
    "^summary", "the source material", "original text analysis",
]
# Words that may stand alone on a label line.
LABELS = ["drafting", "analysis", "overview", "summary", "notes?", "comments?", "rewritten", "simplified (?:version|text)", "the rewrite", "output", "result", "response"]

# Legal phrases and their plain forms.
PLAIN_WORDS = [
    ("pursuant to", "under"), ("in accordance with", "under"), ("prior to", "before"), ("notwithstanding", "despite"), ("provided that", "but"), ("whereby", "in which"),
    ("hereinafter", "later in this text"), ("hereunder", "under this"), ("aforesaid", "mentioned earlier"), ("in the event that", "if"), ("for the purpose of", "to"), ("without prejudice to", "without affecting"),
]
# Clause breaks in the order in which they are tried.
CLAUSE_BREAKS = [";", ", and ", ", but ", " provided that ", " unless ", " where ", " whereas ", ", which ", " in order to "]
#: Words of a clause, and clauses of a sentence, by level of the rule baseline.
CLAUSE_WORDS = {"beginner": 12, "intermediate": 18, "advanced": 26}
CLAUSES_JOINED = {"beginner": 1, "intermediate": 2, "advanced": 3}

# Boilerplate at the head of a judgment (flags inline).
HEADER_PATTERN = r"(?im)(Equivalent citations|IN THE SUPREME COURT OF INDIA|IN THE HIGH COURT OF|The Hon.?ble|CORAM|Bench:|^AIR \d{4}|^Reportable|^JUDGMENT|^ORDER|^Appeal .* against|^Petitioner|^Respondent|^Counsel|^Advocate|^For .*:|^MANU/)"

# Notes of the quality gate.
GATE_NOTES = {
    "faith": "FIDELITY: keep every legal rule of the source as it is; add and drop nothing.",
    "hard": "DIFFICULTY: still too hard; use shorter sentences and everyday words.",
    "easy": "DIFFICULTY: still too easy; keep more precise legal wording.",
    "term": "TERMS: keep these legal terms: ",
    "fmt": "FORMAT: give only the rewrite.",
}

#: The system whose rewrites the others are compared with.
REFERENCE = "tuned"
