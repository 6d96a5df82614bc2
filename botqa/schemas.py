"""Enums, fixed values and Spark schemas.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(word lists, thresholds, prices).  Operators take these as keyword
parameters with these values as defaults, so callers can pass their own
dictionaries (the test queries do: the driver's invented prose matches none
of the defaults).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — enums
# ---------------------------------------------------------------------------
SYSTEM_TYPES = ["RAG", "CUSTOMER_SUPPORT", "MULTI_AGENT"]
FAILURE_TYPES = ["HALLUCINATION", "POLICY_VIOLATION", "INCOMPLETE", "WRONG_ANSWER",
                 "CONTEXT_LOSS", "ESCALATION_FAILURE"]
DIFFICULTIES = ["EASY", "MEDIUM", "HARD", "ADVERSARIAL"]
PRIORITIES = ["HIGH", "MEDIUM", "LOW"]
DEPLOYMENT_STATUSES = ["PRE_DEPLOYMENT", "POST_DEPLOYMENT"]
MATURITIES = ["NEW", "RUNNING", "RELIABLE"]
STRATEGIES = ["FROM_SCRATCH", "FROM_FAILURES", "ADVERSARIAL_FROM_CORRECT", "SMART_MIX"]
EVALUATION_METHODS = ["RULE_BASED", "LLM_JUDGE", "PROGRAMMATIC", "HYBRID"]
DOCUMENT_SOURCES = ["UPLOADED", "SCRAPED_COMPANY_SITE", "SCRAPED_EXTERNAL", "SYNTHETIC_CHALLENGING"]
FIX_TYPES = ["PROMPT_ADDITION", "GUARDRAIL_RULE", "FINE_TUNING_DATA", "ARCHITECTURE_CHANGE", "POLICY_CLARIFICATION"]

# ---------------------------------------------------------------------------
# FIXED VALUES — priorities (failure type -> default priority; unknown MEDIUM)
# ---------------------------------------------------------------------------
DEFAULT_FAILURE_PRIORITY = {
    "POLICY_VIOLATION": "HIGH",
    "ESCALATION_FAILURE": "HIGH",
    "HALLUCINATION": "HIGH",
    "WRONG_ANSWER": "MEDIUM",
    "INCOMPLETE": "MEDIUM",
    "CONTEXT_LOSS": "LOW",
}
PRIORITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}

# ---------------------------------------------------------------------------
# FIXED VALUES — judging
# ---------------------------------------------------------------------------
RULE_CONFIDENCE = 0.95
MIN_REPLY_CHARS = 5
REFUSAL_PHRASES = [
    "i cannot help",
    "i'm unable to assist",
    "i don't have access",
    "i cannot assist with that",
]
PANEL_UNANIMOUS_CONFIDENCE = 0.95
PANEL_MAJORITY_CONFIDENCE = 0.75
PANEL_WEAK_CONFIDENCE = 0.33
JUDGE_DEFAULT_CONFIDENCE = 0.75
BATCH_SIZE = 20

# judge pool: model, family, tier (tier order 1 = frontier, 2 = standard, 3 = light)
JUDGE_POOL = [
    ("prometheus-eval/prometheus-bgb-8x7b-v2.0", "specialized", "standard"),
    ("gpt-5", "openai", "frontier"),
    ("claude-sonnet-4-6", "anthropic", "standard"),
]
FIXED_FIRST_JUDGE = "prometheus-eval/prometheus-bgb-8x7b-v2.0"
TIER_ORDER = {"frontier": 1, "standard": 2, "light": 3}

# ---------------------------------------------------------------------------
# FIXED VALUES — cost model
# ---------------------------------------------------------------------------
PRICE_PER_1K_TOKENS = 0.003
TOKENS_PER_SCENARIO = 500
TOKENS_PER_JUDGE_CALL = 300
UI_COST_PER_SCENARIO = {"generation": 0.002, "judging": 0.007, "analysis": 0.001, "fixes": 0.002}

# ---------------------------------------------------------------------------
# FIXED VALUES — conversation insights
# ---------------------------------------------------------------------------
MIN_CONTENT_CHARS_EXCLUSIVE = 20
VOCAB_PUNCTUATION = ".,!?;:()[]{}\"'"
VOCAB_TOP_K = 50
STOP_WORDS = [
    "i", "me", "my", "the", "a", "an", "and", "or", "but",
    "in", "on", "at", "to", "for", "of", "with", "is", "was",
    "are", "were", "be", "been", "have", "has", "had", "do",
    "did", "will", "would", "could", "should", "this", "that",
    "it", "its", "we", "you", "your", "they", "their", "what",
    "how", "when", "where", "who", "which", "there", "here",
    "not", "no", "yes", "just", "so", "if", "about", "from",
    "get", "got", "can", "please", "hi", "hello", "hey",
    "thanks", "thank",
]
TOPIC_KEYWORDS = {
    "order_tracking": ["order", "tracking", "shipped", "delivery", "arrived",
                       "where", "status", "package", "parcel", "dispatch"],
    "returns_refunds": ["return", "refund", "money back", "send back",
                        "exchange", "wrong item", "damaged", "broken"],
    "billing_payments": ["charged", "charge", "payment", "invoice", "bill",
                         "price", "cost", "fee", "subscription", "overcharged"],
    "account_access": ["login", "password", "account", "access", "locked",
                       "reset", "email", "sign in", "username"],
    "product_questions": ["product", "item", "size", "color", "available",
                          "stock", "specification", "compatible", "works with"],
    "delivery_issues": ["late", "delayed", "missing", "lost", "wrong address",
                        "not delivered", "driver", "courier", "reschedule"],
    "complaints": ["terrible", "awful", "worst", "disappointed",
                   "unacceptable", "horrible", "complaint", "disgusting"],
    "cancellations": ["cancel", "cancellation", "stop", "end subscription",
                      "unsubscribe", "close account"],
    "technical_support": ["error", "bug", "not working", "broken", "crash",
                          "issue", "problem", "glitch", "fix"],
    "escalation_requests": ["manager", "supervisor", "escalate", "complaint",
                            "head office", "ceo", "legal", "lawyer"],
}
INFORMAL_MARKERS = [
    "dont", "cant", "wont", "gonna", "wanna", "gotta",
    "kinda", "sorta", "ya", "ur", "u ", "plz", "pls", "omg",
    "ngl", "tbh", "lol", "lmao",
]
# tones are tried in this order; the first one with a keyword hit wins
TONE_KEYWORDS = {
    "frustrated": ["frustrated", "annoyed", "ridiculous", "unacceptable",
                   "terrible", "awful", "worst", "hate", "disgusting",
                   "??", "!!!", "why is this"],
    "urgent": ["urgent", "asap", "immediately", "right now", "today",
               "emergency", "critical", "must", "need now", "please hurry"],
    "confused": ["confused", "don't understand", "not sure", "unclear",
                 "what does", "how do", "what is", "help me understand",
                 "lost", "unsure"],
    "angry": ["angry", "furious", "livid", "outraged", "demand",
              "unacceptable", "lawsuit", "lawyer", "dispute",
              "report you", "manager"],
    "positive": ["thank", "appreciate", "great", "wonderful", "amazing",
                 "helpful", "love", "perfect", "excellent", "happy"],
}
FAILURE_OUTCOME_WORDS = ["bad", "wrong", "fail", "incorrect", "violation", "error"]
SUCCESS_OUTCOME_WORDS = ["good", "success", "resolved", "correct", "positive"]
TRIGGERS_TOP_K = 20
PERSONA_HINTS_TOP_K = 10
# persona hint groups: each group is a list of (label, words); first label
# whose words hit is taken, at most one label per group; labels joined by "_"
PERSONA_HINT_GROUPS = [
    [("elderly_user", ["grandson", "granddaughter", "elderly", "senior", "years old", "retired"]),
     ("young_user", ["omg", "ngl", "tbh", "lol", "fr ", "bestie"])],
    [("formal", ["i am writing", "formally", "hereby", "pursuant", "aforementioned"]),
     ("informal", ["gonna", "wanna", "ur", "u ", "plz", "omg"])],
    [("urgent", ["urgent", "emergency", "asap", "right now", "today"]),
     ("frustrated", ["frustrated", "terrible", "worst", "ridiculous"])],
    [("business_user", ["business", "company", "invoice", "bulk", "enterprise"])],
]

# ---------------------------------------------------------------------------
# FIXED VALUES — analysis
# ---------------------------------------------------------------------------
MIN_FAILURES_FOR_CLUSTERING = 5
HDBSCAN_MIN_CLUSTER_SIZE = 3
HDBSCAN_MIN_SAMPLES = 2
PATTERN_EXAMPLES = 3
EXAMPLE_PREFIX_CHARS = 100
NOISE_ROOT_CAUSE = "Isolated {t} failures — unique cases"
NOISE_EVIDENCE = "{n} individual failures of this type"
NOISE_FIX = "Review individual cases — no common pattern detected"

# ---------------------------------------------------------------------------
# FIXED VALUES — grades and verdicts (dashboard)
# ---------------------------------------------------------------------------
GRADE_BANDS = [(90, "A", "Production Ready"), (80, "B", "Good"),
               (70, "C", "Needs Attention"), (60, "D", "At Risk")]
GRADE_FLOOR = ("F", "Critical")
DEPLOY_MIN_PASS_RATE = 0.8
DEPLOY_MAX_FAILURES = 10

# ---------------------------------------------------------------------------
# Spark schemas of the entity tables
# ---------------------------------------------------------------------------
VERDICT_SCHEMA = T.StructType([
    T.StructField("scenario_id", T.LongType()),
    T.StructField("slot", T.IntegerType()),
    T.StructField("judge_model", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("failure_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

JUDGE_REPLY_SCHEMA = T.StructType([
    T.StructField("passed", T.BooleanType()),
    T.StructField("failure_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("criteria_results", T.MapType(T.StringType(), T.BooleanType())),
])

# ---------------------------------------------------------------------------
# FIXED VALUES — fixes (default titles, disclaimers, fine-tuning fix text)
# ---------------------------------------------------------------------------
FIX_DEFAULT_TITLE = {
    "PROMPT_ADDITION": "Prompt improvement suggestion",
    "GUARDRAIL_RULE": "Guardrail rule suggestion",
    "ARCHITECTURE_CHANGE": "Architecture improvement",
    "POLICY_CLARIFICATION": "Policy clarification needed",
}
FIX_DISCLAIMER = {
    "PROMPT_ADDITION": ("This is a suggested prompt addition based on observed failures. Review and adapt "
                        "to your actual system prompt before implementing. This may not be exactly correct "
                        "for your specific setup."),
    "GUARDRAIL_RULE": ("This guardrail suggestion is based on observed failure patterns. Adapt the specific "
                       "conditions and thresholds to match your actual system architecture."),
    "ARCHITECTURE_CHANGE": ("This architectural suggestion is based on observed retrieval failures. Review "
                            "with your engineering team before implementing structural changes."),
    "POLICY_CLARIFICATION": ("This suggestion is based on observed policy-related failures. Review with your "
                             "policy and compliance teams before making changes."),
    "FINE_TUNING_DATA": ("Fine-tuning is recommended only for open-source models you control. Review all "
                         "training pairs before use. Results depend on your model architecture and training setup."),
}
FINE_TUNING_PROBLEM = ("Your AI system made specific mistakes that can be corrected through targeted "
                       "fine-tuning.")
FINE_TUNING_STEPS = [
    "Download the JSONL training data from {product}",
    "Review pairs to confirm correct outputs are appropriate",
    "Fine-tune your model using standard SFT training",
    "Re-run {product} to verify improvement",
    "Repeat until pass rate reaches target",
]
FINE_TUNING_CHECKS = [
    "Run {product} again after fine-tuning",
    "Check if previously failing scenarios now pass",
]
NO_FAILURES_ESTIMATE = "No failures detected — system performing well"

# Name under which reports are issued; callers give their own.
PRODUCT = "Quality Monitor"
