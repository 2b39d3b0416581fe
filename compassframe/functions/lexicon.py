"""Fixed values of the prompt profiler: term lists, weights, patterns and priorities."""

from __future__ import annotations

# Task family -> (term, weight).
TASK_TERMS: dict[str, list[tuple[str, float]]] = {
    "code": [
        ("debug", 2.0), ("refactor", 2.0), ("source code", 2.0), ("code review", 2.0),
        ("unit test", 1.8), ("repository", 1.5), ("python", 1.5), ("javascript", 1.5),
        ("typescript", 1.5), ("rust", 1.5), ("sql", 1.5), ("function", 1.0),
        ("algorithm", 1.0), ("api", 0.8),
    ],
    "reasoning": [
        ("prove", 2.0), ("derive", 2.0), ("show that", 1.5), ("calculate", 1.4),
        ("equation", 1.4), ("theorem", 1.7), ("mathematical", 1.4), ("logic puzzle", 1.8),
        ("optimize", 1.2), ("constraint satisfaction", 1.8), ("step by step", 1.0),
    ],
    "research": [
        ("research", 1.8), ("primary sources", 2.0), ("cite sources", 2.0),
        ("literature review", 2.0), ("systematic review", 2.0), ("compare evidence", 1.8),
        ("market analysis", 1.5), ("current evidence", 1.5), ("latest", 1.0),
        ("bibliography", 1.5),
    ],
    "writing": [
        ("draft", 1.7), ("rewrite", 1.7), ("compose", 1.5), ("write", 1.0), ("tone", 1.2),
        ("story", 1.5), ("email", 1.4), ("article", 1.2), ("cover letter", 1.8),
        ("creative", 1.2), ("proofread", 1.5),
    ],
    "summarization": [
        ("summarize", 2.0), ("summary", 1.8), ("key points", 1.6), ("tldr", 2.0),
        ("condense", 1.8), ("executive brief", 1.6), ("synopsis", 1.6),
    ],
    "extraction": [
        ("extract", 2.0), ("classify", 1.5), ("parse", 1.5), ("entities", 1.5),
        ("sentiment", 1.4), ("structured data", 1.7), ("json schema", 1.8),
        ("return json", 1.6), ("table of", 1.2), ("fields", 0.8),
    ],
    "agent": [
        ("agent", 1.7), ("use tools", 1.8), ("browse", 1.5), ("browser", 1.5),
        ("search the web", 1.8), ("computer use", 2.0), ("workflow", 1.4),
        ("multi-step action", 1.8), ("autonomous", 1.5), ("function call", 1.5),
    ],
}

# Capability -> terms.
CAPABILITY_TERMS: dict[str, list[str]] = {
    "vision": ["image", "screenshot", "photo", "diagram", "chart", "visual"],
    "audio": ["audio", "speech", "voice recording", "transcribe", "podcast"],
    "tools": ["use tools", "browser", "browse", "search the web", "computer use",
              "function call", "execute"],
    "structured_output": ["json", "json schema", "xml", "csv", "structured output",
                          "machine readable"],
    "code": ["code", "python", "javascript", "typescript", "rust", "sql", "debug", "repository"],
    "reasoning": ["prove", "derive", "reason", "calculate", "theorem", "logic puzzle",
                  "step by step"],
}

# Task families from most to least specific; ties go to the earlier one.
TASK_PRIORITY = ["agent", "code", "reasoning", "research", "extraction", "summarization", "writing"]

# Verbs that count as operations, and substrings that mark a hard prompt.
OPERATION_VERBS = ["analyze", "compare", "create", "debug", "design", "evaluate", "explain",
                   "extract", "implement", "prove", "research", "review", "summarize", "verify",
                   "write"]
HARD_MARKERS = ["architecture", "edge case", "production", "rigorous", "security", "trade-off",
                "validate", "verify", "multiple constraints", "step by step"]

# Word and space classes spelled out, so that the JVM and any other engine agree on them.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
EDGE_L = rf"(?<![{WORD}])"
EDGE_R = rf"(?![{WORD}])"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Words that negate a following term within three words of the same clause.
NEGATORS = (rf"(?:no|not|never|without|avoid|skip|disable|exclude|do[{SPACE}]+not|don['’]t)")
NEGATED_TAIL = rf"(?iu){NEGATORS}(?:[^{WORD}]+[{WORD}]+){{0,3}}[^{WORD}]*$"
CLAUSE_BREAKS = r".,;:!?\n"
NEGATION_WINDOW = 48

# Sensitive-content flags in reporting order.
PRIVACY_PATTERNS: list[tuple[str, str]] = [
    ("api_key_like", rf"(?iu){EDGE_L}(?:sk|key|token)[-_][A-Za-z0-9_-]{{12,}}{EDGE}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("email", rf"(?iu){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE_R}"),
    ("aws_access_key", rf"{EDGE_L}(?:AKIA|ASIA)[A-Z0-9]{{16}}{EDGE_R}"),
    ("github_token", rf"{EDGE_L}gh[pousr]_[A-Za-z0-9]{{20,}}{EDGE_R}"),
    ("bearer_token", rf"(?iu){EDGE_L}Bearer[{SPACE}]+[A-Za-z0-9._~+/-]{{20,}}=*{EDGE}"),
    ("us_ssn_like", rf"{EDGE_L}\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{EDGE_R}"),
]
# Cheap necessary conditions: any one of the literals, looked for in the lower-cased text.
PRIVACY_LITERALS: dict[str, list[str]] = {
    "api_key_like": ["sk-", "sk_", "key-", "key_", "token-", "token_"],
    "private_key": ["private key-----"],
    "email": ["@"],
    "aws_access_key": ["akia", "asia"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "bearer_token": ["bearer"],
    "us_ssn_like": ["-"],
}

# Token estimate.
CODE_LIKE = rf"```|{EDGE_L}(?:def|class|function|SELECT|FROM|import){EDGE_R}"
CODE_LITERALS = ["def", "class", "function", "SELECT", "FROM", "import"]
PUNCTUATION = "{}[]();:=<>/\\"


def all_terms() -> list[str]:
    """Every distinct term the profiler has to find, in first-seen order."""
    seen: dict[str, None] = {}
    for terms in TASK_TERMS.values():
        seen.update((t, None) for t, _ in terms)
    for names in CAPABILITY_TERMS.values():
        seen.update((t, None) for t in names)
    seen.update((t, None) for t in OPERATION_VERBS)
    return list(seen)


def term_entries() -> dict[str, list[dict]]:
    """For each term, all lexicon rows that a hit on it counts for.

    A hit on a longer term is also a hit on every term that is a leading part of it
    ("json schema" starts with "json"), so those rows are listed under the longer term too.
    """
    rows: dict[str, list[dict]] = {t: [] for t in all_terms()}
    for label, terms in TASK_TERMS.items():
        for rank, (term, weight) in enumerate(terms):
            rows[term].append({"kind": "task", "label": label, "rank": rank, "weight": weight})
    for label, names in CAPABILITY_TERMS.items():
        for rank, term in enumerate(names):
            rows[term].append({"kind": "capability", "label": label, "rank": rank, "weight": 0.0})
    for rank, term in enumerate(OPERATION_VERBS):
        rows[term].append({"kind": "verb", "label": term, "rank": rank, "weight": 0.0})
    out = {}
    for term in rows:
        leading = [u for u in rows if u != term and term.startswith((u + " ", u + "-"))]
        out[term] = rows[term] + [r for u in leading for r in rows[u]]
    return out
