"""Rule tables used to label fragments; callers may pass their own."""

from __future__ import annotations

Rules = tuple[tuple[str, tuple[str, ...]], ...]

# Tag rules, in output order (tag, needles).
DEFAULT_TAG_RULES: Rules = (
    ("second-brain", ("第二大腦", "second brain", "second-brain")),
    ("ai-memory", ("ai memory", "記憶", "memory", "長期脈絡")),
    ("local-first", ("本地", "local", "隱私", "privacy")),
    ("slime-mold", ("黏菌", "slime", "路徑加粗", "沉降", "衰退")),
    ("inspiration", ("靈感", "創意", "發散", "神之一手", "breakthrough")),
    ("go", ("圍棋", "神之一手")),
    ("poc", ("poc", "原型", "最小", "mvp")),
    ("codex", ("codex", "codex exec")),
    ("claude", ("claude", "claude code")),
    ("jsonl", ("jsonl", "json")),
    ("embedding", ("embedding", "向量")),
)

# Kind rules, first match wins (kind, needles).
DEFAULT_KIND_RULES: Rules = (
    ("objection", ("風險", "危險", "打槍", "反對", "不行", "不能", "問題是", "risk", "flaw", "however")),
    ("decision", ("決定", "結論", "所以我會", "先做", "不要做", "cut", "decide")),
    ("question", ("?", "？", "怎麼", "如何", "為什麼", "what if", "how do")),
    ("idea", ("我想", "想法", "可以做", "能不能", "maybe", "idea", "could")),
    ("analogy", ("像", "類比", "比喻", "圍棋", "神之一手", "黏菌")),
    ("preference", ("我喜歡", "我不想", "偏好", "不要", "prefer")),
)

# Labels a model output may carry.
SIGNAL_KINDS = (
    "idea", "objection", "decision", "question", "analogy",
    "preference", "taste", "framework", "bug_memory", "note",
)
SIGNAL_ROUTES = (
    "debug", "product", "preference", "idea", "decision",
    "research", "writing", "ops", "other",
)
KIND_ROUTES = {
    "bug_memory": "debug",
    "taste": "preference",
    "preference": "preference",
    "decision": "decision",
    "question": "research",
    "framework": "decision",
    "idea": "idea",
}
PLACEHOLDER_NOISE = (
    "無", "无", "none", "null", "n/a", "沒有", "没有", "寒暄、工具噪音、一次性進度",
)
PLACEHOLDER_NOISE_PARTS = ("該丟掉的字", "该丢掉的字")

# Feedback statuses and the activation each positive one adds.
POSITIVE_FEEDBACK = {"selected": 0.14, "useful": 0.18, "applied": 0.28}
NEGATIVE_FEEDBACK = ("boring", "wrong")
NEUTRAL_FEEDBACK = ("ignored",)
FEEDBACK_STATUSES = (*POSITIVE_FEEDBACK, *NEGATIVE_FEEDBACK, *NEUTRAL_FEEDBACK)

# Which kinds and tags decide a note's type.
DECISION_KINDS = ("decision", "question")
FRICTION_KINDS = ("objection", "bug", "friction")
FRICTION_TAGS = ("friction", "bug", "state-machine", "debug")
NOTE_TITLES = {
    "concept_note": "Concept note",
    "decision_note": "Decision note",
    "friction_note": "Friction note",
}

# Source files that may be read, and path parts that may not.
CHAT_SUFFIXES = (".json", ".jsonl")
NOTE_SUFFIXES = (".md", ".markdown", ".txt")
DENIED_PATH_PARTS = (
    "auth", "credential", "credentials", "gcp-oauth", "token", "secret",
    "setting", "settings", "config", "log", "cache",
)
