"""Rule tables: term map, keyword sets, query classes, prices, service levels, load stages.

The defaults below are plain values; every one of them can be replaced by a table of the
user's own through :func:`load_rules`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------
# Fixed values. They must equal the reference's for results to match.
# ---------------------------------------------------------------------------------------

TERM_MAP = {
    "linked list": "연결 리스트",
    "binary tree": "이진 트리",
    "hash table": "해시 테이블",
    "priority queue": "우선순위 큐",
    "dictionary": "딕셔너리",
    "list": "리스트",
    "tuple": "튜플",
    "dict": "딕셔너리",
    "array": "배열",
    "stack": "스택",
    "queue": "큐",
    "heap": "힙",
    "tree": "트리",
    "graph": "그래프",
    "string": "문자열",
    "boolean": "불리언",
    "machine learning": "머신러닝",
    "deep learning": "딥러닝",
    "overfitting": "오버피팅",
    "underfitting": "언더피팅",
    "neural network": "신경망",
    "gradient descent": "경사 하강법",
    "sorting": "정렬",
    "searching": "탐색",
    "recursion": "재귀",
    "dynamic programming": "동적 프로그래밍",
}

PROGRAMMING_WORDS = (
    "python", "파이썬", "py",
    "java", "자바",
    "javascript", "js", "자바스크립트",
    "typescript", "ts",
    "c++", "cpp", "c#", "csharp",
    "go", "golang",
    "rust", "러스트",
    "kotlin", "코틀린",
    "swift", "스위프트",
    "ruby", "루비",
    "php",
    "sql",
)

PROTOCOL_WORDS = (
    "tcp", "udp", "http", "https",
    "grpc", "websocket", "ws",
    "mqtt", "ftp", "smtp",
    "dns", "ssl", "tls",
)

# (class, predicted output tokens, trigger words), longest class first; the last is the default.
QUERY_CLASSES = (
    ("VERY_LONG", 1200, (
        "단계별", "방법", "튜토리얼", "가이드", "step by step",
        "how to", "tutorial", "guide", "절차", "과정",
    )),
    ("LONG", 800, (
        "구현해줘", "구현해", "코드", "작성해줘", "작성해", "만들어줘", "만들어",
        "implement", "code", "write", "짜줘", "짜", "개발해줘", "개발해",
        "함수", "클래스", "프로그램", "스크립트",
    )),
    ("MEDIUM", 400, (
        "설명해줘", "설명해", "차이점", "차이", "비교", "알려줘", "알려",
        "explain", "difference", "compare", "what is", "뭐야", "뭔가요",
        "무엇", "어떻게", "왜", "언제", "어디",
    )),
    ("SHORT", 150, ()),
)

# Upper bounds of the finite latency buckets, in seconds.
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

# (scenario, metric, comparison, bound): rates are fractions, durations are milliseconds.
SLO_RULES = (
    ("baseline", "error_rate", "<", 0.01),
    ("baseline", "p95_ms", "<", 2000.0),
    ("baseline", "p99_ms", "<", 5000.0),
    ("baseline", "compat_p95_ms", "<", 500.0),
    ("ramp", "error_rate", "<", 0.01),
    ("ramp", "p95_ms", "<", 2000.0),
    ("ramp", "p99_ms", "<", 5000.0),
    ("spike", "error_rate", "<", 0.05),
    ("spike", "server_error_rate", "<", 0.001),
    ("spike", "p95_ms", "<", 5000.0),
    ("soak", "error_rate", "<", 0.01),
    ("soak", "p95_ms", "<", 2000.0),
    ("soak", "p99_ms", "<", 5000.0),
)

# (scenario, stage, start second, end second, target users)
STAGES = (
    ("ramp", 1, 0, 60, 10),
    ("ramp", 2, 60, 180, 50),
    ("ramp", 3, 180, 300, 100),
    ("ramp", 4, 300, 360, 10),
    ("spike", 1, 0, 30, 10),
    ("spike", 2, 30, 60, 500),
    ("spike", 3, 60, 120, 500),
    ("spike", 4, 120, 150, 10),
    ("spike", 5, 150, 240, 10),
    ("soak", 1, 0, 300, 30),
    ("soak", 2, 300, 3300, 30),
    ("soak", 3, 3300, 3600, 0),
)

HIT_RATIO_LEVELS = (0.3, 0.5)

# ---------------------------------------------------------------------------------------

_WORD_EDGED = re.compile(r"[A-Za-z0-9_](?:.*[A-Za-z0-9_])?", re.S)


@dataclass(frozen=True)
class Rules:
    """Validated rule values. Small by contract, so expressions inline them as literals."""

    term_map: dict = field(default_factory=lambda: dict(TERM_MAP))
    keywords: dict = field(
        default_factory=lambda: {"language": PROGRAMMING_WORDS, "protocol": PROTOCOL_WORDS}
    )
    query_classes: tuple = QUERY_CLASSES
    slo: tuple = SLO_RULES
    stages: tuple = STAGES

    MAX_ENTRIES = 5000  # rule tables are typed in by people; larger input is a mistake

    def __post_init__(self):
        n = len(self.term_map) + sum(len(v) for v in self.keywords.values())
        n += sum(len(c[2]) for c in self.query_classes)
        if n > self.MAX_ENTRIES:
            raise ValueError(f"rule tables hold {n} entries, at most {self.MAX_ENTRIES} are allowed")
        for term in self.term_map:
            if term != term.lower() or not _WORD_EDGED.fullmatch(term):
                raise ValueError(f"term must be lower case and start and end with [a-z0-9_]: {term!r}")
        for words in self.keywords.values():
            if any(not w or w != w.lower() for w in words):
                raise ValueError("keywords must be non-empty and lower case")

    @property
    def tech_words(self) -> tuple:
        """All distinct keywords over the categories."""
        return tuple(dict.fromkeys(w for words in self.keywords.values() for w in words))


def rule_frames(spark: SparkSession, rules: Rules) -> dict[str, DataFrame]:
    """The rule values as small tables, in the layout that :func:`load_rules` reads back."""
    classes = [
        (i, name, word, predicted)
        for i, (name, predicted, words) in enumerate(rules.query_classes)
        for word in (words or (None,))
    ]
    return {
        "term_map": spark.createDataFrame(
            list(rules.term_map.items()), "term string, replacement string"),
        "keyword_set": spark.createDataFrame(
            [(c, w) for c, ws in rules.keywords.items() for w in ws],
            "category string, keyword string"),
        "query_type_rule": spark.createDataFrame(
            classes, "priority int, query_type string, keyword string, predicted_max int"),
        "slo_rules": spark.createDataFrame(
            list(rules.slo), "scenario string, metric string, op string, bound double"),
        "stages": spark.createDataFrame(
            list(rules.stages),
            "scenario string, stage int, start_s int, end_s int, target int"),
    }


def _rows(df: DataFrame) -> list:
    rows = df.limit(Rules.MAX_ENTRIES + 1).collect()
    if len(rows) > Rules.MAX_ENTRIES:
        raise ValueError("rule table is larger than a rule table can be")
    return rows


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Read rule tables written as JSON below ``path``; a missing table keeps its default."""
    def table(name):
        try:
            return _rows(spark.read.json(f"{path}/{name}"))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    args = {}
    if (rows := table("term_map")) is not None:
        args["term_map"] = {r["term"]: r["replacement"] for r in rows}
    if (rows := table("keyword_set")) is not None:
        words: dict = {}
        for r in rows:
            words.setdefault(r["category"], []).append(r["keyword"])
        args["keywords"] = {c: tuple(ws) for c, ws in words.items()}
    if (rows := table("query_type_rule")) is not None:
        classes: dict = {}
        for r in sorted(rows, key=lambda r: r["priority"]):
            entry = classes.setdefault((r["query_type"], r["predicted_max"]), [])
            if "keyword" in r and r["keyword"] is not None:
                entry.append(r["keyword"])
        args["query_classes"] = tuple((n, int(p), tuple(ws)) for (n, p), ws in classes.items())
    if (rows := table("slo_rules")) is not None:
        args["slo"] = tuple((r["scenario"], r["metric"], r["op"], float(r["bound"])) for r in rows)
    if (rows := table("stages")) is not None:
        args["stages"] = tuple(
            (r["scenario"], int(r["stage"]), int(r["start_s"]), int(r["end_s"]), int(r["target"]))
            for r in rows)
    return Rules(**args)
