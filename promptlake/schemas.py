"""Explicit schemas of the tables this package reads and writes."""

MESSAGES = "array<struct<role:string,content:string>>"

OPENAI_REQUEST = (
    f"request_id string, ts timestamp, user_id string, model string, stream boolean, "
    f"messages {MESSAGES}, _corrupt_record string")

OLLAMA_CHAT_REQUEST = (
    f"request_id string, ts timestamp, model string, messages {MESSAGES}, stream boolean, "
    f"options map<string,string>, user_id string, _corrupt_record string")

OLLAMA_GENERATE_REQUEST = (
    "request_id string, ts timestamp, model string, prompt string, stream boolean, "
    "options map<string,string>, user_id string, _corrupt_record string")

GATEWAY_EVENT = (
    "request_id string, event string, tier string, similarity double, latency_ms double, "
    "model string, user_id string, llm_mode string, messages_count int, tokens_used int, "
    "cost_usd double, _corrupt_record string")

STREAM_CHUNK = "content string, done boolean, truncated boolean, error string, _corrupt_record string"

EVAL_PAIR = "original string, paraphrase string, expected_hit boolean, category string"

WORKLOAD = "idx int, question string, is_duplicate boolean, original_idx int"

BENCH_RESULT = WORKLOAD + ", cached boolean, latency_ms double, content_len int, error string"
