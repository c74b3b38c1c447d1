"""Token estimates and money."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptlake.config import Config
from promptlake.functions.text import _col, predict_output_tokens
from promptlake.rules import Rules

_CONFIG = Config()
_RULES = Rules()
UNITS = 100_000_000  # money is summed in integer units of 1e-8 USD


def estimate_tokens(text="query_text") -> Column:
    """A quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(_col(text)) / 4).cast("int"))


def token_limit(predicted="predicted_max", factor: float = 1.5) -> Column:
    """Where a streamed answer is cut."""
    return F.floor(_col(predicted) * F.lit(factor)).cast("int")


def cost_usd(tokens_in, tokens_out, cfg: Config = _CONFIG) -> Column:
    """Price of a call, rounded half-even to eight places."""
    return F.bround(
        _col(tokens_in) / F.lit(1000.0) * F.lit(cfg.price_in_1k)
        + _col(tokens_out) / F.lit(1000.0) * F.lit(cfg.price_out_1k), 8)


def to_units(cost) -> Column:
    """USD as an integer number of 1e-8 USD, which sums without drift."""
    return F.round(_col(cost) * F.lit(float(UNITS))).cast("bigint")


def to_usd(units) -> Column:
    """Integer units back to USD."""
    return _col(units) / F.lit(float(UNITS))


def cost_saved(text="query_text", cfg: Config = _CONFIG, rules: Rules = _RULES) -> Column:
    """What a cache hit saves: estimated input and predicted output of the raw text."""
    return cost_usd(estimate_tokens(text), predict_output_tokens(text, rules), cfg)


def billed_input_tokens(measured="prompt_tokens", messages="messages") -> Column:
    """Measured input tokens, else the estimate over all contents joined by a space."""
    contents = F.array_join(F.transform(_col(messages), lambda m: m["content"]), " ")
    return F.coalesce(_col(measured).cast("int"), estimate_tokens(contents))


def billed_output_tokens(measured="completion_tokens", content="content") -> Column:
    """Measured output tokens, else the estimate over the answer."""
    return F.coalesce(_col(measured).cast("int"), estimate_tokens(content))


def estimated_input_tokens(text="query_text", normalized="normalized", embedded="l2_used") -> Column:
    """Input estimate without a backend: normalized text if it was embedded, else the raw text."""
    return estimate_tokens(F.when(_col(embedded), _col(normalized)).otherwise(_col(text)))


def resolved_model(requested="model", default: str = "") -> Column:
    """The backend's own model if one is set, else the requested one."""
    return F.coalesce(F.nullif(F.lit(default), F.lit("")), _col(requested))


def fmt_ms(x) -> Column:
    return F.bround(_col(x), 2)


def fmt_sim(x) -> Column:
    return F.bround(_col(x), 4)


def fmt_pct(x) -> Column:
    return F.bround(_col(x), 1)
