"""Costs of model calls and what a report tells of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import token_cost

_COST = "struct<input_cost:decimal(18,10),output_cost:decimal(18,10),total_cost:decimal(19,10),currency:string,status:string>"


def _cost(first: Column, second: Column, total: Column, currency: Column, status: str) -> Column:
    return F.struct(first.alias("input_cost"), second.alias("output_cost"), total.alias("total_cost"), currency.alias("currency"), F.lit(status).alias("status")).cast(_COST)


def call_cost(reported: Column, reported_currency: Column, mode: Column, input_price: Column, output_price: Column, currency: Column, prompt: Column, completion: Column) -> Column:
    """(input_cost, output_cost, total_cost, currency, status) of a call: what the provider reported, else an estimate by tokens, else unknown.

    Estimates need prices a million tokens, a currency, both token counts, none negative, and the mode per_token; each side is
    rounded by itself, half up, to ten places, before the two are added.
    """
    none = F.lit(None)
    first, second = token_cost(prompt, F.when(input_price >= 0, input_price)), token_cost(completion, F.when(output_price >= 0, output_price))
    known = (mode == "per_token") & first.isNotNull() & second.isNotNull() & (F.coalesce(currency, F.lit("")) != "")
    return F.when(reported.isNotNull(), _cost(none, none, reported, reported_currency, "reported")).when(known, _cost(first, second, first + second, currency, "estimated")).otherwise(_cost(none, none, none, none, "unknown"))


def usage_report(log_id: Column, tokens: Column, cost: Column) -> Column:
    """(llm_calls, usage_log_ids, llm_tokens, llm_cost_amount, llm_cost_currency, llm_cost_status) of one call, cost being call_cost(); the amount is text, so that nothing is lost. A call of which nothing was recorded (cost null) counts as one of unknown cost."""
    return F.struct(
        F.lit(1).alias("llm_calls"),
        F.filter(F.array(log_id), lambda x: x.isNotNull()).alias("usage_log_ids"),
        tokens.alias("llm_tokens"),
        cost["total_cost"].cast("string").alias("llm_cost_amount"),
        cost["currency"].alias("llm_cost_currency"),
        F.coalesce(cost["status"], F.lit("unknown")).alias("llm_cost_status"),
    )
