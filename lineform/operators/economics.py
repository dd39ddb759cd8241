"""Costs of usage and of batches, and break-even sizes, as exact decimal columns.

Prices are given by the million, so tokens times price is an amount in millionths (micro-units) without a division.
A missing price or count gives a state instead of an amount; it is never taken for 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("input", "cache_read", "cache_write", "output")
AMOUNT = "decimal(38,8)"
_PRICE, _COUNT = "decimal(18,8)", "decimal(19,0)"


def _times(tokens: Column, price: Column) -> Column:
    return (tokens.cast(_COUNT) * price.cast(_PRICE)).cast(AMOUNT)


def usage_cost(tokens: dict[str, Column], prices: dict[str, Column], reasoning: Column, included: Column, other: Column | None = None) -> Column:
    """struct(state, by category, reasoning, other, total) of one use; categories don't overlap.

    state: ok, price_missing, usage_missing, or invalid (more reasoning within the output than output). Reasoning
    that the output includes isn't charged again; other is an amount in micro-units. Amounts are null unless ok.
    """
    none = F.lit(None)
    state, parts = none.cast("string"), {}
    for c in CATEGORIES:
        n, p = tokens.get(c, none).cast(_COUNT), prices.get(c, none).cast(_PRICE)
        idle = F.coalesce(n, F.lit(0)) == 0
        state = F.coalesce(state, F.when(p.isNull() & ~idle, "price_missing").when(p.isNotNull() & n.isNull(), "usage_missing"))
        parts[c] = F.when(p.isNull(), F.lit(0)).otherwise(_times(n, p)).cast(AMOUNT)
    output, p_out = tokens.get("output", none).cast(_COUNT), prices.get("output", none).cast(_PRICE)
    thought = F.coalesce(reasoning.cast(_COUNT), F.lit(0))
    state = F.coalesce(
        state,
        F.when(included & (reasoning > output), "invalid")
        .when(~included & reasoning.isNull(), "usage_missing")
        .when(~included & (thought > 0) & p_out.isNull(), "price_missing")
        .when(included.isNull() & (thought > 0), "usage_missing"),
        F.lit("ok"),
    )
    parts["reasoning"] = F.when(~included & (thought > 0), _times(reasoning, p_out)).otherwise(0).cast(AMOUNT)
    parts["other"] = F.coalesce(other if other is not None else none, F.lit(0)).cast(AMOUNT)
    total = sum(parts.values(), F.lit(0).cast(AMOUNT)).cast(AMOUNT)
    ok = state == "ok"
    return F.struct(state.alias("state"), *(F.when(ok, v).alias(k) for k, v in parts.items()), F.when(ok, total).alias("total"))


def _needed(tokens: Column, price: Column) -> Column:
    """Tokens times price; 0 without tokens, null if a price is needed and missing."""
    return F.when(tokens == 0, F.lit(0)).otherwise(tokens.cast(AMOUNT) * price.cast(_PRICE)).cast(AMOUNT)


def batch_cost(k: Column, instruction: Column, each_in: Column, each_out: Column, closing: Column, retries: Column, retried_output: Column, instruction_price: Column, in_price: Column, out_price: Column) -> Column:
    """struct(input, output, retries, total) in micro-units of a batch of k records.

    input: the instruction once and each_in by record; output: each_out by record and closing once; retries:
    that many times the input and the given share of the output.
    """
    given = (_needed(instruction, instruction_price) + _needed(k * each_in, in_price)).cast(AMOUNT)
    made = _needed(each_out * k + closing, out_price)
    again = (retries.cast("decimal(18,6)") * (given + (retried_output.cast("decimal(18,6)") * made).cast(AMOUNT)).cast(AMOUNT)).cast(AMOUNT)
    return F.struct(given.alias("input"), made.alias("output"), again.alias("retries"), (given + made + again).cast(AMOUNT).alias("total"))


def break_even(base_fixed: Column, base_each: Column, fixed: Column, each: Column) -> Column:
    """struct(state, k_min, k_max): for which batch sizes from 1 the second line costs strictly less than the base.

    state: always, from (k_min), until (k_max) or never. Quotients are whole-number divisions, so no size is off by rounding.
    """
    unit = lambda x: (x.cast("decimal(28,8)") * F.lit(100_000_000)).cast("decimal(38,0)")
    b, a = unit(base_fixed) - unit(fixed), unit(base_each) - unit(each)
    saves = a + b > 0
    state = F.when(a.isNull() | b.isNull(), None).when((a >= 0) & saves & ((a > 0) | (b > 0)), "always").when(a > 0, "from").when((a < 0) & saves, "until").otherwise("never")
    div = lambda x, y: F.call_function("div", x, F.when(y > 0, y))
    low = F.when(state == "from", div(-b, a) + 1).when(state.isin("always", "until"), F.lit(1).cast("long"))
    return F.struct(state.alias("state"), low.alias("k_min"), F.when(state == "until", div(b - 1, -a)).alias("k_max"))


def cost_per_thousand(total: Column, valid: Column) -> Column:
    """struct(state, cost, incurred) in micro-units: undefined, with what was spent, where there is no valid record."""
    known = total.isNotNull() & valid.isNotNull() & (valid > 0)
    return F.struct(F.when(known, "ok").otherwise("undefined").alias("state"), F.when(known, (total.cast("decimal(28,8)") * 1000 / valid.cast("decimal(19,0)")).cast("decimal(38,6)")).alias("cost"), total.alias("incurred"))


def declared_value(group: str, request: str, value: str) -> Column:
    """struct(value, consistent) of a group of requests: the original's value (request equals group) wins; else all that declare one have to agree."""
    own = F.max(F.when(F.col(request) == F.col(group), F.struct(F.lit(True).alias("there"), F.col(value).alias("v"))))
    low, high = F.min(value), F.max(value)
    return F.when(own["there"], F.struct(own["v"].alias("value"), F.lit(True).alias("consistent"))).otherwise(F.struct(F.when(low == high, low).alias("value"), F.coalesce(low == high, F.lit(True)).alias("consistent")))


def budget_capacity(budget: Column, batch: Column, valid_each: Column) -> Column:
    """struct(batches, records): whole batches that a budget pays for, and their valid records; null where a batch's cost is unknown or 0."""
    whole = F.when(batch > 0, F.call_function("div", budget.cast("decimal(38,0)"), batch.cast("decimal(38,0)")))
    return F.struct(whole.alias("batches"), F.floor(whole * valid_each).alias("records"))


def projected_saving(reference: Column, ratio: Column, price: Column) -> Column:
    """struct(base, other, saving, share) in micro-units: what a reference number of output tokens costs, and the same work at the measured ratio of tokens."""
    base = (reference.cast("decimal(19,0)") * price.cast("decimal(18,8)")).cast("decimal(38,8)")
    other = (base * ratio.cast("decimal(18,8)")).cast("decimal(38,8)")
    return F.struct(base.alias("base"), other.alias("other"), (base - other).cast("decimal(38,8)").alias("saving"), F.when(base > 0, F.round((base - other) / base, 6).cast("double")).alias("share"))
