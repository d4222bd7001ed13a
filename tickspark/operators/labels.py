"""Outcomes of candidates along the path that follows them: on bars by exit policy and cost scenario, and on ticks to the first barrier."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs, prices
from ..schemas import PIP
from . import extremes
from .sequence import as_of, interval_join, with_previous

POLICIES = ("FIXED_RR", "DYNAMIC_RR", "STRUCTURE_TARGET", "PARTIAL_TRAILING")
TARGETS = (1.0, 1.5, 2.0, 3.0)
GEOMETRY = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)


def bar_paths(candidates: DataFrame, base: DataFrame, horizon: int, keep: list[str] = []) -> DataFrame:
    """Candidate rows (with the columns ``keep``) beside each of the ``horizon`` bars, by count, from the one that starts at the candidate's time; without such a bar there is no path."""
    w = Window.partitionBy("symbol").orderBy("bar_start_ms")
    numbered = base.select("symbol", "bar_start_ms", "bar_end_ms", "bid_high", "bid_low", "bid_close", "ask_high", "ask_low", "ask_close").withColumn("no", F.row_number().over(w) - 1)
    starts = numbered.select("symbol", F.col("bar_start_ms").alias("available_ms"), F.col("no").alias("first_no"))
    ideas = candidates.select("candidate_id", "symbol", "direction", "entry", "stop_loss", "available_ms", "regime", "session", *keep).join(starts, ["symbol", "available_ms"]).withColumn("last_no", F.col("first_no") + horizon - 1)
    path = interval_join(ideas, numbered.withColumnRenamed("bar_end_ms", "path_end_ms").drop("bar_start_ms"), "first_no", "last_no", "no", horizon, horizon)
    long, risk = prices.is_long(), prices.planned_risk()
    fav = F.when(long, F.col("bid_high") - F.col("entry")).otherwise(F.col("entry") - F.col("ask_low")) / risk
    adv = F.when(long, F.col("bid_low") - F.col("entry")).otherwise(F.col("entry") - F.col("ask_high")) / risk
    return (
        path.withColumn("risk", risk)
        .withColumn("pos", F.col("no") - F.col("first_no") + 1)
        .withColumn("fav", fav)
        .withColumn("adv", adv)
        .withColumn("close_r", F.when(long, F.col("bid_close") - F.col("entry")).otherwise(F.col("entry") - F.col("ask_close")) / risk)
        .withColumn("stop", F.when(long, F.col("bid_low") <= F.col("stop_loss")).otherwise(F.col("ask_high") >= F.col("stop_loss")))
    )


def _reached(multiple: float) -> Column:
    price = prices.r_target(F.col("entry"), F.col("risk"), multiple, prices.is_long())
    return F.when(prices.is_long(), F.col("bid_high") >= price).otherwise(F.col("ask_low") <= price)


def bar_outcomes(candidates: DataFrame, base: DataFrame, buckets: DataFrame, horizon: int = 36, policies: tuple[str, ...] = POLICIES, scenarios=costs.SCENARIOS, pip: float = PIP) -> DataFrame:
    """A row per candidate, exit policy and cost scenario.

    The path of at most ``horizon`` bars becomes one small array per candidate and is read once; policies and scenarios only combine first-hit positions. A stop and a target in one bar
    count as a stop. A partial exit is armed by the first bar at 1R without a stop, that bar's other hits being ignored; a later stop still costs the full risk.
    A candidate that reaches no exit closes at the last bar and is charged the plain cost whatever the scenario.
    """
    ident = ["candidate_id", "symbol", "direction", "available_ms", "regime", "session", "risk"]
    hit = {m: f"hit_{i}" for i, m in enumerate(TARGETS)}
    path = bar_paths(candidates, base, horizon).withColumns({n: _reached(m) for m, n in hit.items()})
    steps = F.array_sort(F.collect_list(F.struct("pos", "fav", "adv", "close_r", "path_end_ms")))
    at = lambda flag: F.min(F.when(F.col(flag), F.col("pos")))
    per = path.groupBy(*ident).agg(steps.alias("steps"), at("stop").alias("p_stop"), *(at(n).alias(f"p_{n}") for n in hit.values()), F.collect_list(F.when(F.col(hit[3.0]), F.col("pos"))).alias("all_3"), F.collect_list(F.when(F.col(hit[1.0]), F.col("pos"))).alias("all_1"))
    with_trend = (F.col("regime") == "BULL") & prices.is_long() | (F.col("regime") == "BEAR") & ~prices.is_long()
    p = {m: F.col(f"p_{n}") for m, n in hit.items()}
    never = F.lit(1 << 30)
    stop = F.coalesce("p_stop", never)
    single = lambda t, r: F.struct(F.coalesce(t, never).alias("p_hit"), r.alias("reward"), F.lit(False).alias("armed"))
    later = F.coalesce(F.array_min(F.filter("all_3", lambda x: x > p[1.0])), never)
    partial = F.when(F.coalesce(p[1.0], never) >= stop, single(p[1.0], F.lit(2.0))).otherwise(F.struct(F.when(p[1.0].isNull(), never).otherwise(later).alias("p_hit"), F.lit(2.0).alias("reward"), p[1.0].isNotNull().alias("armed")))
    choice = {
        "FIXED_RR": single(p[3.0], F.lit(3.0)),
        "DYNAMIC_RR": F.when(with_trend, single(p[3.0], F.lit(3.0))).otherwise(single(p[1.5], F.lit(1.5))),
        "STRUCTURE_TARGET": single(p[2.0], F.lit(2.0)),
        "PARTIAL_TRAILING": partial,
    }
    listed = per.withColumn("policy", F.explode(F.array(*map(F.lit, policies)))).withColumn("c", F.coalesce(*(F.when(F.col("policy") == n, choice[n]) for n in policies)))
    ambiguous = F.when(F.col("c.armed"), F.array_contains("all_1", stop.cast("long"))).otherwise(F.col("c.p_hit") == stop)
    outcome = F.when((stop < never) & (stop <= F.col("c.p_hit")), F.when(ambiguous, "AMBIGUOUS_CONSERVATIVE_STOP").otherwise("STOP_LOSS")).when(F.col("c.p_hit") < never, "TAKE_PROFIT").otherwise("VERTICAL")
    exit_pos = F.when(F.col("outcome") == "VERTICAL", F.size("steps")).otherwise(F.least(stop, F.col("c.p_hit"))).cast("int")
    last = F.element_at("steps", F.col("holding_bars"))
    upto = F.slice("steps", 1, F.col("holding_bars"))
    judged = (
        listed.withColumn("outcome", outcome)
        .withColumn("holding_bars", exit_pos)
        .withColumn("gross_r", F.when(F.col("outcome") == "TAKE_PROFIT", F.col("c.reward")).when(F.col("outcome") == "VERTICAL", last["close_r"]).otherwise(-1.0))
        .withColumn("exit_ms", last["path_end_ms"])
        .withColumn("mfe_r", F.greatest(F.lit(0.0), F.array_max(F.transform(upto, lambda s: s["fav"]))))
        .withColumn("mae_r", F.least(F.lit(0.0), F.array_min(F.transform(upto, lambda s: s["adv"]))))
        .drop("steps", "c", "all_1", "all_3", "p_stop", *(f"p_{n}" for n in hit.values()))
    )
    priced = costs.with_bucket(judged, buckets).withColumn("__s", F.explode(costs.scenario_column(scenarios))).select("*", "__s.*").drop("__s")
    plain = F.col("outcome") == "VERTICAL"
    total = costs.cost_r(F.col("risk"), F.when(plain, "NORMAL").otherwise(F.col("cost_regime")), F.when(plain, 1.0).otherwise(F.col("multiplier")), F.col("gross_r") < 0, pip)["total_cost_r"]
    return priced.withColumn("cost_r", total).withColumn("net_r", F.col("gross_r") - F.col("cost_r")).select(*ident, "policy", "scenario", "outcome", "holding_bars", "exit_ms", "gross_r", "cost_r", "net_r", "mfe_r", "mae_r")


def outcome_geometry(candidates: DataFrame, base: DataFrame, horizon: int = 36, keys: list[str] = ["symbol"]) -> DataFrame:
    """Share of paths that touch each multiple before the stop, and ambiguous target bars per bar slot.

    A target first touched in a bar with a stop is ambiguous, even after an earlier stop; one first touched without a stop counts only if no bar before it had one.
    """
    path = bar_paths(candidates, base, horizon, [k for k in keys if k not in ("symbol", "direction", "regime", "session")]).withColumn("stop_r", F.col("adv") <= -1)
    at = lambda test: F.min(F.when(test, F.col("pos")))
    names = [str(t).replace(".", "_") for t in GEOMETRY]
    per = path.groupBy("candidate_id", *keys).agg(at(F.col("stop_r")).alias("s"), *(at(F.col("fav") >= t).alias(f"t_{n}") for t, n in zip(GEOMETRY, names)), *(at((F.col("fav") >= t) & F.col("stop_r")).alias(f"a_{n}") for t, n in zip(GEOMETRY, names)))
    never = F.lit(1 << 30)
    stop = F.coalesce("s", never)
    hit = lambda n: F.coalesce(F.col(f"t_{n}") < stop, F.lit(False))  # noqa: E731  a first touch with no stop yet
    unclear = lambda n: F.col(f"a_{n}").isNotNull() & ~hit(n)
    marked = per.select(*keys, *(hit(n).cast("int").alias(f"h_{n}") for n in names), sum((unclear(n).cast("int") for n in names), F.lit(0)).alias("unclear"))
    return marked.groupBy(*keys).agg(F.count("*").alias("paths"), *(F.avg(f"h_{n}").alias(f"hit_{n}r") for n in names), (F.sum("unclear") / (F.count("*") * horizon)).alias("ambiguity_rate"))


def tick_barriers(candidates: DataFrame, ticks: DataFrame, latency_ms: int = 0, entry_slip: float = 0.0, exit_slip: float = 0.0, commission_r: float = 0.0, pip: float = PIP, bucket_ms: int = 3_600_000) -> DataFrame:
    """First barrier that each candidate's quotes touch: profit, stop, both in one millisecond (at the worst price), or time.

    Of the quotes until the barrier only those of three narrow cells are read, see :mod:`.extremes`. Entry is the first tick at or after the available time plus latency, at the ask for a long one; the search starts at the next tick in order. The time barrier does not move with
    latency: at exactly that time the last tick closes, else the first tick after it, however late.
    """
    long = prices.is_long()
    sign = F.when(long, 1.0).otherwise(-1.0)
    ideas = candidates.select("candidate_id", "symbol", "direction", F.col("entry").alias("planned_entry"), "stop_loss", "take_profit", "available_ms", "max_holding_ms")
    ideas = ideas.withColumn("planned_risk", F.abs(F.col("planned_entry") - F.col("stop_loss"))).withColumn("barrier_ms", F.col("available_ms") + F.col("max_holding_ms"))
    # the ticks at entry and after the barrier come from one pass over the feed, in which only ids and times travel
    probe = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("at_ms"))
    probes = ideas.select("candidate_id", "symbol", F.inline(F.array(probe("e", F.col("available_ms") + latency_ms), probe("l", F.col("barrier_ms") + 1))))
    quotes = with_previous(ticks.select("symbol", "seq", "time_ms", "bid", "ask"), ["time_ms", "bid", "ask"], prefix="next_", ahead=True)
    seen = as_of(probes, quotes, "at_ms", "time_ms", "q", ["time_ms", "seq", "bid", "ask", "next_time_ms", "next_bid", "next_ask"], backward=False, bucket_ms=bucket_ms, order="seq")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(f"q.{c}")))
    met = seen.groupBy("candidate_id").agg(
        of("e", "time_ms").alias("entry_ms"), of("e", "seq").alias("entry_seq"), of("e", "bid").alias("entry_bid"), of("e", "ask").alias("entry_ask"),
        *(of("e", f"next_{c}").alias(f"next_{c}") for c in ("time_ms", "bid", "ask")), *(of("l", c).alias(f"late_{c}") for c in ("time_ms", "bid", "ask")),
    )
    entered = ideas.join(met, "candidate_id")
    # an entry after the barrier closes at the very next tick
    missed = F.col("entry_ms") > F.col("barrier_ms")
    entered = entered.select(*ideas.columns, "entry_ms", "entry_seq", "entry_bid", "entry_ask", *(F.when(missed, F.col(f"next_{c}")).otherwise(F.col(f"late_{c}")).alias(f"late_{c}") for c in ("time_ms", "bid", "ask")))
    entered = entered.withColumn("entry_quote", F.when(long, F.col("entry_ask")).otherwise(F.col("entry_bid"))).withColumn("entry_fill", F.col("entry_quote") + sign * entry_slip * pip)
    beyond = F.when(long, F.col("entry_fill") <= F.col("stop_loss")).otherwise(F.col("entry_fill") >= F.col("stop_loss"))
    entered = entered.withColumn("refused", F.when(F.col("entry_ms").isNull(), "NO_TICK").when(beyond, "FILL_BEYOND_STOP"))
    live = entered.where("refused IS NULL AND entry_ms <= barrier_ms").select("candidate_id", "symbol", "direction", "stop_loss", "take_profit", "entry_ms", "entry_seq", "barrier_ms")
    path = extremes.touching_ticks(live, ticks.select("symbol", "seq", "time_ms", "bid", "ask"), max(1, bucket_ms // extremes.FAN))
    tp = F.when(long, F.col("bid") >= F.col("take_profit")).otherwise(F.col("ask") <= F.col("take_profit"))
    sl = F.when(long, F.col("bid") <= F.col("stop_loss")).otherwise(F.col("ask") >= F.col("stop_loss"))
    quote = F.struct("seq", "bid", "ask")
    path = path.withColumn("tp", tp).withColumn("sl", sl)
    moments = path.groupBy("candidate_id", "time_ms", "barrier_ms", "direction").agg(
        F.max("tp").alias("tp"), F.max("sl").alias("sl"), F.min(quote).alias("first"), F.max(quote).alias("last"), F.min(F.when(F.col("sl"), quote)).alias("first_sl"), F.min(F.when(F.col("tp"), quote)).alias("first_tp"), F.min("bid").alias("low_bid"), F.max("ask").alias("high_ask")
    )
    what = F.when(F.col("tp") & F.col("sl"), "AMBIGUOUS").when(F.col("sl"), "STOP_LOSS").when(F.col("tp"), "TAKE_PROFIT").when(F.col("time_ms") == F.col("barrier_ms"), "VERTICAL")
    tick = F.when(F.col("what") == "AMBIGUOUS", F.col("first")).when(F.col("what") == "STOP_LOSS", F.col("first_sl")).when(F.col("what") == "TAKE_PROFIT", F.col("first_tp")).otherwise(F.col("last"))
    ends = moments.withColumn("what", what).where("what IS NOT NULL").withColumn("x", tick).groupBy("candidate_id").agg(F.min_by(F.struct("time_ms", "what", "x.bid", "x.ask", "low_bid", "high_ask"), "time_ms").alias("x"))
    joined = entered.join(ends.select("candidate_id", F.col("x.what").alias("what"), *(F.col(f"x.{c}").alias(f"x_{c}") for c in ("time_ms", "bid", "ask", "low_bid", "high_ask"))), "candidate_id", "left")
    outcome = F.when(F.col("refused").isNotNull(), "NO_FILL").when(F.col("what").isNotNull(), F.col("what")).when(F.col("late_time_ms").isNotNull(), "VERTICAL").otherwise("DATA_EXHAUSTED")
    out = joined.withColumn("outcome", outcome)
    closed = F.col("outcome").isin("AMBIGUOUS", "STOP_LOSS", "TAKE_PROFIT", "VERTICAL")
    end = lambda c: F.when(closed, F.when(F.col("what").isNotNull(), F.col(f"x_{c}")).otherwise(F.col(f"late_{c}")))
    out = out.withColumns({"exit_ms": end("time_ms"), "xb": end("bid"), "xa": end("ask")})
    worst = F.col("outcome") == "AMBIGUOUS"
    out = out.withColumn("exit_quote", F.when(long, F.when(worst, F.col("x_low_bid")).otherwise(F.col("xb"))).otherwise(F.when(worst, F.col("x_high_ask")).otherwise(F.col("xa"))))
    out = out.withColumn("exit_fill", F.col("exit_quote") - sign * exit_slip * pip)
    risk = F.nullif("planned_risk", F.lit(0.0))
    gross = sign * ((F.col("xb") + F.col("xa")) / 2 - (F.col("entry_bid") + F.col("entry_ask")) / 2)
    seen, net = sign * (F.col("exit_quote") - F.col("entry_quote")), sign * (F.col("exit_fill") - F.col("entry_fill"))
    filled = F.col("outcome") != "NO_FILL"
    return out.select(
        "candidate_id", "symbol", "direction", "outcome", F.when(closed, (F.col("outcome") == "TAKE_PROFIT").cast("int")).alias("label"), F.when(filled, F.col("entry_ms")).alias("entry_ms"), "exit_ms",
        F.when(filled, F.col("entry_fill")).alias("entry_fill"), "exit_fill", (gross / risk).alias("gross_r"), ((gross - seen) / risk).alias("spread_cost_r"), ((seen - net) / risk).alias("slippage_cost_r"), F.lit(commission_r).alias("commission_cost_r"), (net / risk - commission_r).alias("net_r"),
    )
