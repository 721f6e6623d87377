"""Queries over a report's sections, as a dashboard asks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_DAYS = 30
LEVELS = 7
PAD_WEEKS = 2
HARNESSES = ["claude", "codex", "cursor"]


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def salty_percent(totals: DataFrame) -> DataFrame:
    """Share of prompts with a swear, in percent, 0 of none."""
    return totals.select(F.when(F.col("prompts") == 0, 0.0).otherwise(F.lit(100.0) * F.col("prompts_with_swear") / F.col("prompts")).alias("salty_pct"))


def worst_harness(by_harness: DataFrame) -> DataFrame:
    """The harness of the highest rate; none where nobody swore."""
    worst = by_harness.filter("prompts > 0").orderBy(F.desc("rate"), "harness").limit(1)
    return worst.filter("swears > 0").select("harness", "rate")


def bars(df: DataFrame, value: str, least: float, name: str = "width") -> DataFrame:
    """Each row's value as a share of the largest (and at least `least`)."""
    top = df.agg(F.greatest(F.max(value), F.lit(least)).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(name, F.col(value) / F.col("__top")).drop("__top")


def swear_ratio(totals: DataFrame, agent: DataFrame) -> DataFrame:
    """How many times the agent's rate the user's is; null if the agent's is 0."""
    both = totals.select("swears_per_100_prompts").crossJoin(agent.select("swears_per_100_messages"))
    return both.select((F.col("swears_per_100_prompts") / F.nullif("swears_per_100_messages", F.lit(0.0))).alias("ratio"))


def active_days(daily: DataFrame) -> DataFrame:
    return daily.agg(F.count(F.lit(1)).alias("active_days"))


def timeline(daily: DataFrame, agent_daily: DataFrame) -> DataFrame:
    """All days of either side, zero-filled: date, prompts, user_swears, and the swears of each
    harness (null throughout for one that never replied)."""
    dates = daily.select("date").union(agent_daily.select("date")).distinct()
    pivot = agent_daily.groupBy("date").pivot("harness", HARNESSES).agg(F.sum("swears"))
    used = agent_daily.agg(*[F.max(F.col("harness") == h).alias(f"__{h}") for h in HARNESSES])
    dense = dates.join(daily, "date", "left").join(pivot, "date", "left").crossJoin(F.broadcast(used))
    lines = [F.when(F.col(f"__{h}"), F.coalesce(h, F.lit(0))).alias(h) for h in HARNESSES]
    return dense.select("date", F.coalesce("prompts", F.lit(0)).alias("prompts"), F.coalesce("swears", F.lit(0)).alias("user_swears"), *lines).orderBy("date")


def timeline_scale(line: DataFrame) -> DataFrame:
    """The axes' maxima and the ticks of the swear axis."""
    top = F.greatest(F.max("user_swears"), *[F.coalesce(F.max(h), F.lit(0)) for h in HARNESSES], F.lit(1))
    scale = line.agg(F.greatest(F.max("prompts"), F.lit(1)).alias("max_prompts"), top.alias("max_swears"))
    return scale.withColumn("half_tick", F.round(F.col("max_swears") / 2).cast("long"))


def calendar(daily: DataFrame) -> DataFrame:
    """Every day of the whole weeks around the data and PAD_WEEKS more at each end: date, week,
    weekday (Monday 0), prompts, swears, weight, shade. Shade is `empty` without prompts,
    `quiet` at weight 0, else 1 to LEVELS on a log scale between the least and greatest lit day."""
    rows = daily.withColumn("weight", F.coalesce("weight", "swears") if "weight" in daily.columns else F.col("swears"))
    lit = F.when(F.col("weight") > 0, F.log1p("weight"))
    ends = rows.agg(F.min("date").cast("date").alias("first"), F.max("date").cast("date").alias("last"), F.min(lit).alias("floor"), (F.max(lit) - F.min(lit)).alias("span"))
    start = F.date_sub("first", F.weekday("first") + PAD_WEEKS * 7)
    end = F.date_add("last", 6 - F.weekday("last") + PAD_WEEKS * 7)
    days = ends.filter(F.col("first").isNotNull()).select("floor", "span", start.alias("start"), F.explode(F.sequence(start, end)).alias("day"))
    joined = days.withColumn("date", F.date_format("day", "yyyy-MM-dd")).join(rows, "date", "left")
    level = F.when(F.col("span") <= 0, LEVELS).otherwise(F.least(F.lit(LEVELS), F.greatest(F.ceil(LEVELS * (F.log1p("weight") - F.col("floor")) / F.col("span")), F.lit(1))))
    shade = F.when(F.col("prompts").isNull(), "empty").when(F.col("weight") == 0, "quiet").otherwise(level.cast("string"))
    return joined.select(
        "date", F.expr("datediff(day, start) div 7").cast("long").alias("week"), F.weekday("day").cast("long").alias("weekday"), F.coalesce("prompts", F.lit(0)).alias("prompts"),
        F.coalesce("swears", F.lit(0)).alias("swears"), F.coalesce("weight", F.lit(0)).alias("weight"), shade.alias("shade"),
    ).orderBy("date")


def month_labels(days: DataFrame) -> DataFrame:
    """The first week column whose Monday is in a month: week, month."""
    mondays = days.filter("weekday = 0").select("week", F.col("date").cast("date").alias("monday"))
    before = F.lag(F.month("monday")).over(Window.orderBy("week"))  # a row a week
    labelled = mondays.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.month("monday")))
    return labelled.select("week", F.date_format("monday", "MMM").alias("month"))


def word_list(words: DataFrame, k: int = 12) -> DataFrame:
    """The first k words: rank, word, tier, count, percent, width."""
    top = words.orderBy(F.desc("count"), "word").limit(k)
    ranked = bars(top, "count", 1).withColumn("n", F.row_number().over(Window.orderBy(F.desc("count"), "word")))  # k rows
    return ranked.select(F.lpad(F.col("n").cast("string"), 2, "0").alias("rank"), "word", "tier", "count", F.format_number(F.col("share") * 100, 1).alias("percent"), "width").orderBy("rank")


def project_table(projects: DataFrame, by: str = "swears", descending: bool = True, k: int = 15) -> DataFrame:
    """The first k projects by name, prompts, swears or rate."""
    if by not in ("name", "prompts", "swears", "rate"):
        raise ValueError(f"can't sort projects by {by}")
    key = F.desc(by) if descending else F.asc(by)
    return projects.orderBy(key, F.desc("swears"), F.desc("prompts"), "name").limit(k)


def expires_on(report: DataFrame) -> DataFrame:
    made = F.to_timestamp("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSX")
    return report.select(F.date_format(made, "yyyy-MM-dd").alias("snapshot"), F.date_format(made + F.make_interval(days=F.lit(TTL_DAYS)), "yyyy-MM-dd").alias("expires"))


def share_card(totals: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    """One line of numbers, and the first k words as chips."""
    top = words.orderBy(F.desc("count"), "word").limit(k)
    chips = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "word"))), lambda x: x["word"]).alias("chips"))
    line = F.concat(thousands(F.col("swears")), F.lit(" swears · "), thousands(F.col("prompts")), F.lit(" prompts · "), thousands(F.col("sessions")), F.lit(" sessions"))
    return totals.select(line.alias("summary")).crossJoin(chips).select("summary", F.array_join("chips", ",").alias("chips"))


def page_title(totals: DataFrame) -> DataFrame:
    title = F.concat(F.call_function("format_number", "swears_per_100_prompts", F.lit("0.0")), F.lit(" swears per 100 prompts"))
    text = F.concat(thousands(F.col("swears")), F.lit(" swears across "), thousands(F.col("prompts")), F.lit(" prompts typed at coding agents."))
    return totals.select(title.alias("title"), text.alias("description"))


def agent_callout(totals: DataFrame, agent: DataFrame) -> DataFrame:
    """Which sentence the agent panel shows: `never`, `ratio`, or none."""
    both = agent.select("swears").crossJoin(swear_ratio(totals, agent))
    return both.select(F.when(F.col("swears") == 0, "never").when(F.col("ratio").isNotNull(), "ratio").alias("callout"), F.call_function("format_number", F.round("ratio"), F.lit("0")).alias("times"))


def coverage_line(coverage: DataFrame) -> DataFrame:
    return coverage.select(thousands(F.col("files_scanned")).alias("files"), F.call_function("format_number", F.col("bytes_scanned") / 1e9, F.lit("0.0")).alias("gb"), thousands(F.col("duplicates_dropped")).alias("duplicates"))
