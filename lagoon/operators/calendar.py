"""Cron schedules and timers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The five fields with their ranges.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))


@dataclass(frozen=True)
class Cron:
    minute: tuple[int, ...]
    hour: tuple[int, ...]
    day: tuple[int, ...]
    month: tuple[int, ...]
    weekday: tuple[int, ...]

    @staticmethod
    def parse(text: str) -> Cron:
        """Five fields of *, */n, a, a-b and lists of them; weekday 0 is Sunday. (O185)"""
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"a schedule has 5 fields: {text!r}")
        return Cron(*(_field(p, *f) for p, f in zip(parts, FIELDS, strict=True)))

    def on(self, d: date) -> bool:
        """Day of month and weekday must both fit. (O207)"""
        return d.month in self.month and d.day in self.day and d.isoweekday() % 7 in self.weekday


def _field(text: str, name: str, low: int, high: int) -> tuple[int, ...]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = b = int(span)
        if step and span != "*" or a > b or a < low or b > high or step == "0":
            raise ValueError(f"can't read {part!r} as {name}")
        out.update(range(a, b + 1, int(step or 1)))
    return tuple(sorted(out))


def next_fire(df: DataFrame, epoch: str, cron: Cron, first: date, last: date, into: str = "next_fire") -> DataFrame:
    """The first fire at or after an epoch second, on a whole minute; null if there is none within 5 years. `first` and `last` bound the days of the column. (O186, O188)

    A small calendar tells each day whether it fits and which fitting day follows; the time of day is found in the sorted minutes of a day.
    """
    spark = df.sparkSession
    days = [first + timedelta(n) for n in range((last - first).days + 5 * 366)]
    zero = date(1970, 1, 1)
    rows, after = [], None
    for d in reversed(days):
        fits = cron.on(d)
        rows.append(((d - zero).days, fits, after))
        after = (d - zero).days if fits else after
    calendar = spark.createDataFrame(rows, "_day long, _fits boolean, _after long")  # some 366 rows a year
    minutes = F.array(*(F.lit(60 * h + m) for h in cron.hour for m in cron.minute))
    at = F.ceil(F.col(epoch) / 60)  # minutes since 1970
    found = df.withColumn("_at", at).withColumn("_day", F.floor(F.col("_at") / 1440)).join(F.broadcast(calendar), "_day", "left")
    today = F.try_element_at(F.filter(minutes, lambda m: m >= F.col("_at") % 1440), F.lit(1))
    same = F.when(F.col("_fits"), F.col("_day") * 1440 + today)
    later = F.col("_after") * 1440 + F.element_at(minutes, 1)
    fire = F.coalesce(same, later) * 60
    within = F.when(fire <= F.col(epoch) + 5 * 366 * 86400, fire)
    return found.withColumn(into, within).drop("_at", "_day", "_fits", "_after")


def next_fires(df: DataFrame, epoch: str, cron: Cron, first: date, last: date, times: int) -> DataFrame:
    """The rows with `fires`: as many fires as asked for, each armed by the one before. (O187)"""
    now, names = df, [f"_fire{i}" for i in range(times)]
    for i, name in enumerate(names):
        asked = now.withColumn("_asked", F.col(epoch) if i == 0 else F.col(names[i - 1]) + 60)
        now = next_fire(asked, "_asked", cron, first, last, name).drop("_asked")
    return now.withColumn("fires", F.array_compact(F.array(*names))).drop(*names)


def fire_ticks(commands: DataFrame, timer: str, order: str, action: str, now_tick: str, delay: str) -> DataFrame:
    """Timers that are left after schedule, reschedule and cancel commands, by the tick at which they fire; a delay of 0 fires with the next tick. (O141, O204, O217)"""
    newest = commands.groupBy(timer).agg(F.max_by(F.struct(action, now_tick, delay), order).alias("c"))
    live = newest.where(F.col("c")[action] != "cancel")
    return live.select(timer, (F.col("c")[now_tick] + F.greatest(F.col("c")[delay], F.lit(1))).alias("fire_tick"))


def fires(commands: DataFrame, timer: str, seq: str, action: str, tick: str, delay: str) -> DataFrame:
    """(timer, fire_tick) of every time that a timer fires. A timer has one pending fire at most: schedule and reschedule replace it, the latter only if it hasn't fired yet, cancel takes it away; a command at the tick of a fire or later comes after it. (O141, O217)

    A timer's pending fire before a command depends on the commands since its last
    schedule or cancel only: every reschedule in between must come before the fire
    that the command before it left.
    """
    due = F.col(tick) + F.greatest(F.col(delay), F.lit(1))
    rows = commands.where(F.col(timer).isNotNull()).select(timer, F.col(action).alias("_a"), F.col(tick).alias("_t"), F.col(seq).alias("_s"), due.alias("_d"))
    order = Window.partitionBy(timer).orderBy("_t", "_s")
    rows = rows.withColumn("_next", F.lead("_t").over(order)).withColumn("_before", F.lag("_d").over(order))
    # a reschedule is void if the command before it left nothing pending at its tick: it fired by then, was cancelled, or was void itself
    run = F.sum(F.when(F.col("_a") == "reschedule", F.when(F.col("_before") <= F.col("_t"), 1).otherwise(0)).otherwise(1)).over(order)
    heads = rows.withColumn("_run", run)
    first = F.first("_a").over(Window.partitionBy(timer, "_run").orderBy("_t", "_s"))
    live = heads.withColumn("_live", (first == "schedule") & (F.col("_a") != "cancel"))
    return live.where(F.col("_live") & (F.col("_next").isNull() | (F.col("_next") >= F.col("_d")))).select(timer, F.col("_d").alias("fire_tick"))


def ticks_of(nanos: str, tick_nanos: int):
    """Whole ticks of a delay, rounded up, one at least. (O219)"""
    return F.greatest(F.ceil(F.col(nanos) / tick_nanos), F.lit(1))
