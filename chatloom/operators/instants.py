"""Mixed timestamp formats and zones: one instant in UTC for each stamp that names exactly one.

Method: expectation-maximisation over date-order mixtures per source. All-number dates are open between
day-month-year, month-day-year and year-month-day. Each value contributes its likelihood under every
order in which it is a real date, the density of an order being uniform over the days that it gives the
source; posteriors per source and kind of value choose the order, or mark the value as open.

The whole computation is native: one aggregation per source with a fixed-size state (counts by set of
valid orders, first and last day by order), the iterations as a fold inside one expression, one join back.
A source with a third of all rows adds one partial state per task, so it can't become a hot group there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import stamps
from chatloom.session import checked_broadcast, set_aside, settled

ORDERS = ("dmy", "mdy", "ymd")
#: How usual each order is before a source's own values speak; a two-digit year in front is rare.
ORDER_WEIGHTS = (0.55, 0.42, 0.03)


def _mask(days: dict[str, Column]) -> Column:
    return sum((F.when(days[o].isNotNull(), 1 << i).otherwise(0) for i, o in enumerate(ORDERS)), F.lit(0))


def _possible(days: dict[str, Column], exported: Column) -> dict[str, Column]:
    """Days that don't lie after the export; two days' grace for zones and clocks."""
    return {o: F.when(exported.isNull() | (day <= exported + 2), day) for o, day in days.items()}


def _let(value: Column, fn) -> Column:
    """`fn` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _numbers(cleaned: DataFrame) -> DataFrame:
    """Rows with a cleaned date `_d`, with its parts `_dp` and their numbers `_n1`, `_n2`, `_n3`."""
    cut = settled(cleaned, {"_dp": stamps.date_parts(F.col("_d"))})
    part = lambda i: F.get("_dp", F.lit(i))
    return settled(cut, {"_n1": stamps.whole(part(1)), "_n2": stamps.month_number(part(2)), "_n3": stamps.whole(part(3))})


def order_posteriors(
    numbers: DataFrame,
    source: str,
    iterations: int = 12,
    strength: float = 20.0,
    against: float = 7.0,
    background: float = 3e-7,
    age_days: float = 365.0,
) -> DataFrame:
    """Posterior of each date order per `source` and set of valid orders.

    `numbers` has `source`, `_exported_day` and n1, n2, n3, of sources that don't state their order. The density of an order is
    uniform over its days and falls with their mean age at the export, by e for each `age_days`; an order
    whose days lie after the export on the whole has next to none. Result: `source`, `_em_posterior` ARRAY<STRUCT<dmy,mdy,ymd>>, at
    index m the posterior of a value that is a real date under the orders in bit mask m. A source
    without such values has no row.
    """
    days = _possible(stamps.ordered_days(F.col("n1"), F.col("n2"), F.col("n3")), F.col("_exported_day"))
    seen = settled(numbers.filter(F.col("n1").isNotNull()), {f"_{k}": v for k, v in days.items()})
    seen = seen.withColumn("_mask", _mask({o: F.col(f"_{o}") for o in ORDERS}))
    state = seen.groupBy(source).agg(
        F.array(*[F.count_if(F.col("_mask") == m) if m else F.lit(0) for m in range(8)]).alias("_n"),
        F.array(*[F.max(f"_{o}") - F.min(f"_{o}") + 1 for o in ORDERS]).alias("_span"),
        F.array(*[F.avg(f"_{o}") for o in ORDERS]).alias("_mean"),
        F.max("_exported_day").alias("_exported_day"),
    )
    age = lambda mean: F.coalesce(F.col("_exported_day") - mean, F.lit(0.0))
    fit = lambda mean: F.exp(-F.abs(age(mean)) / F.when(age(mean) < -2, age_days / 100).otherwise(age_days))
    density = F.zip_with(F.col("_span"), F.col("_mean"), lambda span, mean: F.coalesce(fit(mean) / span, F.lit(0.0)))
    state = state.withColumn("_density", density)

    members = F.array(*[F.array(*[F.lit(float(m >> i & 1)) for i in range(3)]) for m in range(8)])
    times = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # a value that no likely order explains is left to a thin background
    share = lambda a, rest: _let(total(a) + rest, lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))
    each = lambda pi: F.transform(members, lambda m: share(times(times(m, pi), F.col("_density")), F.lit(background)))
    # prior: a source mostly keeps to one order; a value that is no date under an order speaks against it
    fails = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.aggregate(F.zip_with(F.col("_n"), members, lambda n, m: n * (1 - m[i])), F.lit(0.0), lambda x, y: x + y))
    usual = F.array(*[F.lit(x) for x in ORDER_WEIGHTS])
    prior = _let(fails, lambda f: share(F.zip_with(f, usual, lambda x, w: w * F.exp(-against * (x - F.array_min(f)))), F.lit(0.0)))
    state = state.withColumns({"_prior": prior, "_total": F.aggregate(F.col("_n"), F.lit(0.0), lambda x, y: x + y)})

    def step(pi: Column, _: Column) -> Column:
        # expected number of values of each order, over the kinds of value
        summed = F.aggregate(
            F.zip_with(F.col("_n"), each(pi), lambda n, r: F.transform(r, lambda x: x * n)),
            F.transform(F.col("_prior"), lambda p: p * F.col("_total") * strength),
            lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
        )
        return share(summed, F.lit(0.0))

    fitted = state.withColumn("_pi", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.col("_prior"), step))
    return fitted.select(source, F.transform(each(F.col("_pi")), lambda r: F.struct(*[r[i].alias(o) for i, o in enumerate(ORDERS)])).alias("_em_posterior"))


def resolve_instants(
    rows: DataFrame,
    exports: DataFrame,
    date: str = "date",
    time: str = "time",
    source: str = "export_id",
    zone: str = "device_zone",
    order: str = "date_order",
    exported: str = "exported_at",
    certain: float = 0.95,
) -> DataFrame:
    """All columns of `rows` with `stamp_status`, `utc_second` (BIGINT), `stamp_order` and `stamp_confidence`.

    Status: `resolved` exactly one instant; `missing` no date or no time; `unreadable`; `impossible` no real
    date or time; `order_open` two orders remain; `no_zone` wall time without any zone; `skipped` and
    `repeated` wall times that the zone's clock change skips or has twice. Only `resolved` has `utc_second`.
    Null and blank stamps are `missing`; rows whose source isn't in `exports` keep what they state themselves.
    Repeated rows stay. `exports` must have one row per source. Other columns pass through untouched, a column
    named like one of the four results is replaced.
    """
    outs = ["stamp_status", "utc_second", "stamp_order", "stamp_confidence"]
    rows, back = set_aside(rows.drop(*outs))
    known = exports.dropDuplicates([source]).select(
        F.col(source).alias("_src"), F.col(zone).alias("_zone"), F.col(order).alias("_order"), F.unix_date(F.col(exported).cast("date")).alias("_exported_day")
    )
    # one row of fixed size for each source; the size of `exports` is counted, not assumed
    n_exports = exports.count()
    # only sources that don't state their order need counts and iterations, so only their dates are read for them
    silent = known.filter(~F.coalesce(F.col("_order").isin(*ORDERS), F.lit(False))).select("_src", "_exported_day")
    dates = rows.select(F.col(source).alias("_src"), F.col(date).alias("_date")).join(checked_broadcast(silent, n_exports), "_src")
    numbers = _numbers(settled(dates, {"_d": stamps.clean_stamp(F.col("_date"))}))
    post = order_posteriors(numbers.filter(F.col("_dp")[0] == "numeric").select("_src", "_exported_day", *[F.col(f"_n{i}").alias(f"n{i}") for i in (1, 2, 3)]), "_src")
    context = checked_broadcast(known.join(post, "_src", "left"), n_exports)
    parsed = _numbers(settled(rows, {"_d": stamps.clean_stamp(F.col(date)), "_t": stamps.clean_stamp(F.col(time)), "_src": F.col(source)}))
    parsed = settled(parsed, {"_shape": F.when(F.size("_dp") > 1, F.col("_dp")[0]), "_tp": stamps.clock_parts(F.col("_t"))})
    df = parsed.join(context, "_src", "left")

    # numbers that a shape fixes in order are no choice of orders
    df = settled(df, {f"_day_{o}": v for o, v in stamps.ordered_days(F.col("_n1"), F.col("_n2"), F.col("_n3")).items()})
    numeric = F.coalesce(F.col("_shape") == "numeric", F.lit(False))
    df = settled(df, {"_mask": F.when(numeric, _mask(_possible({o: F.col(f"_day_{o}") for o in ORDERS}, F.col("_exported_day")))).otherwise(0)})
    df = df.withColumn("_p", F.coalesce(F.col("_em_posterior")[F.col("_mask")], F.struct(*[F.lit(0.0).alias(o) for o in ORDERS])))
    best = F.greatest(*[F.col("_p")[o] for o in ORDERS])
    df = settled(df, {"_guess": F.when(best == F.col("_p.dmy"), "dmy").when(best == F.col("_p.mdy"), "mdy").otherwise("ymd")})
    df = settled(df, {"_guessed": F.when(F.col("_guess") == "dmy", F.col("_day_dmy")).when(F.col("_guess") == "mdy", F.col("_day_mdy")).otherwise(F.col("_day_ymd"))})
    # orders that name the same day agree
    df = settled(df, {"_best": sum((F.when(F.col(f"_day_{o}") == F.col("_guessed"), F.col("_p")[o]).otherwise(0.0) for o in ORDERS), F.lit(0.0))})
    stated = F.col("_order").isin(*ORDERS)
    df = settled(
        df,
        {
            "stamp_order": F.when(numeric, F.when(stated, F.col("_order")).when((F.col("_mask") > 0) & (F.col("_best") >= certain), F.col("_guess"))),
            "stamp_confidence": F.when(numeric, F.when(stated, 1.0).otherwise(F.col("_best"))).when(F.col("_shape").isNotNull(), 1.0),
        },
    )
    iso = F.coalesce(F.col("_shape") == "iso", F.lit(False))
    count = F.coalesce(F.col("_shape") == "count", F.lit(False))
    # a shape that isn't numeric has year, month and day in this order
    day = F.when(~numeric & ~count, F.col("_day_ymd"))
    for o in ORDERS:
        day = F.when(F.col("stamp_order") == o, F.col(f"_day_{o}")).otherwise(day)
    # the parts of the clock, from the date where it holds them
    clock = F.when(iso, F.array(F.col("_dp")[4], F.col("_dp")[5], F.col("_dp")[6], F.lit(""), F.col("_dp")[7])).otherwise(F.col("_tp"))
    stated_zone = F.when(iso & (F.col("_dp")[7] == ""), F.coalesce(F.col("_tp")[4], F.lit(""))).otherwise(clock[4])
    df = settled(df, {"_day": day, "_clock": clock, "_z": stated_zone})
    df = settled(df, {"_op": F.when(F.col("_z") != "", stamps.offset_parts(F.col("_z")))})
    part = lambda i: stamps.whole(F.col("_clock")[i])
    df = settled(df, {"_second": stamps.second_of_day(part(0), part(1), part(2), F.col("_clock")[3]), "_offset": F.when(F.col("_z") != "", stamps.offset_seconds(F.col("_z"), F.col("_op")))})
    # a zone that is written but unknown makes the time unreadable
    df = df.withColumn("_second", F.when((F.col("_z") == "") | F.col("_offset").isNotNull(), F.col("_second")))
    df = settled(df, {"_wall": F.col("_day") * 86400 + F.col("_second")})
    zoned = F.col("_offset").isNull() & F.col("_wall").isNotNull() & F.col("_zone").isNotNull()
    early = F.when(zoned, stamps.zone_offset(F.col("_zone"), F.col("_wall") - 86400))
    late = F.when(zoned, stamps.zone_offset(F.col("_zone"), F.col("_wall") + 86400))
    df = settled(df, {"_o1": early, "_o2": late})
    # a wall time near a change of the clock: an offset holds if the zone has it at that instant
    near = F.col("_o1") != F.col("_o2")
    holds = lambda o: F.when(~near, F.lit(True)).otherwise(stamps.zone_offset(F.col("_zone"), F.col("_wall") - F.col(o)) == F.col(o))
    df = settled(df, {"_h1": F.when(zoned, holds("_o1")), "_h2": F.when(zoned, holds("_o2"))})
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    number_of = F.when(count, F.col("_d").cast("bigint"))
    written = F.when(F.length("_d") >= 12, F.floor(number_of / 1000)).otherwise(number_of)
    status = (
        F.when(blank("_d"), "missing").when(count, "resolved").when(~iso & blank("_t"), "missing").when(F.col("_shape").isNull(), "unreadable")
        .when(numeric & F.col("stamp_order").isNull() & (F.col("_mask") > 0), "order_open").when(F.col("_day").isNull(), "impossible")
        .when(F.col("_second").isNull(), F.when(F.col("_clock").isNotNull(), "impossible").otherwise("unreadable"))
        .when(F.col("_offset").isNotNull(), "resolved").when(F.col("_zone").isNull(), "no_zone").when(~near, "resolved")
        .when(F.col("_h1") & F.col("_h2"), "repeated").when(F.col("_h1") | F.col("_h2"), "resolved").otherwise("skipped")
    )
    df = df.withColumn("stamp_status", status)
    second = F.when(count, written).otherwise(F.col("_wall") - F.coalesce(F.col("_offset"), F.when(F.col("_h1"), F.col("_o1")).otherwise(F.col("_o2"))))
    df = df.withColumn("utc_second", F.when(F.col("stamp_status") == "resolved", second.cast("bigint")))
    # as a generated row, so that filters on the results don't unfold all the steps above into one predicate
    return df.select(*rows.columns, F.inline(F.array(F.struct(*outs)))).withColumnsRenamed(back)
