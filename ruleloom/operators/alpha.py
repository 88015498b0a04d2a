"""Event study: forward returns, targets, conditional excess, rotation nulls, and grades.

Horizons are rows, so one job measures all events over all horizons.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.stats import average_rank, cohens_d, welch, with_p_greater
from ruleloom.functions.windows import full, lead, leading, ratio

#: The weights of the score's terms.
WEIGHTS = {"ic": 0.20, "lift": 0.25, "d": 0.15, "z": 0.25, "breadth": 0.15}
#: Events that share one copy of their ticker's series.
EVENT_BLOCK = 512


def forward(bars: DataFrame, horizons: tuple[int, ...], *, split: int | None = None, purge: int = 0, source: str = "close") -> DataFrame:
    """``(ticker, rn, open_dt, h, fwd, logfwd)``: simple and log returns ``h`` bars ahead.

    With a split, returns that would look across it are null: those of the last
    ``min(h, purge)`` bars before it.
    """
    c = F.col(source)
    each = []
    for h in horizons:
        later = lead(c, h)
        blocked = F.lit(False) if split is None or not purge else (F.col("rn") >= split - min(h, purge)) & (F.col("rn") < split)
        simple, log = ratio(later, c) - 1, F.when((c > 0) & (later > 0), F.log(later / c))
        each.append(F.struct(F.lit(h).alias("h"), F.when(~blocked, simple).alias("fwd"), F.when(~blocked, log).alias("logfwd")))
    wide = bars.select("ticker", "rn", "open_dt", F.array(*each).alias("x"))
    return wide.select("ticker", "rn", "open_dt", F.explode("x").alias("x")).select("ticker", "rn", "open_dt", "x.h", "x.fwd", "x.logfwd")


def binary_target(h: int, pct: float, *, short: bool = False, source: str = "close") -> Column:
    """Whether the best price of the next ``h`` bars reaches the target; null unless all are there."""
    c, w = F.col(source), leading(h)
    best = F.min(c).over(w) / c - 1 if short else F.max(c).over(w) / c - 1
    return F.when(F.count(c).over(w) >= h, (best <= -pct) if short else (best >= pct))


def projected_target(h: int, pct: float, *, mult: float = 2.0, source: str = "close") -> Column:
    """Whether the best log excess of the next ``h`` bars over the SMA trend reaches ``ln(1 + pct)``.

    The trend is the mean log step of an SMA over ``round(mult * h)`` bars, carried forward.
    """
    k = max(2, round(mult * h))
    mean = full(F.log(source), k, F.avg)
    slope = (mean - F.lag(mean, k).over(Window.partitionBy("ticker").orderBy("rn"))) / k
    best = F.greatest(*(F.log(lead(F.col(source), i)) - F.log(source) - i * slope for i in range(1, h + 1)))
    return F.when(lead(F.col(source), h).isNotNull() & slope.isNotNull(), best >= float(np.log1p(pct)))


def excess(active: DataFrame, fwd: DataFrame) -> DataFrame:
    """``(ticker, event_id, h, n, mu, base, delta)``: mean log return of active bars less that of all bars."""
    base = fwd.where("logfwd is not null").groupBy("ticker", "h").agg(F.avg("logfwd").alias("base"))
    on = active.select("ticker", "event_id", "rn").join(fwd.select("ticker", "rn", "h", "logfwd"), ["ticker", "rn"]).where("logfwd is not null")
    out = on.groupBy("ticker", "event_id", "h").agg(F.count("*").alias("n"), F.avg("logfwd").alias("mu"))
    return out.join(base, ["ticker", "h"]).withColumn("delta", F.col("mu") - F.col("base")).select("ticker", "event_id", "h", "n", "mu", "base", "delta")


class Series:
    """Returns at one horizon with their transforms, made once for all events of the ticker."""

    def __init__(self, h: int, values: np.ndarray):
        self.h, self.valid = h, np.isfinite(values)
        self.n, self.mean = len(values), values[self.valid].mean() if self.valid.any() else np.nan
        self.sums, self.counts = np.fft.rfft(np.where(self.valid, values, 0.0)), np.fft.rfft(self.valid.astype(float))

    def under(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the values under every circular shift of a mask, given as the conjugate of its transform, and how many valid ones it has; null with none."""
        total, count = np.fft.irfft(mask * self.sums, self.n), np.rint(np.fft.irfft(mask * self.counts, self.n))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(count > 0.5, total / np.maximum(count, 1.0), np.nan), count


def _past_series(active: DataFrame, fwd: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over groups of a ticker and a block of its events: the series of all horizons first, then the events.

    A series is sent once for each ``EVENT_BLOCK`` events, and events stream past it in
    Arrow batches, so a task holds one ticker's series and one batch.
    """
    series = fwd.groupBy("ticker", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "logfwd"))), lambda x: x["logfwd"]).alias("r"))
    hits = active.groupBy("ticker", "event_id").agg(F.collect_list(F.col("rn").cast("int")).alias("hits"))
    blocks = max(1, -(-active.select("event_id").distinct().count() // EVENT_BLOCK))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    held = series.select("ticker", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("h").cast("int").alias("h"), null("string", "event_id"), null("array<int>", "hits"), "r")
    sent = hits.select("ticker", F.pmod(F.xxhash64("event_id"), F.lit(blocks)).cast("int").alias("block"), null("int", "h"), "event_id", "hits", null("array<double>", "r"))
    rows = held.union(sent).repartition("ticker", "block").sortWithinPartitions("ticker", "block", F.asc_nulls_last("h"), "event_id")

    def groups(batches):
        """``(ticker, series, event_id, conjugate transform of its mask)``, and ``(ticker, series, None, None)`` after the last event of a group."""
        at, found = None, []
        for batch in batches:
            ticker, block, h, event, hits, r = (batch.column(i) for i in range(6))
            for i, key in enumerate(zip(ticker.to_pylist(), block.to_pylist())):
                if key != at:
                    if at is not None:
                        yield at[0], found, None, None
                    at, found = key, []
                if event[i].is_valid:
                    if found and found[0].n >= 4:
                        mask = np.zeros(found[0].n)
                        mask[hits[i].values.to_numpy()] = 1.0
                        yield key[0], found, event[i].as_py(), np.conj(np.fft.rfft(mask))
                else:
                    found.append(Series(h[i].as_py(), r[i].values.to_numpy(zero_copy_only=False).astype(float)))
        if at is not None:
            yield at[0], found, None, None

    return rows.mapInArrow(lambda batches: run(groups(batches)), schema)


def rotation_study(active: DataFrame, fwd: DataFrame) -> DataFrame:
    """``(ticker, event_id, h, n, delta, z, p, auc, p_auc)`` against all circular shifts of the event.

    ``z`` is the excess over the standard deviation of the shifts' excesses, ``p`` the
    share of shifts that are at least as far from zero; ``auc`` integrates the excess per
    bar over the horizons that have one, and ``p_auc`` holds it against the same integral
    of every shift.  All shifts of an event come from one Fourier transform per horizon.
    """
    import pyarrow as pa

    names = ["ticker", "event_id", "h", "n", "delta", "z", "p", "auc", "p_auc"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 5]

    def run(groups):
        rows = []

        def out():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return done

        for ticker, series, event, mask in groups:
            found, profile = [], {}
            for s in series if event is not None else ():
                if not s.valid.any():
                    continue
                mu, count = s.under(mask)
                d = mu - s.mean
                null = d[1:][np.isfinite(d[1:])]
                sd = null.std() if len(null) else 0.0
                ok = np.isfinite(d[0])
                z = d[0] / sd if ok and sd > 0 else None
                p = (1.0 + (np.abs(null) >= abs(d[0]) - 1e-15).sum()) / (1.0 + len(null)) if ok and len(null) else None
                found.append((ticker, event, s.h, int(count[0]), d[0] if ok else None, z, p))
                if ok:
                    profile[s.h] = d
            auc = p_auc = None
            if len(profile) >= 2:
                h = sorted(profile)
                whole = sum(w * profile[x] / x for w, x in zip(trapezoid(h), h))
                null = whole[1:][np.isfinite(whole[1:])]
                auc = whole[0]
                p_auc = (1.0 + (np.abs(null) >= abs(auc) - 1e-15).sum()) / (1.0 + len(null)) if len(null) else None
            rows += [(*r, auc, p_auc) for r in found]
            if len(rows) >= 4096:
                yield out()
        if rows:
            yield out()

    return _past_series(active, fwd, run, "ticker string, event_id string, h int, n long, delta double, z double, p double, auc double, p_auc double")


def rotation_null(active: DataFrame, fwd: DataFrame) -> DataFrame:
    """``(ticker, event_id, h, n, delta, z, p)`` of :func:`rotation_study`."""
    return rotation_study(active, fwd).drop("auc", "p_auc")


def nature(study: DataFrame, *, max_p: float = 0.10, cut: float = 0.5) -> DataFrame:
    """``(ticker, event_id, rho, nature)``: whether the excess per bar, in the direction of its integral, grows or fades with the horizon."""
    own = Window.partitionBy("ticker", "event_id")
    m = study.where("delta is not null").withColumn("rate", F.when(F.col("auc") >= 0, 1.0).otherwise(-1.0) * F.col("delta") / F.col("h"))
    m = m.withColumn("a", average_rank("h", "ticker", "event_id")).withColumn("b", average_rank("rate", "ticker", "event_id")).withColumn("k", F.count("*").over(own))
    m = m.groupBy("ticker", "event_id").agg(F.nanvl(F.corr("a", "b"), F.lit(None).cast("double")).alias("rho"), F.first("p_auc").alias("p_auc"))
    clear = F.coalesce(F.col("p_auc") < max_p, F.lit(False))
    label = F.when(~clear, "not significant").when(F.col("rho") > cut, "momentum").when(F.col("rho") < -cut, "mean reversion").otherwise("idiosyncratic")
    return m.select("ticker", "event_id", F.when(clear, F.col("rho")).alias("rho"), label.alias("nature"))


def grid_boundary(study: DataFrame) -> DataFrame:
    """``(ticker, event_id, last_h, boundary)``: how ``|z|`` ends at the last horizon that has one."""
    own = Window.partitionBy("ticker", "event_id").orderBy("h")
    m = study.where("z is not null").withColumn("s", F.abs("z")).withColumn("s1", F.lag("s", 1).over(own)).withColumn("s2", F.lag("s", 2).over(own))
    last = m.groupBy("ticker", "event_id").agg(F.max("h").alias("last_h"), F.max_by(F.struct("s", "s1", "s2"), "h").alias("x"))
    state = F.when(F.col("x.s2").isNull(), "short grid").when((F.col("x.s") > F.col("x.s1")) & (F.col("x.s1") > F.col("x.s2")), "rising").when(F.col("x.s") > F.col("x.s1"), "ambiguous").otherwise("plateau")
    return last.select("ticker", "event_id", "last_h", state.alias("boundary"))


def enriched_horizons(windows: dict[str, int], base: tuple[int, ...], split: int, *, multiples: tuple[float, ...] = (0.5, 1.0, 2.0), least_windows: int = 20) -> dict[str, list[int]]:
    """Horizons of each event beyond the base grid: multiples of its longest window, as far as ``split`` holds ``least_windows`` of them."""
    most = max(max(base), split // least_windows)
    out = {}
    for event, w in windows.items():
        more = sorted({round(m * w) for m in multiples if 1 <= round(m * w) <= most} - set(base)) if w > 0 else []
        if more:
            out[event] = more
    return out


def enriched_forward(active: DataFrame, bars: DataFrame, extras: dict[str, list[int]], base: tuple[int, ...], **options) -> tuple[DataFrame, DataFrame]:
    """Returns over all horizons, and ``(event_id, h)`` of those that each event is measured at."""
    every = tuple(sorted({*base, *(h for hs in extras.values() for h in hs)}))
    more = active.sparkSession.createDataFrame([(e, h) for e, hs in extras.items() for h in hs], "event_id string, h int")
    shared = active.select("event_id").distinct().withColumn("h", F.explode(F.array(*map(F.lit, base))))
    return forward(bars, every, **options), shared.union(more)


def derive_target(
    study: DataFrame, active: DataFrame, bars: DataFrame, *, q: float = 0.10, auc_p: float = 0.10, least_z: float = 0.0,
    require_significant: bool = True, mfe_quantile: float = 0.5, mfe_floor: float = 0.005,
) -> DataFrame:
    """One row per event: ``h``, direction, route, take-profit and what led there.

    The horizon is that of the largest ``|z|`` among those significant after
    Benjamini-Hochberg, else among all (``weak``).  A direction takes a significant horizon
    (route ``z_score``), a significant integral (``auc``, whose horizon is the elbow of the
    excess), or both; else it is undetermined.
    """
    usable = study.where("n >= 2 and z is not null")
    best = choose_horizon(usable, q)
    keys = ["ticker", "event_id"]
    turn = elbow(study.where("delta is not null")).withColumnRenamed("edge", "elbow_edge")
    m = best.join(turn, keys, "left").join(grid_boundary(usable), keys, "left").join(nature(study, max_p=auc_p), keys, "left")
    clear = F.coalesce(F.col("p_auc") < auc_p, F.lit(False))
    none = F.col("delta").isNull() | (F.col("delta") == 0) | (F.abs("z") < least_z) | (F.lit(require_significant) & F.col("weak") & ~clear)
    route = F.when(~F.col("weak"), F.when(clear, "both").otherwise("z_score")).when(clear, "auc")
    m = m.withColumn("route", F.when(~none, route)).withColumn("z_h", F.col("h"))
    at_elbow = study.select(*keys, F.col("h").alias("h_elbow"), F.col("delta").alias("elbow_delta"))
    m = m.join(at_elbow, [*keys, "h_elbow"], "left")
    by_auc = F.coalesce((F.col("route") == "auc") & (F.col("elbow_delta") != 0), F.lit(False))
    m = m.withColumn("h", F.when(by_auc, F.col("h_elbow")).otherwise(F.col("h"))).withColumn("advantage", F.when(~none, F.when(by_auc, F.col("elbow_delta")).otherwise(F.col("delta"))))
    edge = F.when(by_auc, F.col("elbow_edge") == "rising").otherwise(F.col("h") == F.col("last_h"))
    direction = F.when(none, "undetermined").when(F.col("advantage") > 0, "long").otherwise("short")
    m = m.withColumn("direction", direction).withColumn("at_boundary", F.when(~none, edge))

    # favourable moves at each event's own horizon and in its direction: the bars ahead are joined, horizon times activations
    own = active.select(*keys, "rn").join(m.where("direction <> 'undetermined'").select(*keys, "h", "direction"), keys)
    ahead = own.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.col("h").cast("int")))).withColumn("at", F.col("rn") + F.col("ahead"))
    price = bars.select("ticker", F.col("rn").alias("at"), F.col("close").alias("later"))
    entry = bars.select("ticker", "rn", "close")
    moved = ahead.join(price, ["ticker", "at"]).join(entry, ["ticker", "rn"]).groupBy(*keys, "rn", "h", "direction").agg(F.count("later").alias("k"), F.max("later").alias("high"), F.min("later").alias("low"), F.first("close").alias("close"))
    best_move = F.when(F.col("direction") == "short", 1 - F.col("low") / F.col("close")).otherwise(F.col("high") / F.col("close") - 1)
    profit = moved.where(F.col("k") >= F.col("h")).withColumn("mfe", best_move).where("mfe > 0").groupBy(*keys).agg(F.greatest(F.percentile("mfe", F.lit(mfe_quantile)), F.lit(mfe_floor)).alias("take_profit"))
    m = m.join(profit, keys, "left")
    return m.select(*keys, "h", "n", "direction", "route", "advantage", F.col("delta").alias("z_delta"), "z_h", "z", "p", "weak", "auc", "p_auc", "rho", "nature", "boundary", "at_boundary", F.when(~none, F.coalesce("take_profit", F.lit(mfe_floor))).alias("take_profit"))


def fixed_target(derived: DataFrame, study: DataFrame, h: int, take_profit: float, side: str, *, q: float = 0.10) -> DataFrame:
    """The user's target for every event, with what the derivation would have chosen beside it, and whether the user's horizon is significant."""
    from ruleloom.functions.stats import benjamini_hochberg

    marked = benjamini_hochberg(study.where("z is not null"), "p", q, "ticker", "event_id").where(F.col("h") == h).select("ticker", "event_id", "significant")
    own = derived.select("ticker", "event_id", F.col("h").alias("derived_h"), F.col("take_profit").alias("derived_take_profit"), F.col("direction").alias("derived_direction"), "nature", "p_auc")
    out = own.join(marked, ["ticker", "event_id"], "left").withColumn("weak", ~F.coalesce("significant", F.lit(False))).drop("significant")
    return out.select("ticker", "event_id", F.lit(h).alias("h"), F.lit(take_profit).alias("take_profit"), F.lit(side).alias("direction"), "weak", "derived_h", "derived_take_profit", "derived_direction", "nature", "p_auc")


def summary(contracts: DataFrame) -> DataFrame:
    """Contracts, the best score first."""
    return contracts.orderBy(F.desc_nulls_last("composite"), "ticker", "event_id")


def promoted(contracts: DataFrame, min_lift: float | None = None) -> DataFrame:
    """Contracts with a direction, and a lift of at least ``min_lift``."""
    kept = contracts.where("direction <> 'undetermined'")
    return kept if min_lift is None else kept.where(F.col("lift") >= min_lift)


def rolling_ic_window(bar_hours: float, days: int = 60) -> int:
    """Bars in ``days`` days."""
    return max(2, round(days * 24 / bar_hours))


def choose_horizon(measured: DataFrame, q: float = 0.10) -> DataFrame:
    """The horizon of largest ``|z|`` among those significant after Benjamini-Hochberg, else among all."""
    from ruleloom.functions.stats import benjamini_hochberg

    m = benjamini_hochberg(measured.where("z is not null"), "p", q, "ticker", "event_id")
    any_ = F.max(F.col("significant").cast("int")).over(Window.partitionBy("ticker", "event_id")) == 1
    m = m.withColumn("weak", ~any_).where(F.col("significant") | F.col("weak"))
    w = Window.partitionBy("ticker", "event_id").orderBy(F.desc(F.abs("z")), "h")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "significant")


def trapezoid(h: list[int]) -> list[float]:
    """Weights of the trapezoid rule over a grid."""
    if len(h) == 1:
        return [1.0]
    return [(h[min(i + 1, len(h) - 1)] - h[max(i - 1, 0)]) / 2 for i in range(len(h))]


def auc(measured: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """``(ticker, event_id, auc)``: the excess per bar, integrated over the horizons."""
    w = F.create_map(*(F.lit(x) for h, v in zip(sorted(horizons), trapezoid(sorted(horizons))) for x in (h, v)))
    return measured.groupBy("ticker", "event_id").agg(F.sum(F.element_at(w, F.col("h")) * F.col("delta") / F.col("h")).alias("auc"))


def elbow(measured: DataFrame) -> DataFrame:
    """``(ticker, event_id, h_elbow, edge)``: the last horizon before the excess stops growing in the direction of its integral.

    ``edge`` is ``rising`` where it grows to the end of the grid, else ``plateau``.
    """
    own = Window.partitionBy("ticker", "event_id")
    w = own.orderBy("h")
    width = F.when(F.count("*").over(own) == 1, 1.0).otherwise((F.coalesce(F.lead("h").over(w), F.col("h")) - F.coalesce(F.lag("h").over(w), F.col("h"))) / 2)
    m = measured.withColumn("width", width).withColumn("step", F.col("delta") - F.coalesce(F.lag("delta").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("h").over(w), F.col("h"))).withColumn("k", F.count("*").over(own))
    m = m.withColumn("sign", F.when(F.sum(F.col("width") * F.col("delta") / F.col("h")).over(own) >= 0, 1.0).otherwise(-1.0))
    out = m.groupBy("ticker", "event_id").agg(F.min(F.when((F.col("k") > 1) & (F.col("sign") * F.col("step") <= 0), F.col("before"))).alias("stop"), F.max("h").alias("last"))
    return out.select("ticker", "event_id", F.coalesce("stop", "last").alias("h_elbow"), F.when(F.col("stop").isNull(), "rising").otherwise("plateau").alias("edge"))


def take_profit(active: DataFrame, bars: DataFrame, h: int, *, q: float = 0.5, floor: float = 0.005, short: bool = False) -> DataFrame:
    """``(ticker, event_id, n, take_profit)``: quantile of the best favourable moves of active bars, floored."""
    w = leading(h)
    best = 1 - F.min("close").over(w) / F.col("close") if short else F.max("close").over(w) / F.col("close") - 1
    moved = bars.select("ticker", "rn", F.when(F.count("close").over(w) >= h, best).alias("mfe"))
    on = active.select("ticker", "event_id", "rn").join(moved, ["ticker", "rn"]).where("mfe > 0")
    return on.groupBy("ticker", "event_id").agg(F.count("*").alias("n"), F.greatest(F.percentile("mfe", F.lit(q)), F.lit(floor)).alias("take_profit"))


def event_stats(active: DataFrame, target: DataFrame, *, value: str = "fwd", hit: str = "hit", first: int = 0, last: int = 1 << 62) -> DataFrame:
    """Active against inactive bars: counts, win and base rate, lift, means, Cohen's d, and a pooled t test (greater)."""
    t = target.where((F.col("rn") >= first) & (F.col("rn") < last) & F.col(value).isNotNull() & F.col(hit).isNotNull())
    whole = t.groupBy("ticker").agg(F.count("*").alias("n_all"), F.avg(F.col(hit).cast("double")).alias("base_rate"), F.sum(value).alias("s_all"), F.sum(F.col(value) * F.col(value)).alias("q_all"))
    on = active.select("ticker", "event_id", "rn").join(t, ["ticker", "rn"]).groupBy("ticker", "event_id").agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("double")).alias("win_rate"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    m = on.join(whole, "ticker").withColumn("nb", F.col("n_all") - F.col("n")).withColumn("mean_rest", (F.col("s_all") - F.col("s")) / F.nullif(F.col("nb"), F.lit(0)))
    m = m.withColumn("var_rest", (F.col("q_all") - F.col("q") - F.col("nb") * F.col("mean_rest") * F.col("mean_rest")) / F.nullif(F.col("nb") - 1, F.lit(0)))
    stat, dof = welch(F.col("n"), F.col("mean"), F.col("var"), F.col("nb"), F.col("mean_rest"), F.col("var_rest"), pooled=True)
    m = m.withColumn("lift", F.col("win_rate") - F.col("base_rate")).withColumn("cohens_d", cohens_d(F.col("mean"), F.col("var"), F.col("mean_rest"), F.col("var_rest"))).withColumn("t", stat).withColumn("df", dof)
    return m.select("ticker", "event_id", "n", "win_rate", "base_rate", "lift", "mean", "mean_rest", "cohens_d", "t", "df")


def with_p(stats: DataFrame) -> DataFrame:
    return with_p_greater(stats, "t", "df", "p_greater")


def out_of_sample(active: DataFrame, fwd: DataFrame, start: int, h: int) -> DataFrame:
    """Mean log return of active bars from ``start`` on, its one-sample t, p and whether it confirms."""
    f = fwd.where((F.col("h") == h) & (F.col("rn") >= start) & F.col("logfwd").isNotNull())
    m = active.select("ticker", "event_id", "rn").join(f.select("ticker", "rn", "logfwd"), ["ticker", "rn"]).groupBy("ticker", "event_id").agg(F.count("*").alias("n"), F.avg("logfwd").alias("mean"), F.stddev_samp("logfwd").alias("sd"))
    m = m.withColumn("t", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).withColumn("df", F.col("n") - 1)
    return with_p_greater(m, "t", "df", "p").withColumn("confirmed", F.coalesce((F.col("p") < 0.10) & (F.col("mean") > 0), F.lit(False)))


def regime_sensitivity(active: DataFrame, target: DataFrame, regimes: DataFrame, *, least: int = 10) -> DataFrame:
    """``(ticker, event_id, regime, n, win_rate, mean)`` of regimes with enough active bars."""
    on = active.select("ticker", "event_id", "rn").join(target, ["ticker", "rn"]).join(regimes.select("ticker", "rn", "regime"), ["ticker", "rn"]).where("regime is not null and fwd is not null")
    return on.groupBy("ticker", "event_id", "regime").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("win_rate"), F.avg("fwd").alias("mean")).where(F.col("n") >= least)


def regime_breadth(sensitivity: DataFrame) -> DataFrame:
    """Share of measured regimes in which the mean is positive."""
    return sensitivity.groupBy("ticker", "event_id").agg(F.avg((F.col("mean") > 0).cast("double")).alias("breadth"), F.count("*").alias("regimes"))


def composite(ic: Column, lift: Column, d: Column, z: Column, breadth: Column, *, weak: Column, confirmed: Column) -> Column:
    """Weighted score of the five terms, renormalised where there is no breadth, adjusted and clamped to 0..1."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    s = WEIGHTS["ic"] * zero(clamp(F.abs(ic) / 0.10)) + WEIGHTS["lift"] * zero(clamp(lift / 0.30)) + WEIGHTS["d"] * zero(F.least(F.greatest(d / 0.80, F.lit(-1.0)), F.lit(1.0))) + WEIGHTS["z"] * zero(clamp(F.abs(z) / 3.0))
    four = sum(v for k, v in WEIGHTS.items() if k != "breadth")
    s = F.when(breadth.isNull(), s / four).otherwise(s + WEIGHTS["breadth"] * breadth)
    s = F.when(weak, s * 0.6).otherwise(s)
    return clamp(F.when(confirmed, s + 0.05).otherwise(s))


def grade(score: Column) -> Column:
    """The lowest scores of the grades."""
    return F.when(score >= 0.75, "A").when(score >= 0.50, "B").when(score >= 0.25, "C").otherwise("D")


def information_coefficient(feature: DataFrame, fwd: DataFrame, h: int) -> DataFrame:
    """Spearman correlation of a feature (column ``x``) with the return ``h`` bars ahead, per ticker."""
    from ruleloom.functions.stats import spearman

    return spearman(feature.select("ticker", "rn", "x").join(fwd.where(F.col("h") == h).select("ticker", "rn", "fwd"), ["ticker", "rn"]), "x", "fwd", "ticker")


def rolling_ic_stability(feature: DataFrame, fwd: DataFrame, h: int, window: int, *, windows: int = 20) -> DataFrame:
    """Share of strided windows whose rank correlation has the sign of the whole one; stable from 0.7."""
    both = feature.select("ticker", "rn", "x").join(fwd.where(F.col("h") == h).select("ticker", "rn", "fwd"), ["ticker", "rn"]).where("x is not null and fwd is not null")
    n = Window.partitionBy("ticker")
    both = both.withColumn("i", F.row_number().over(n.orderBy("rn")) - 1).withColumn("n", F.count("*").over(n))
    both = both.withColumn("stride", F.greatest(F.lit(1), F.floor((F.col("n") - window) / (windows - 1)))).where(F.col("n") >= window)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - window + 1) / F.col("stride")))
    both = both.withColumn("w", F.explode(F.sequence(first.cast("long"), F.least(F.floor(F.col("i") / F.col("stride")), F.floor((F.col("n") - window) / F.col("stride"))).cast("long"))))
    both = both.withColumn("rx", average_rank("x", "ticker", "w")).withColumn("ry", average_rank("fwd", "ticker", "w"))
    per = both.groupBy("ticker", "w").agg(F.corr("rx", "ry").alias("ic"))
    from ruleloom.functions.stats import spearman

    whole = spearman(both.select("ticker", "i", "x", "fwd").distinct(), "x", "fwd", "ticker").select("ticker", F.col("ic").alias("whole"))
    return per.join(whole, "ticker").groupBy("ticker").agg(F.count("*").alias("windows"), F.avg((F.signum("ic") == F.signum("whole")).cast("double")).alias("agreement")).withColumn("stable", F.col("agreement") >= 0.7)


def optimise_target(active: DataFrame, target: DataFrame, bars: DataFrame, pairs: DataFrame, *, gate_params=None, least_atoms: float = 1.0, least_result: float = 1.05, least: int = 10) -> DataFrame:
    """Atoms and their pairs that raise the rate of a target, gated, by falling lift: ``(ticker, event_id, members, n, p_event, p_base, lift, z, place)``.

    Atoms below ``least_atoms`` go; ``pairs`` of those left are joined by AND down to the volume floor; of both, those of
    ``least_result`` and more that pass the gate stay.
    """
    from ruleloom.functions.lineage import written
    from ruleloom.operators import compose, gate

    p = gate_params or gate.GateParams()
    keys = ["ticker", "event_id"]
    score = lift_score(active, target, least=least)
    atoms = written(active.join(score.where(F.col("lift") >= least_atoms).select(*keys), keys, "left_semi"), "atoms")
    both = compose.pair_activations(atoms, pairs)
    months = bars.groupBy("ticker").agg(F.count_distinct(gate.month(F.col("open_dt"))).alias("months"))
    enough = both.groupBy(*keys).agg(F.count("*").alias("k")).join(months, "ticker").where(F.col("k") >= F.greatest(F.lit(1), F.floor(p.min_tpm * F.col("months"))))
    every = atoms.select(*keys, "rn", "open_dt").union(both.join(enough.select(*keys), keys, "left_semi").select(*keys, "rn", "open_dt"))
    every = written(every, "candidates")
    scored = written(lift_score(every, target, least=least).where(F.col("lift") >= least_result), "scored")
    passed = gate.gate(every.join(scored.select(*keys), keys, "left_semi"), bars, p).where("passed").select(*keys)
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("lift"), "event_id"))
    return scored.join(passed, keys).withColumn("members", F.split("event_id", "&")).withColumn("place", place)


def hand_off(ranked: DataFrame, active: DataFrame, top: int) -> DataFrame:
    """Activations of each ticker's ``top`` ranked events, for the event study."""
    return active.join(ranked.where(F.col("place") <= top).select("ticker", "event_id"), ["ticker", "event_id"], "left_semi")


def lift_score(active: DataFrame, target: DataFrame, *, hit: str = "hit", least: int = 10) -> DataFrame:
    """``(ticker, event_id, n, p_event, p_base, lift, z)``: the target's rate given the event over its rate at all."""
    t = target.where(F.col(hit).isNotNull())
    base = t.groupBy("ticker").agg(F.avg(F.col(hit).cast("double")).alias("p_base")).where("p_base > 0 and p_base < 1")
    on = active.select("ticker", "event_id", "rn").join(t.select("ticker", "rn", hit), ["ticker", "rn"]).groupBy("ticker", "event_id").agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("double")).alias("p_event")).where(F.col("n") >= least)
    out = on.join(base, "ticker").withColumn("lift", F.col("p_event") / F.col("p_base"))
    return out.withColumn("z", (F.col("p_event") - F.col("p_base")) / F.sqrt(F.col("p_base") * (1 - F.col("p_base")) / F.col("n"))).select("ticker", "event_id", "n", "p_event", "p_base", "lift", "z")


def search_null(active: DataFrame, fwd: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``(ticker, offsets, real, p, bar)``: the whole search against rotations.

    For each circular shift the largest ``|z|`` over all events and horizons (with at
    least two valid active bars) is taken; the search's own is shift 0.
    """
    import pyarrow as pa

    def run(groups):
        best = None
        for ticker, series, event, mask in groups:
            for s in series if event is not None else ():
                if not s.valid.any():
                    continue
                mu, count = s.under(mask)
                d = mu - s.mean
                sd = np.nanstd(d[1:]) if np.isfinite(d[1:]).sum() > 1 else np.nan
                if sd > 0:
                    z = np.abs(np.where(count >= 1.5, d / sd, np.nan))
                    best = z if best is None else np.fmax(best, z)
            if event is None and best is not None:  # the end of a block: one row per shift
                k = np.flatnonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array([ticker] * len(k), pa.string()), pa.array(k), pa.array(best[k])], ["ticker", "offset", "z"])
                best = None

    best = _past_series(active, fwd, run, "ticker string, offset long, z double").groupBy("ticker", "offset").agg(F.max("z").alias("z"))
    real = best.where("offset = 0").select("ticker", F.col("z").alias("real"))
    null = best.where("offset > 0").join(real, "ticker")
    out = null.groupBy("ticker").agg(F.count("*").alias("offsets"), F.first("real").alias("real"), F.sum((F.col("z") >= F.col("real")).cast("long")).alias("above"), F.percentile("z", F.lit(1 - alpha)).alias("bar"))
    return out.select("ticker", "offsets", "real", ((1 + F.col("above")) / (1 + F.col("offsets"))).alias("p"), "bar")


def rotated(bars: DataFrame, shifts: list[int], source: str = "close") -> DataFrame:
    """Bars with ``source`` shifted around circularly, once for each draw: adds ``draw``; all draws run as one job."""
    n = Window.partitionBy("ticker")
    own = bars.withColumn("__n", F.count("*").over(n))
    values = own.select("ticker", F.col("rn").alias("__from"), F.col(source).alias("__v"))
    draws = F.explode(F.array(*(F.struct(F.lit(i).alias("draw"), F.lit(k).alias("k")) for i, k in enumerate(shifts)))).alias("d")
    out = own.select("*", draws).withColumn("draw", F.col("d.draw")).withColumn("__from", (F.col("rn") + F.col("d.k")) % F.col("__n"))
    return out.join(values, ["ticker", "__from"]).withColumn(source, F.col("__v")).drop("__from", "__v", "__n", "d")


def tippett(p: dict[str, float], null: dict[str, list[float]]) -> float:
    """P-value of the least of several p-values, against the null draws' own least ones."""
    empirical = lambda v, a: (1 + sum(x >= v for x in a)) / (1 + len(a))
    real = min(p.values())
    n = min(map(len, null.values()))
    mins = [min(empirical(a[i], a) for a in null.values()) for i in range(n)]
    return (1 + sum(m <= real for m in mins)) / (1 + n)
