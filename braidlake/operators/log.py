"""Ordered application, staging, gaps, admission, retention, progress and peers of transaction logs (origin, sequence, ...).

A log may hold a place more than once (redelivery). Running totals over an origin's log go in two steps: within ranges of RANGE sequences, which many
tasks share, and over the ranges, of which there is one row each; so no task sorts a whole origin's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequences in a range.
RANGE = 1 << 16
#: Rows of an origin that retention keeps at least, rows of a pass, days after which a peer no longer counts, and the lookahead of a sender.
KEPT, PASS, PEER_DAYS, AHEAD, IN_FLIGHT = 256, 2048, 7, 16, 1024
#: States of a member in rising rank.
MEMBER = {"alive": 0, "suspect": 1, "dead": 2, "left": 3}


def ranged(log: DataFrame, size: int = RANGE) -> DataFrame:
    """``log`` with ``__range``: the number of the range of sequences."""
    return log.withColumn("__range", F.floor(F.col("sequence") / F.lit(size)).cast("long"))


def running(log: DataFrame, totals: dict[str, Column], size: int = RANGE) -> DataFrame:
    """``log`` with the running sum of each of ``totals`` up to and with each row, by origin in the order of sequence."""
    rows = ranged(log, size)
    rows = rows.withColumns({f"__v_{name}": value for name, value in totals.items()})
    own = Window.partitionBy("origin", "__range").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__o").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("origin").alias("__o"), F.col("__range").alias("__r")).agg(*[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in totals])
    sums = sums.select("__o", "__r", *[F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__b_{name}") for name in totals])
    both = rows.join(sums, (F.col("origin") == F.col("__o")) & (F.col("__range") == F.col("__r")))
    out = both.withColumns({name: F.col(f"__b_{name}") + F.sum(f"__v_{name}").over(own) for name in totals})
    return out.drop("__range", "__o", "__r", *[f"__{p}_{name}" for p in "vsb" for name in totals])


def distinct_places(log: DataFrame, payload: str | None = None) -> DataFrame:
    """One row for each (origin, sequence). With ``payload``, two deliveries of a place that differ in it are a conflict and raise."""
    if payload is None:
        return log.dropDuplicates(["origin", "sequence"])
    rest = [c for c in log.columns if c not in ("origin", "sequence")]
    per = log.groupBy("origin", "sequence").agg(F.min(payload).alias("__low"), F.max(payload).alias("__high"), F.first(F.struct(*rest)).alias("__row"))
    sure = F.when(F.col("__low").eqNullSafe(F.col("__high")), F.lit(True)).otherwise(F.raise_error(F.lit("corrupt: a place of the log was delivered with two payloads")).cast("boolean"))
    return per.filter(sure).select("origin", "sequence", "__row.*").select(log.columns)


def staged(incoming: DataFrame, floors: DataFrame, pending: DataFrame, digest: str = "digest") -> DataFrame:
    """(origin, sequence, ..., verdict) of incoming rows: duplicate (at or below the origin's floor, or pending with the same digest), conflict (pending or
    twice incoming with another digest) or new, one row for each place."""
    low = floors.select(F.col("origin").alias("__o"), F.col("floor").alias("__floor"))
    held = pending.select(F.col("origin").alias("__p"), F.col("sequence").alias("__q"), F.col(digest).alias("__d"))
    rest = [c for c in incoming.columns if c not in ("origin", "sequence")]
    per = incoming.groupBy("origin", "sequence").agg(F.count_distinct(digest).alias("__n"), F.min(F.struct(digest, *[c for c in rest if c != digest])).alias("__row"))
    both = per.join(low, F.col("origin") == F.col("__o"), "left").join(held, (F.col("origin") == F.col("__p")) & (F.col("sequence") == F.col("__q")), "left")
    verdict = (
        F.when(F.col("sequence") <= F.coalesce("__floor", F.lit(0)), "duplicate")
        .when((F.col("__n") > 1) | (F.col("__d") != F.col(f"__row.{digest}")), "conflict")
        .when(F.col("__d").isNotNull(), "duplicate")
        .otherwise("new")
    )
    return both.select("origin", "sequence", *[F.col(f"__row.{c}").alias(c) for c in rest], verdict.alias("verdict"))


def staged_totals(log: DataFrame, size: str) -> DataFrame:
    """(origin, n, bytes) of what is staged."""
    return log.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))


def first_gaps(log: DataFrame, applied: DataFrame, size: int = RANGE) -> DataFrame:
    """(origin, upto): the sequence up to which each origin's log follows its applied one without a gap.

    Ranges that are full are known by their counts; the gap lies in the first that is not, and only that one is sorted.
    """
    done = applied.select(F.col("origin").alias("__o"), F.col("applied").alias("__a"))
    rows = log.select("origin", "sequence").distinct().join(done, F.col("origin") == F.col("__o"), "left").withColumn("applied", F.coalesce("__a", F.lit(0).cast("long")))
    rows = ranged(rows.filter(F.col("sequence") > F.col("applied")).drop("__o", "__a"), size)
    per = rows.groupBy("origin", "applied", "__range").agg(F.count(F.lit(1)).alias("n"))
    # a range is full if it holds all its sequences beyond the applied one
    low, high = F.greatest(F.col("applied") + 1, F.col("__range") * size), (F.col("__range") + 1) * size - 1
    place = F.row_number().over(Window.partitionBy("origin").orderBy("__range")) - 1
    start = F.floor((F.col("applied") + 1) / F.lit(size))
    per = per.withColumn("__full", F.col("n") == high - low + 1).withColumn("__next", F.col("__range") == start + place)
    ok = (F.col("__full") & F.col("__next")).cast("int")
    before = F.coalesce(F.min(ok).over(Window.partitionBy("origin").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    # the last range reached: all before it are full, and it follows them
    last = per.withColumn("__reach", (before == 1) & F.col("__next")).filter("__reach").groupBy(F.col("origin").alias("__lo")).agg(F.max("__range").alias("__lr"))
    inside = rows.join(last, (F.col("origin") == F.col("__lo")) & (F.col("__range") == F.col("__lr")))
    n = F.row_number().over(Window.partitionBy("origin").orderBy("sequence"))
    base = F.greatest(F.col("applied"), F.col("__range") * size - 1)
    hit = inside.withColumn("__n", n).filter(F.col("sequence") == base + F.col("__n")).groupBy(F.col("origin").alias("__ho")).agg(F.max("sequence").alias("__upto"))
    known = rows.groupBy("origin").agg(F.max("applied").alias("applied"))
    ends = known.join(last, F.col("origin") == F.col("__lo"), "left").join(hit, F.col("origin") == F.col("__ho"), "left")
    reached = F.when(F.col("__lr").isNull(), F.col("applied")).otherwise(F.coalesce("__upto", F.greatest(F.col("applied"), F.col("__lr") * size - 1)))
    return ends.select("origin", reached.alias("upto"))


def contiguous(log: DataFrame, applied: DataFrame, payload: str | None = None, size: int = RANGE) -> DataFrame:
    """Rows that follow their origin's applied sequence without a gap, each place once; a gap blocks its origin alone.

    A place delivered again counts once; with ``payload``, a second delivery that differs raises.
    """
    ends = first_gaps(log, applied, size).select(F.col("origin").alias("__o"), "upto")
    done = applied.select(F.col("origin").alias("__p"), F.col("applied").alias("__a"))
    rows = log.join(ends, F.col("origin") == F.col("__o")).filter(F.col("sequence") <= F.col("upto")).join(done, F.col("origin") == F.col("__p"), "left")
    return distinct_places(rows.filter(F.col("sequence") > F.coalesce("__a", F.lit(0))).select(log.columns), payload)


def holes(log: DataFrame, size: int = RANGE) -> DataFrame:
    """(origin, first, last) of missing sequences, from 1 on."""
    rows = ranged(log.select("origin", "sequence").distinct(), size)
    own = Window.partitionBy("origin", "__range").orderBy("sequence")
    ends = rows.groupBy(F.col("origin").alias("__o"), F.col("__range").alias("__r")).agg(F.max("sequence").alias("__last"))
    ends = ends.select("__o", "__r", F.coalesce(F.lag("__last").over(Window.partitionBy("__o").orderBy("__r")), F.lit(0).cast("long")).alias("__before"))
    both = rows.join(ends, (F.col("origin") == F.col("__o")) & (F.col("__range") == F.col("__r")))
    before = F.coalesce(F.lag("sequence").over(own), F.col("__before"))
    return both.withColumn("__b", before).filter(F.col("sequence") > F.col("__b") + 1).select("origin", (F.col("__b") + 1).alias("first"), (F.col("sequence") - 1).alias("last"))


def round_robin(log: DataFrame, after: int, origins: int, size: int = RANGE) -> DataFrame:
    """Rows with ``turn`` and ``seat``: sorted by both, the origins take turns, beginning after origin ``after``."""
    turned = running(log, {"turn": F.lit(1).cast("long")}, size)
    return turned.withColumn("turn", F.col("turn").cast("int")).withColumn("seat", F.pmod(F.col("origin") - F.lit(after + 1), F.lit(origins)))


def admit(log: DataFrame, budget: int, size: str, most: int | None = None, span: int = RANGE) -> DataFrame:
    """Of each origin the first rows within a byte budget and, with ``most``, a number of rows; the first may exceed the budget."""
    rows = running(log, {"running": F.col(size), "__n": F.lit(1).cast("long")}, span)
    fits = (F.col("running") <= budget) | (F.col("__n") == 1)
    return rows.filter(fits & (F.col("__n") <= most) if most is not None else fits).drop("__n")


def retention_prefix(log: DataFrame, eligible: str) -> DataFrame:
    """Of each origin the rows before the first that is not eligible."""
    stops = log.groupBy(F.col("origin").alias("__o")).agg(F.min(F.when(~F.coalesce(F.col(eligible), F.lit(False)), F.col("sequence"))).alias("__stop"))
    return log.join(stops, F.col("origin") == F.col("__o")).filter(F.col("__stop").isNull() | (F.col("sequence") < F.col("__stop"))).drop("__o", "__stop")


def retention_floor(acks: DataFrame, bridges: DataFrame | None = None, pins: DataFrame | None = None) -> DataFrame:
    """(origin, floor): the least acknowledged sequence over live peers; a peer without one counts as 0.

    Bridges and snapshot pins (origin, floor) hold it back further. An origin that only these name has their floor; one that none names has no row: nothing holds it back.
    """
    out = acks.select("origin", F.coalesce("acked", F.lit(0)).cast("long").alias("floor"))
    for more in (bridges, pins):
        if more is not None:
            out = out.unionByName(more.select("origin", F.col("floor").cast("long").alias("floor")))
    return out.groupBy("origin").agg(F.min("floor").alias("floor"))


def kept_minimum(log: DataFrame, kept: int = KEPT, size: int = RANGE) -> DataFrame:
    """``log`` without the last ``kept`` rows of each origin, which retention never takes."""
    counts = log.groupBy(F.col("origin").alias("__o")).agg(F.count(F.lit(1)).alias("__all"))
    rows = running(log, {"__n": F.lit(1).cast("long")}, size).join(counts, F.col("origin") == F.col("__o"))
    return rows.filter(F.col("__n") <= F.col("__all") - kept).drop("__o", "__all", "__n")


def retention_pass(log: DataFrame, floors: DataFrame, eligible: str, kept: int = KEPT, most: int = PASS) -> DataFrame:
    """Rows that one pass may take: at or below the origin's floor, before the first that is not eligible, not of the last ``kept``, ``most`` of an origin at most."""
    low = floors.select(F.col("origin").alias("__f"), "floor")
    rows = retention_prefix(log.join(low, F.col("origin") == F.col("__f"), "left").withColumn("__ok", F.col(eligible) & (F.col("floor").isNull() | (F.col("sequence") <= F.col("floor")))), "__ok")
    free = kept_minimum(log.select("origin", "sequence"), kept).select(F.col("origin").alias("__ko"), F.col("sequence").alias("__ks"))
    rows = rows.join(free, (F.col("origin") == F.col("__ko")) & (F.col("sequence") == F.col("__ks")), "left_semi")
    return running(rows, {"__m": F.lit(1).cast("long")}).filter(F.col("__m") <= most).select(log.columns)


def pruned(log: DataFrame, taken: DataFrame, covered: DataFrame, pins: DataFrame) -> DataFrame:
    """``log`` without the rows of a pass that still may go: covered (origin, upto) by a snapshot and below every pin (origin, floor)."""
    up = covered.groupBy(F.col("origin").alias("__c")).agg(F.max("upto").alias("__upto"))
    held = pins.groupBy(F.col("origin").alias("__p")).agg(F.min("floor").alias("__pin"))
    gone = taken.select("origin", "sequence").join(up, F.col("origin") == F.col("__c")).join(held, F.col("origin") == F.col("__p"), "left")
    gone = gone.filter((F.col("sequence") <= F.col("__upto")) & (F.col("__pin").isNull() | (F.col("sequence") <= F.col("__pin"))))
    gone = gone.select(F.col("origin").alias("__go"), F.col("sequence").alias("__gs"))
    return log.join(gone, (F.col("origin") == F.col("__go")) & (F.col("sequence") == F.col("__gs")), "left_anti")


def in_flight(log: DataFrame, acked: DataFrame, ahead: int = AHEAD, most: int = IN_FLIGHT) -> DataFrame:
    """Rows that a sender may have under way: from the acknowledged sequence on, ``ahead`` batches of ``most`` at most, here the first ``ahead * most``."""
    done = acked.select(F.col("origin").alias("__o"), F.col("acked").alias("__a"))
    rows = log.join(done, F.col("origin") == F.col("__o"), "left").withColumn("__a", F.coalesce("__a", F.lit(0)))
    return rows.filter((F.col("sequence") > F.col("__a")) & (F.col("sequence") <= F.col("__a") + ahead * most)).drop("__o", "__a")


def appended(log: DataFrame, new: DataFrame, payload: str) -> DataFrame:
    """(origin, sequence, payload, digest) of ``new`` rows (origin, place, payload) put behind each origin's log in the order of place."""
    last = log.groupBy(F.col("origin").alias("__o")).agg(F.max("sequence").alias("__last"))
    rows = running(new.withColumnRenamed("place", "sequence"), {"__n": F.lit(1).cast("long")}).join(last, F.col("origin") == F.col("__o"), "left")
    sequence = F.coalesce("__last", F.lit(0)) + F.col("__n")
    text = F.concat_ws(":", F.col("origin").cast("string"), sequence.cast("string"), F.col(payload))
    return rows.select("origin", sequence.cast("long").alias("sequence"), payload, F.sha2(text, 256).alias("digest"))


# ---- progress, peers, members


def progress_max(reports: DataFrame) -> DataFrame:
    """(origin, applied, observed) that only ever rise."""
    return reports.groupBy("origin").agg(F.max("applied").alias("applied"), F.max("observed").alias("observed"))


def progress_assembled(retained: DataFrame, applied: DataFrame, observed: DataFrame) -> DataFrame:
    """(origin, applied, observed, retained_from, retained_through) of three tables; what is applied has been observed."""
    r = retained.select("origin", "retained_from", "retained_through")
    both = r.join(applied.select("origin", F.col("applied").alias("__a")), "origin", "full").join(observed.select("origin", F.col("observed").alias("__b")), "origin", "full")
    a, b = F.coalesce("__a", F.lit(0).cast("long")), F.coalesce("__b", F.lit(0).cast("long"))
    return both.select("origin", a.alias("applied"), F.greatest(a, b).alias("observed"), F.coalesce("retained_from", F.lit(0).cast("long")).alias("retained_from"), F.coalesce("retained_through", F.lit(0).cast("long")).alias("retained_through"))


def missing_history(peer: DataFrame, local: DataFrame) -> DataFrame:
    """(origin, action, first, last): what to ask a peer for: the range beyond the local applied sequence, a snapshot if the peer no longer retains
    its beginning, or nothing."""
    mine = local.select(F.col("origin").alias("__o"), F.col("applied").alias("__mine"))
    both = peer.join(mine, F.col("origin") == F.col("__o"), "left").withColumn("__mine", F.coalesce("__mine", F.lit(0).cast("long")))
    action = F.when(F.col("applied") <= F.col("__mine"), "none").when(F.col("retained_from") > F.col("__mine") + 1, "snapshot").otherwise("range")
    both = both.withColumn("action", action)
    ask = lambda c: F.when(F.col("action") == "range", c)
    return both.select("origin", "action", ask(F.col("__mine") + 1).alias("first"), ask(F.col("applied")).alias("last"))


def lagging(progress: DataFrame, most: int = 1000, seconds: int = 30) -> DataFrame:
    """(origin, snapshot): whether an origin's lag, of over ``most`` transactions for ``seconds``, calls for a snapshot; ``progress`` has behind and since (seconds)."""
    return progress.select("origin", ((F.col("behind") > most) & (F.col("since") >= seconds)).alias("snapshot"))


def peers(seen: DataFrame, now, days: int = PEER_DAYS) -> DataFrame:
    """(peer, last_seen, status) of reports (peer, at, retired): retired for good, live, or away after ``days`` without one."""
    per = seen.groupBy("peer").agg(F.max("at").alias("last_seen"), F.max("retired").alias("__r"))
    status = F.when(F.col("__r"), "retired").when(F.col("last_seen") >= now - F.expr(f"INTERVAL {days} DAYS"), "live").otherwise("away")
    return per.select("peer", "last_seen", status.alias("status"))


def members(reports: DataFrame, own: str | None = None) -> DataFrame:
    """(node, incarnation, state) of reports by greatest incarnation, then rank of state; ``own`` refutes a suspicion of itself by a higher incarnation."""
    rank = F.lit(None).cast("int")
    for name, value in MEMBER.items():
        rank = F.when(F.col("state") == name, value).otherwise(rank)
    per = reports.groupBy("node").agg(F.max(F.struct("incarnation", rank.alias("rank"), "state")).alias("m"))
    refuted = (F.col("node") == F.lit(own)) & F.col("m.state").isin("suspect", "dead") if own is not None else F.lit(False)
    return per.select("node", (F.col("m.incarnation") + F.when(refuted, 1).otherwise(0)).alias("incarnation"), F.when(refuted, "alive").otherwise(F.col("m.state")).alias("state"))


def segment_ratios(records: DataFrame, live: str, segment: str = "segment") -> DataFrame:
    """(segment, ratio): the share of each segment's records that are live."""
    return records.groupBy(segment).agg(F.avg(F.when(F.col(live), 1.0).otherwise(0.0)).alias("ratio"))


def compactable(ratios: DataFrame, threshold: float = 0.2, segment: str = "segment") -> DataFrame:
    """(segment): the oldest segment whose share of live records is at or below the threshold."""
    return ratios.filter(F.col("ratio") <= threshold).agg(F.min(segment).alias(segment)).filter(F.col(segment).isNotNull())
