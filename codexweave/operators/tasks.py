"""Tasks, their attempts, pages and leases, replayed from event logs.

Every fold is an aggregate by key: of a hot task only partial states are shuffled, and windows
are over a task's attempts, never over its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attempt_numbers(starts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``starts`` with ``attempt``: the number of each start within its task, from 1."""
    return starts.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def page_states(events: DataFrame, keys: list[str], order: list[str], started: Column, completed: Column, failed: Column) -> DataFrame:
    """``keys, state, n_starts, n_failures, late_starts``: what each page came to.

    A completed page stays so: failures after it count for nothing, and starts after it are
    told as late. Before that the last event holds, and a failure counts once until the page
    is started again.
    """
    at = F.struct(*order)
    done = F.min(F.when(completed, at))
    first = events.groupBy(*keys).agg(done.alias("done"), F.max(F.when(started, at)).alias("start"), F.max(F.when(failed, at)).alias("fail"))
    marked = events.join(first.select(*keys, "done"), keys)
    late = F.col("done").isNotNull() & (at > F.col("done"))
    counts = marked.groupBy(*keys).agg(
        F.count_if(started & ~late).alias("n_starts"), F.count_if(failed & ~late).alias("n_failures"), F.count_if(started & late).alias("late_starts")
    )
    open_state = F.when(F.col("fail").isNull() & F.col("start").isNull(), "unknown").when(F.col("fail").isNull() | (F.col("start") > F.col("fail")), "started").otherwise("failed")
    return first.join(counts, keys).select(*keys, F.when(F.col("done").isNotNull(), "completed").otherwise(open_state).alias("state"), "n_starts", "n_failures", "late_starts")


def claimable(queued: DataFrame, leases: DataFrame, key: str, order: list[str], now: Column) -> DataFrame:
    """Queued tasks without a lease that is live at ``now``; ``leases`` has the key and expires_at."""
    live = leases.where(F.col("expires_at") > now).select(key)
    return queued.join(live, key, "left_anti").orderBy(*order)


def claimed(queued: DataFrame, leases: DataFrame, key: str, order: list[str], now: Column) -> DataFrame:
    """The oldest claimable task, as one row or none: a top-1, not a sort of the queue."""
    free = claimable(queued, leases, key, order, now)
    return free.agg(F.min_by(F.struct(*free.columns), F.struct(*order)).alias("t")).where("t IS NOT NULL").select("t.*")


def lease_tokens(log: DataFrame, key: str, order: list[str], taken_at: str, seconds: int) -> DataFrame:
    """``log`` of requests with ``granted`` and ``token``: a lease is given when it is free or has run out.

    Requests come in order; one is granted if the last granted one before it is ``seconds`` or
    more ago. A fold over each key's requests, which are one narrow row each.
    """
    at = F.struct(*order, F.col(taken_at).alias("_t"))
    ordered = log.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("r"))
    begin = F.struct(F.lit(None).cast("timestamp").alias("since"), F.lit(0).alias("token"), F.array().cast("array<struct<token:int,granted:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        t = x["_t"].cast("timestamp")
        free = acc["since"].isNull() | (F.unix_timestamp(t) - F.unix_timestamp(acc["since"]) >= seconds)
        token = acc["token"] + free.cast("int")
        return F.struct(F.when(free, t).otherwise(acc["since"]).alias("since"), token.alias("token"), F.concat(acc["out"], F.array(F.struct(token.alias("token"), free.alias("granted")))).alias("out"))

    told = ordered.select(key, F.arrays_zip("r", F.aggregate("r", begin, step, lambda acc: acc["out"]).alias("g")).alias("z"))
    return told.select(key, F.explode("z").alias("z")).select(key, *[F.col(f"z.r.{c}") for c in order], "z.g.granted", "z.g.token")


def task_reports(tasks: DataFrame, attempts: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Each task with its number of attempts, the last one, and its events by kind as a sorted map.

    ``attempts`` has the key and attempt, ``events`` the key and kind; tasks without either
    have nulls and empty maps.
    """
    tries = attempts.groupBy(key).agg(F.count("*").alias("n_attempts"), F.max("attempt").alias("last_attempt"))
    kinds = events.groupBy(key, "kind").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("e"))
    rows = tasks.join(tries, key, "left").join(kinds, key, "left")
    entries = F.coalesce("e", F.array().cast("array<struct<kind:string,n:bigint>>"))
    told = F.array_join(F.transform(entries, lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ",")
    return rows.withColumn("events", told).drop("e")


def completed_once(results: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """``key, is_completed``: whether a book's last result completed it; a later failure undoes it."""
    return results.groupBy(key).agg(F.max_by(done, F.struct(*order)).alias("is_completed"))


def book_states(books: DataFrame, active: DataFrame, completed: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """``books`` with ``state``: active before completed before failed before pending."""
    rows = books
    for name, told in (("active", active), ("completed", completed), ("failed", failed)):
        rows = rows.join(told.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    state = F.when(F.col("_active"), "active").when(F.col("_completed"), "completed").when(F.col("_failed"), "failed").otherwise("pending")
    return rows.withColumn("state", state).drop("_active", "_completed", "_failed")


#: Seconds without a heartbeat, of start-up, without progress and without a first page. Fixed values.
DEAD, GRACE, STUCK, NO_FIRST_PAGE = 90, 120, 600, 600


def liveness_states(beats: DataFrame, key: str, now: Column) -> DataFrame:
    """``key, state``: workers at ``now``, from heartbeats with the key, ts and pages done.

    ``starting`` within the grace after the first beat; ``dead`` without a beat for 90 s;
    ``no first page`` and ``stuck`` after 600 s without progress; else ``alive``.
    """
    done = beats.groupBy(key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("pages").alias("pages"))
    since = beats.join(done.select(key, F.col("pages").alias("most")), key).where(F.col("pages") == F.col("most")).groupBy(key).agg(F.min("ts").alias("progress"))
    age = lambda c: F.timestamp_diff("SECOND", F.col(c), now)
    none = F.coalesce(F.col("pages"), F.lit(0)) == 0
    state = (
        F.when((age("last") >= DEAD) & (age("first") >= GRACE), "dead").when(age("first") < GRACE, "starting").when(none & (age("first") >= NO_FIRST_PAGE), "no first page")
        .when(~none & (age("progress") >= STUCK), "stuck").otherwise("alive")
    )
    return done.join(since, key, "left").select(key, state.alias("state"))


def idempotency_key(columns: list[str]) -> Column:
    """A digest of a request's named values in one canonical form: names in order, nulls as such."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.array(F.col(c))), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def new_requests(requests: DataFrame, known: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first of equal ``requests`` by ``order``, with ``request_key``, that ``known`` keys do not hold yet."""
    keyed = requests.withColumn("request_key", idempotency_key(columns))
    first = keyed.groupBy("request_key").agg(F.min_by(F.struct(*requests.columns), F.struct(*order)).alias("r"))
    return first.join(known.select("request_key"), "request_key", "left_anti").select("request_key", "r.*")
