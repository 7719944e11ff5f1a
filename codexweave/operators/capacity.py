"""Candidates of workers and threads, their trials, and NULL-aware resource totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def candidate_matrix(spark: SparkSession, logical: int, max_workers: int = 4, reserve: int = 2, threads: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """``candidate, workers, threads``: one worker with each thread count, and more that fit."""
    options = spark.createDataFrame([(t,) for t in threads], "threads int")
    workers = spark.range(1, max_workers + 1).select(F.col("id").cast("int").alias("workers"))
    pairs = workers.join(options, (F.col("workers") == 1) | (F.col("workers") * F.col("threads") <= max(1, logical - reserve)))
    return pairs.select(F.format_string("%dx%d", "workers", "threads").alias("candidate"), "workers", "threads").distinct()


def trial_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, least, and interpolated 50th and 95th percentile of a value by key."""
    return samples.groupBy(key).agg(
        F.count(value).alias("n"),
        F.round(F.sum(value), 3).alias("total"),
        F.min(value).alias("least"),
        F.round(F.percentile(value, F.lit(0.5)), 3).alias("p50"),
        F.round(F.percentile(value, F.lit(0.95)), 3).alias("p95"),
    )


#: Why a trial is no candidate, in the order the reasons are given. Fixed values.
REASONS = ("质量门禁未通过", "未取得有效吞吐率", "存在失败页", "可用内存触及保留水位", "整机CPU超过安全护栏")
WORSE = "低置信页比例相对单 worker 基线回退"
CPU_LIMIT, AIM_PERCENT = 92.0, 80.0


#: What a trial may leave unknown.
OPTIONAL = {"quality_passed": "boolean", "available_memory_gb": "double", "system_cpu_percent": "double", "rss_mb": "double", "thread_use_percent": "double", "foreign_cpu_percent": "double"}


def _with_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in rows.columns])


def evaluated_trials(trials: DataFrame, reserve_memory_gb: float = 2.0, slack: float = 0.03) -> DataFrame:
    """``trials`` with ``reasons`` against each, ``valid``, ``speedup`` over the baseline and ``efficiency``.

    Needs candidate, workers, threads, pages_per_minute, failed_pages, low_confidence_ratio,
    quality_passed, available_memory_gb and system_cpu_percent; unknown memory, CPU and gates
    speak against nobody. The baseline is the fastest sound trial with one worker; a trial of
    which more pages are doubtful by ``slack`` drops out. Without a baseline speedups are null.
    """
    whole = Window.partitionBy()  # a trial table has one row per candidate
    trials = _with_columns(trials, OPTIONAL)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    tests = (
        ~F.coalesce("quality_passed", F.lit(True)), n("pages_per_minute") <= 0, n("failed_pages") > 0,
        F.coalesce(F.col("available_memory_gb") <= reserve_memory_gb, F.lit(False)), F.coalesce(F.col("system_cpu_percent") > CPU_LIMIT, F.lit(False)),
    )
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)]))
    rows = trials.withColumn("reasons", reasons)
    sound = (F.size("reasons") == 0) & (F.col("workers") == 1)
    base = F.max(F.when(sound, F.struct(F.round("pages_per_minute", 3).alias("rate"), F.round(n("low_confidence_ratio"), 4).alias("low"), "candidate"))).over(whole)
    rows = rows.withColumn("_base", base)
    worse = (F.size("reasons") == 0) & F.coalesce(F.round(n("low_confidence_ratio"), 4) > F.col("_base.low") + slack, F.lit(False))
    rows = rows.withColumn("reasons", F.when(worse, F.concat("reasons", F.array(F.lit(WORSE)))).otherwise(F.col("reasons")))
    valid = F.size("reasons") == 0
    speedup = F.when(valid, F.round("pages_per_minute", 3) / F.col("_base.rate"))
    return rows.select(
        *trials.columns, "reasons", (valid & F.col("_base").isNotNull()).alias("valid"), F.round(speedup, 3).alias("speedup"), F.round(speedup / F.col("workers"), 3).alias("efficiency"), F.col("_base.rate").alias("baseline_rate")
    )


def best_trial(trials: DataFrame, reserve_memory_gb: float = 2.0, slack: float = 0.03, gain: float = 0.05) -> DataFrame:
    """``candidate, workers, threads, pages_per_minute``: the winner of the trials, nulls without a baseline.

    More workers must gain ``gain`` over the baseline. Of those within ``gain`` of the fastest
    the one with fewest threads wins, then fewest workers, least memory (unknown or 0 last),
    thread use nearest to 80 %, least foreign CPU (unknown or 0 last), most pages.
    """
    whole = Window.partitionBy()
    rate = F.round("pages_per_minute", 3)
    fit = (F.col("workers") <= 1) | (rate >= F.col("baseline_rate") * (1.0 + gain))
    near = evaluated_trials(trials, reserve_memory_gb, slack).where(F.col("valid") & fit).withColumn("_peak", F.max(rate).over(whole)).where(rate >= F.col("_peak") * (1.0 - gain))
    known = lambda c: F.coalesce(F.nullif(F.round(F.col(c), 3), F.lit(0.0)), F.lit(float("inf")))
    order = F.struct(
        (F.col("workers") * F.col("threads")).alias("a"), F.col("workers").alias("b"), known("rss_mb").alias("c"), F.abs(F.coalesce(F.round("thread_use_percent", 3), F.lit(0.0)) - AIM_PERCENT).alias("d"), known("foreign_cpu_percent").alias("e"), (-rate).alias("f"), F.col("candidate").alias("g")
    )
    return near.agg(F.min_by(F.struct("candidate", "workers", "threads", "pages_per_minute"), order).alias("w")).select("w.*")


def unsettled(candidates: DataFrame, trials: DataFrame) -> DataFrame:
    """The candidates without a trial; none of them means that all are settled."""
    return candidates.join(trials.select("candidate"), "candidate", "left_anti")


def fixture_pages(spark: SparkSession, page_count: int, workers: int, sample: int, warmup: int) -> DataFrame:
    """``worker, at, page``: the pages, from 0, that each worker of a benchmark reads, in order.

    All measure the same pages from the middles of even strata, dealt out in turn; the pages
    before them to warm up, the first that are not measured, are each worker's own.
    """
    if page_count < sample + workers * warmup or sample < workers:
        raise ValueError("too few pages, or fewer measured pages than workers")
    measured = spark.range(sample).select(F.col("id").alias("i"), F.least(F.lit(page_count - 1), F.floor((F.col("id") + 0.5) * page_count / sample)).cast("int").alias("page"))
    even = page_count >= sample and len({min(page_count - 1, int((i + 0.5) * page_count / sample)) for i in range(sample)}) == sample
    measured = measured if even else measured.withColumn("page", F.col("i").cast("int"))
    free = spark.range(sample + workers * warmup).select(F.col("id").cast("int").alias("page")).join(measured.select("page"), "page", "left_anti")
    rank = F.row_number().over(Window.orderBy("page")) - 1  # as many rows as a benchmark has pages
    warm = free.select("page", rank.alias("i")).where(F.col("i") < workers * warmup)
    first = warm.select(F.floor(F.col("i") / max(warmup, 1)).cast("int").alias("worker"), F.pmod("i", F.lit(max(warmup, 1))).cast("int").alias("at"), "page")
    then = measured.select(F.pmod("i", F.lit(workers)).cast("int").alias("worker"), (F.floor(F.col("i") / workers) + warmup).cast("int").alias("at"), "page")
    return first.unionByName(then)


#: Seconds a page costs by engine, and how modes multiply them. Fixed values.
DIRECT_SECONDS, ENGINE_SECONDS, OTHER_ENGINE = 0.05, {"paddleocr": 42.0, "paddleocr_gpu": 24.0, "tesseract": 40.0, "none": 0.0}, 3.0
MODE_FACTORS = {"book-fast": 0.75, "book-balanced": 1.0, "book-quality": 1.8, "book-forensic": 3.0}


def estimated_seconds(pages: Column, mode: Column, engine: Column, direct: Column) -> Column:
    """Seconds a job will take: by page of the text layer, at least one, or by engine and mode; null for unknown modes."""
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    base = F.coalesce(F.try_element_at(table(ENGINE_SECONDS), engine), F.lit(OTHER_ENGINE))
    return F.when(direct, F.greatest(F.lit(1.0), F.bround(pages * DIRECT_SECONDS))).otherwise(F.bround(pages * base * F.try_element_at(table(MODE_FACTORS), mode))).cast("long")


def thread_budget(pages: Column, capacity: Column, free_slots: Column | None = None, high: bool = False) -> Column:
    """Threads of a new worker, 1 to 4: two from 80 pages, three and four from 200 and 400 where that is allowed."""
    n = F.greatest(F.coalesce(pages, F.lit(0)), F.lit(0))
    wish = F.when(n < 80, 1).when((n >= 400) & F.lit(high), 4).when((n >= 200) & F.lit(high), 3).otherwise(2)
    most = F.greatest(F.lit(1), capacity)
    most = most if free_slots is None else F.least(most, F.greatest(F.lit(1), F.coalesce(free_slots, most)))
    return F.greatest(F.lit(1), F.least(F.lit(4), wish, most))


def resource_totals(samples: DataFrame, key: str, logical_cpus: int = 8, memory_capacity_mb: float | None = None) -> DataFrame:
    """Totals of workers' samples by key: null where nothing is known, and how much is known.

    Needs pid, cpu_percent (of the machine), memory_mb and n_threads. Cores are cpu_percent of
    all logical ones; the share of the machine is at most 100.
    """
    samples = _with_columns(samples, {"pid": "long", "n_threads": "int"})
    cores = F.round(F.sum(F.when(F.col("cpu_percent").isNotNull(), F.greatest(F.col("cpu_percent") / 100.0 * max(1, logical_cpus), F.lit(0.0)))), 2)
    whole = F.col("cpu_percent").isNotNull() & F.col("memory_mb").isNotNull() & F.col("n_threads").isNotNull()
    rows = samples.groupBy(key).agg(
        F.count("*").alias("n_workers"), F.count("pid").alias("n_pids"), F.count("cpu_percent").alias("cpu_known"), F.count("memory_mb").alias("memory_known"),
        (F.count_if(whole) == F.count("*")).alias("is_complete"), F.sum("n_threads").alias("n_threads"), F.round(F.sum("memory_mb"), 1).alias("memory_mb"), cores.alias("cpu_cores"),
    )
    share = F.when(F.col("cpu_cores").isNotNull(), F.round(F.least(F.lit(100.0), F.col("cpu_cores") / max(1, logical_cpus) * 100.0), 1))
    rows = rows.withColumn("cpu_percent", share)
    return rows.withColumn("memory_percent", F.round(F.col("memory_mb") / memory_capacity_mb * 100.0, 2)) if memory_capacity_mb else rows


def thread_metrics(samples: DataFrame) -> DataFrame:
    """Adds active and saturated threads and the use of the thread budget from thread_cpu_percent."""
    used = F.map_values("thread_cpu_percent")
    top = F.slice(F.sort_array(used, asc=False), 1, F.greatest(F.col("thread_budget"), F.lit(1)))
    return samples.select(
        "*",
        F.size(F.filter(used, lambda p: p >= 5)).alias("active_threads"),
        F.size(F.filter(used, lambda p: p >= 80)).alias("saturated_threads"),
        F.least(F.lit(100.0), F.aggregate(top, F.lit(0.0), lambda a, p: a + p) / F.col("thread_budget")).alias("budget_use_percent"),
    )


def thread_usage(before: DataFrame, after: DataFrame, seconds: float) -> DataFrame:
    """``pid, thread, cpu_percent`` of the threads seen in both samples (pid, thread, cpu_seconds), 0 to 100."""
    then = before.select("pid", "thread", F.col("cpu_seconds").alias("_then"))
    used = (F.col("cpu_seconds") - F.col("_then")) / max(seconds, 0.001) * 100.0
    return after.join(then, ["pid", "thread"]).select("pid", "thread", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), used)), 3).alias("cpu_percent"))
