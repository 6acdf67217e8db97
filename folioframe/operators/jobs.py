"""Job states, attempt logs and chunked results as tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import fixed_values as V
from folioframe.operators import continuation as C

TERMINAL = ["done", "failed"]
QUEUED = "queued"


def progress_percent(phase="phase", tier="tier_index", chunk="chunk_index", total="total_chunks"):
    """(percent, status) of an event; null where the event does not move the bar."""
    p = F.col(phase)
    step = F.floor(60.0 * (F.greatest(F.lit(0), F.coalesce(chunk, F.lit(0))) + 1) / F.greatest(F.lit(1), F.coalesce(F.expr(f"nullif({total}, 0)"), F.lit(1))) + 0.5)
    chunked = F.least(F.lit(90), 25 + step.cast("int"))
    fixed = F.create_map(*[F.lit(x) for k, (pct, _) in V.PROGRESS.items() for x in (k, pct)])
    status = F.create_map(*[F.lit(x) for k, (_, st) in V.PROGRESS.items() for x in (k, st)])
    percent = F.when(p == "batch_attempt", F.when(F.col(tier) == 0, 15).otherwise(0)).when(p == "chunk_progress", chunked).otherwise(F.try_element_at(fixed, p))
    state = F.when(p == "batch_attempt", F.when(F.col(tier) == 0, "analyzing").otherwise("fallback")).when(p == "chunk_progress", "analyzing").otherwise(F.try_element_at(status, p))
    return percent, state


def progress_view(events: DataFrame) -> DataFrame:
    """Works on a table and on a stream."""
    percent, state = progress_percent()
    return events.withColumn("percent", percent).withColumn("status", state)


def _status(phase):
    """A job whose last event is its admission still waits; every other open job runs."""
    return F.when(phase.isin(*TERMINAL, QUEUED), phase).otherwise("running")


def job_status(events: DataFrame) -> DataFrame:
    """Current phase per job. The first terminal event stays; what comes after it does not count.

    Plain mergeable aggregates, so a job with a third of all events is pre-aggregated everywhere.
    """
    at = F.struct("ts", "event_id")
    row = F.struct("phase", "message", "ts")
    ended = F.col("phase").isin(*TERMINAL)
    g = events.groupBy("job_id").agg(
        F.min_by(row, F.when(ended, at)).alias("end"), F.max_by(row, at).alias("now"), F.min("ts").alias("created_at"))
    shown = F.coalesce("end", "now")
    return g.select(
        "job_id", shown["phase"].alias("phase"), _status(shown["phase"]).alias("status"),
        F.when(F.col("end.phase") == "failed", F.col("end.message")).alias("error"), "created_at", F.col("end.ts").alias("finished_at"))


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to and including the first terminal one of their job."""
    at = F.struct("ts", "event_id")
    ends = events.where(F.col("phase").isin(*TERMINAL)).groupBy("job_id").agg(F.min(at).alias("end"))
    return events.join(ends, "job_id", "left").where(F.col("end").isNull() | (at <= F.col("end"))).drop("end")


def classify_attempt(rc="rc", error_type="error_type", message="message"):
    """ok, cuda_oom, oom, or error, from exit code and status of a run; no status means it was killed."""
    known, err, code = F.col(error_type).isNotNull(), F.col(error_type), F.col(rc)
    msg = F.coalesce(F.col(message), F.lit(""))
    cuda_text = (
        msg.contains("CUDA error: unknown error") | msg.contains("cudaErrorUnknown") | msg.contains("CUDA out of memory")
        | msg.contains("CUBLAS_STATUS_ALLOC_FAILED"))
    cuda = (known & (err.isin("CUDAOutOfMemoryError", "AcceleratorError") | cuda_text)) | (code == 138)
    memory = (known & err.isin("MemoryError", "CUDAOutOfMemoryError", "Timeout", "HardKill")) | (~known & (code != 0))
    return F.when((code == 0) & (~known | (err == "")), "ok").when(cuda, "cuda_oom").when(memory, "oom").otherwise("error")


def attempt_stats(attempts: DataFrame) -> DataFrame:
    outcome = classify_attempt()
    return attempts.withColumn("outcome", outcome).groupBy("device", "batch", "chunk_size").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("outcome") == "oom").alias("oom"), F.count_if(F.col("outcome") == "cuda_oom").alias("cuda_oom"),
        F.count_if(F.col("outcome") == "error").alias("errors"), F.round(F.avg("pdf_mb"), 2).alias("avg_mb"))


def trailing_history(attempts: DataFrame, keep: int = V.HISTORY_LENGTH) -> DataFrame:
    """The last ``keep`` attempts of each profile; only that many rows per task reach the final ranking."""
    w = Window.partitionBy("profile").orderBy(F.desc("ts"), F.desc("attempt_id"))
    return attempts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def classify_model_error(status="status", code="code", detail="detail"):
    s, d = F.col(status), F.lower(F.coalesce(F.col(detail), F.lit("")))
    upstream = (
        F.when(d.contains("truncated") | d.contains("max_tokens"), "truncated").when(d.contains("invalid json"), "invalid_json")
        .when(d.contains("429") | d.contains("rate") | d.contains("quota"), "rate_limit")
        .when(d.contains("empty response"), "empty").otherwise("transient"))
    return (
        F.when(F.coalesce(F.col(code), F.lit("")) == "ECONNABORTED", "timeout").when(s.isNull(), "no_connection")
        .when(s == 400, "bad_request").when(s == 502, upstream).when(s >= 500, "server").otherwise("unexpected"))


def is_retryable(status="status", code="code"):
    s = F.col(status)
    network = s.isNull() & (F.coalesce(F.col(code), F.lit("")) != "ECONNABORTED")
    return network | F.coalesce(s.isin(*V.RETRYABLE_STATUSES), F.lit(False))


def retry_delay_ms(attempt="attempt"):
    """Wait before the next attempt; none after the last."""
    return F.when(F.col(attempt) < V.MAX_ATTEMPTS, (1000 * F.pow(F.lit(2), F.col(attempt) - 1)).cast("int"))


def concat_chunks(linear: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of chunked results with their page and number in the whole document.

    ``chunks``: doc_id, chunk, page_offset. One summary row per chunk carries the numbering.
    """
    size = linear.groupBy("doc_id", "chunk").agg((F.max("ri") + 1).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.join(size, ["doc_id", "chunk"], "left").withColumn(
        "ri_offset", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)))
    moved = linear.join(offsets.select("doc_id", "chunk", "page_offset", "ri_offset"), ["doc_id", "chunk"])
    out = {"page": F.col("page") + F.col("page_offset"), "ri": (F.col("ri") + F.col("ri_offset")).cast("int")}
    cols = [c for c in linear.columns if c not in ("chunk", "span")]
    from folioframe.sources.layout import span_of

    return moved.select(*[out[c].alias(c) if c in out else F.col(c) for c in cols]).withColumn("span", span_of("page"))


def stitch_chunks(linear: DataFrame, chunks: DataFrame) -> DataFrame:
    """One document from its chunks; continuations are found again over the whole."""
    whole = C.with_layout_type(concat_chunks(linear, chunks).drop("layout_type"))
    return C.continuation_linear(whole).drop("min_x0", "max_x1")
