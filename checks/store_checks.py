"""The store of analyses, arriving documents and job states as streams, run over whole tables."""

import uuid

from pyspark.sql import functions as F

from checks import sqlkit as K
from checks.answer_checks import _PE, _PHASES, progress_events
from checks.flow_checks import BOX, PLAIN, linear_rows_of, page_rows_of
from checks.registry import blocks, check, documents_in_place, page_tables, table
from folioframe import schemas
from folioframe.session import settle, shared_folder
from folioframe.sources import catalog, sample_layout
from folioframe.sources.layout import read_layout
from folioframe.sources.store import BucketStore
from folioframe.streaming import jobs as SJ


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _nested(pages, page_rows, linear, docs, filename):
    info = docs.select("doc_id", filename.alias("filename"), F.lit(None).cast("string").alias("language"), F.lit(None).cast(schemas.GLOBAL_MAP).alias("global_map"))
    none = page_rows.where("1 = 0").withColumns({"seq": F.lit(0), "part": F.lit(0), "source_type": F.lit("")})
    linear = linear.withColumns({"flat_block_ref": F.lit(None).cast("int"), "layout_type": F.lit(None).cast("string")})
    return catalog.nest_analysis(pages, page_rows, linear, none, info)


@check("stored_analyses", K.sql("""select doc_id, page, ri, kind, "role", case when kind = 'image' then '' else text end text, x0, y0, x1, y1, case when doc_id % 3 = 0 then 'second' else 'first' end filename from pp
   union all select doc_id, page, ri, 'linear', "role", text, x0, y0, x1, y1, case when doc_id % 3 = 0 then 'second' else 'first' end from pl where doc_id % 3 <> 0 or "role" = 'paragraph'""", PLAIN))
def stored_analyses(spark, sf_dir):
    """Analyses of all documents are stored; those of every third document are replaced by shorter ones; then everything is read back."""
    # Rows are made from their blocks where these lie, each time a write needs them: so they are not stored twice.
    every, docs = blocks(spark, sf_dir), table(spark, sf_dir, "documents")
    pages, rows = page_rows_of(every), linear_rows_of(every)
    sheets, path = page_tables(spark, sf_dir)["layout_pages"], _folder(spark, "analyses")
    third = F.col("doc_id") % 3 == 0
    catalog.write_analysis(_nested(sheets, pages, rows, docs, F.lit("first")), path)
    some = rows.where(third & (F.col("role") == "paragraph"))
    catalog.write_analysis(_nested(sheets.where(third), pages.where(third), some, docs.where(third), F.lit("second")), path)
    back = catalog.read_analysis(spark, path)
    flat, cols = catalog.flatten_analysis(back, ("filename",)), ["doc_id", "page", "ri", "kind", "role", "text", *BOX, "filename"]
    return flat["page_rows"].select(cols).unionByName(flat["linear"].withColumn("kind", F.lit("linear")).select(cols))


_NAME = "case when doc_id % 7 = 0 then 'rejected' when doc_id in (select doc_id from labels) then 'conflict' else 'admitted' end"


@check("stream_documents", K.sql(f"""select doc_id, page, ri, kind, "role", case when kind = 'image' then '' else text end text from pp where {_NAME} = 'admitted'
   union all select doc_id, null, null, 'verdict', {_NAME}, 'doc' || doc_id || '.pdf' from (select distinct doc_id from blk)""", PLAIN))
def stream_documents(spark, sf_dir):
    """Layout files arrive in three lots, each with some pages of every document; every fifth document gets its name with the last lot only."""
    # Each lot makes its own blocks where the documents are read, so no text moves and no block is stored but as arriving.
    docs = documents_in_place(spark, sf_dir)
    layout, sheets = sample_layout.layout_blocks(docs), sample_layout.layout_pages(docs)
    source, out, checkpoint = (_folder(spark, n) for n in ("layout", "streamed", "progress"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    named = docs.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
                        F.when(F.col("doc_id") % 7 == 0, "text/html").otherwise("application/pdf").alias("content_type"))

    def analyze(blocks):
        rows = settle(page_rows_of(read_layout(blocks)))
        some = rows.select("doc_id").distinct()
        return _nested(sheets.join(some, "doc_id", "left_semi"), rows, rows.where("1 = 0"), some, F.lit("f"))

    for lot in range(3):
        layout.where((F.col("doc_id") + F.col("page")) % 3 == lot).write.mode("append").parquet(source)
        names = named if lot == 2 else named.where("doc_id % 5 <> 0")
        SJ.stream_documents(spark, source, lambda: labels, analyze, out, checkpoint, names=lambda n=names: n).awaitTermination()
    rows = catalog.flatten_analysis(catalog.read_analysis(spark, out))["page_rows"].select("doc_id", "page", "ri", "kind", "role", "text")
    verdicts = SJ.read_verdicts(spark, out).select(
        "doc_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("ri"), F.lit("verdict").alias("kind"), F.col("verdict").alias("role"), F.col("filename").alias("text"))
    return rows.unionByName(verdicts)


def _arriving(spark, events, key, files=4):
    """The events in files, read as a stream one file at a time."""
    source = _folder(spark, "events")
    events.repartition(files, key).write.parquet(source)
    return SJ.read_progress(spark, source, 1)


@check("stream_job_states", f"""with {_PE}, ends as (select job_id, min(ts) e from pe where phase in ('done','failed') group by all)
   select job_id, phase, case when phase in ('queued','done','failed') then phase else 'running' end status, case when phase = 'failed' then message end error, created_at, e finished_at from (
   select pe.job_id, e, arg_max(phase, ts) filter (e is null or ts <= e) phase, arg_max(message, ts) filter (e is null or ts <= e) message, min(ts) created_at from pe left join ends using (job_id) group by all)""")
def stream_job_states(spark, sf_dir):
    """Events of a job come in several batches, in any order; the store has each job once, as the batch job has."""
    out = _folder(spark, "jobs")
    SJ.keep_job_states(SJ.stream_job_state(_arriving(spark, progress_events(spark, sf_dir), "event_id")), out, _folder(spark, "progress")).awaitTermination()
    return BucketStore(spark, out, SJ.JOB_STATE, "job_id").read()


@check("open_jobs", f"""with pe as (select event_id // 5 job_id, event_id, ts, ({_PHASES})[event_id % 8 + 1] phase from events)
   select job_id, arg_max(phase, ts) phase, case when arg_max(phase, ts) = 'queued' then 'queued' else 'running' end status, null::timestamp finished_at from pe group by job_id having count(*) filter (phase in ('done','failed')) = 0""")
def open_jobs(spark, sf_dir):
    """Jobs of five events each; a job that has ended is forgotten after an hour, so the store keeps the open ones."""
    out = _folder(spark, "jobs")
    events = progress_events(spark, sf_dir).withColumn("job_id", F.floor(F.col("event_id") / 5))
    SJ.keep_job_states(SJ.stream_job_ttl(_arriving(spark, events, "job_id"), ttl_seconds=3600), out, _folder(spark, "progress"), SJ.JOB_TTL).awaitTermination()
    return BucketStore(spark, out, SJ.JOB_TTL, "job_id").read()
