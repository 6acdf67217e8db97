"""Times the main plans on the sample layout of the documents and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.answer_checks import _info, echo_client
from checks.registry import documents
from folioframe.operators import continuation as C
from folioframe.plans import explain as PE
from folioframe.plans import extract as X
from folioframe.session import BUILD_SETTINGS, settle, tune
from folioframe.sources import sample_layout

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main():
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    for key, value in {**BUILD_SETTINGS, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false",
                       "spark.sql.shuffle.partitions": CPUS, "spark.ui.showConsoleProgress": "false"}.items():
        builder = builder.config(key, value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times, kept = {}, {}

    def timed(name, fn):
        start = time.time()
        out = fn()
        out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        return out

    bronze = sample_layout.bronze(documents(spark, SF_DIR))
    bronze.pop("recognized_lines")
    bronze["layout_blocks"] = timed("layout_table", lambda: settle(bronze["layout_blocks"]))

    def walked():
        kept["walk"] = X.walked(bronze)
        return kept["walk"]

    def pages():
        kept["pages"] = settle(X.finish_pages(X.W.page_rows(kept["walk"]), texts=X.W.page_rows(kept["walk"], bare=True)))
        return kept["pages"]

    def linear():
        kept["linear"] = settle(X.finish_linear(X.W.linear_rows(kept["walk"]), texts=X.W.linear_rows(kept["walk"], bare=True)))
        return kept["linear"]

    timed("walk", walked)
    timed("page_projection", pages)
    timed("linear_projection", linear)
    timed("full_texts", lambda: C.full_text(kept["pages"].where("kind = 'block'")))
    timed("metadata", lambda: X.D.metadata_blocks(kept["walk"], kept["pages"], kept["linear"], bronze["layout_pages"]))
    cache = spark.createDataFrame([], "key string, body string, finish string")
    info = _info(spark, SF_DIR).withColumn("map_json", F.lit("{}"))
    timed("explain", lambda: PE.explain(kept["linear"], info, cache, echo_client, wait=False))
    print(json.dumps({"metric": "document_structure_total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
