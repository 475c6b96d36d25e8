r"""HTML extraction by a recurrent block labeller.

Each page is cut into leaf blocks (`html_blocks`); a bidirectional LSTM (`html_model`), trained on the driver, once a process
(some 20 seconds), and sent to the tasks (60 KB), labels every block in the context of its page. The blocks of main text are joined by one space.

Null and empty pages, and pages without blocks of main text, give an empty text. Pages are judged one by one: order, repetition, null or repeated ids and
partitioning don't matter. An empty table gives an empty result. A page is read once from its start to its end, and blocks share what they know of the elements around them: long
and deeply nested pages take time and memory in proportion. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_blocks import blocks
from .html_model import Labeller, trained, vectors


def extracted(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of each row of pages (page_id, url, html)."""
    parameters = (labeller or trained()).p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.p = parameters
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                cut = [blocks(h) for h in part["html"].to_pylist()]
                chosen = net.labels([vectors(p) for p in cut])
                text = [" ".join(b.text for b, yes in zip(p, mark, strict=True) if yes) for p, mark in zip(cut, chosen, strict=True)]
                found = {"text": text, "n_chars": [len(t) for t in text], "n_blocks": [len(p) for p in cut], "n_main": [int(m.sum()) for m in chosen]}
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], *map(pa.array, found.values())], ["page_id", "url", *found])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def op8_recurrent_labeller(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", "n_chars")
