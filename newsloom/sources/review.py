"""A page that shows gold and predicted boundaries side by side."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from newsloom.functions import text as T
from pyspark.sql import functions as F


def _marker(event) -> str:
    sides = "".join(f"<span class='{who}'>{label} {event[who]:,}</span>" for who, label in (("gold", "annotated"), ("model", "predicted")) if event[who] is not None)
    note = {"match": f"agreed, {event['off']} words apart", "missed": "not predicted", "extra": "not annotated"}[event["kind"]]
    return f"<div class='mark {event['kind']}'>{sides}<em>{note}</em></div>"


def render(events: DataFrame, title: str, most: int = 500) -> str:
    """One page for a few records (record_id, body, events), in record order; paragraphs are cut in Spark.  An error for more than `most`."""
    if events.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} records for one page")
    cuts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("events.at"), F.array(F.size("_w").cast("bigint")))
    part = F.transform(F.sequence(F.lit(0), F.size("events")), lambda i: T.paragraphs(F.array_join(F.slice("_w", (F.get("_cuts", i) + 1).cast("int"), F.greatest(F.get("_cuts", i + 1) - F.get("_cuts", i), F.lit(0)).cast("int")), " ")))
    rows = events.withColumn("_w", T.words(F.col("body"))).withColumn("_cuts", cuts).select("record_id", "events", part.alias("parts")).orderBy("record_id").collect()
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for row in rows:
        out.append(f"<section><h2>{html.escape(row.record_id)}</h2>")
        for i, part_ in enumerate(row.parts):
            out += [f"<p>{html.escape(p)}</p>" for p in part_]
            if i < len(row.events):
                out.append(_marker(row.events[i]))
        out.append("</section>")
    return "\n".join(out)
