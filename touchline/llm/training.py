"""What the two classifiers share: the bounded training sample and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 4000  # documents a model is fitted on; scoring has no bound
MAX_TRAIN_CHARS = 40_000  # longer documents are left out of the training sample only


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled texts that aren't held out, chosen by a hash of the id, in order of that hash."""
    usable = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = usable.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = usable.filter(place < int((1 << 20) * min(1.0, 0.9 * max_rows / max(n, 1)) + 1)).limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= max_chars)
    rows = rows.select("text", "y", F.xxhash64("doc_id").alias("h"), "doc_id").limit(2 * max_rows).collect()
    return [(r.text, int(r.y)) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.text))]
