"""Content-addressed identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(group: Column, seed: int = 0, explicit: Column | None = None) -> Column:
    """train, validation or test (80, 10, 10): the first 8 hex digits of SHA-256 of ``seed:group`` modulo 100, unless a
    split is stated."""
    value = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), group.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    drawn = F.when(value < 80, "train").when(value < 90, "validation").otherwise("test")
    return drawn if explicit is None else F.coalesce(explicit, drawn)


def digest(*columns: Column) -> Column:
    """SHA-256 over the columns' texts, null told apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]), 256)


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One SHA-256 over a table, whatever the order of its rows: the eight 32-bit words of the rows' digests are summed word by
    word (repeated rows count each time), and the sums and the number of rows are hashed. Sums are taken map-side, so no task
    holds more than its own partition."""
    row = rows.select(digest(*[F.col(c) for c in columns]).alias("d"))
    words = [F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = row.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"w{k}") for k, w in enumerate(words)])
    return sums.select("n_rows", F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *[f"w{k}" for k in range(8)]), 256).alias("fingerprint"))


def _json_digest(**fields: Column) -> Column:
    """SHA-256 of a JSON object with its keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def opaque_block(index: Column) -> Column:
    return F.format_string("block-%06d", (index + 1).cast("int"))


def opaque_source(payload: Column) -> Column:
    """A name for a document that says nothing of it: from the digest of its canonical JSON."""
    return F.concat(F.lit("source-"), F.substring(F.sha2(payload, 256), 1, 16))


def opaque_element(source_id: Column, page: Column, identity: Column) -> Column:
    return F.concat(F.lit("element-"), F.substring(_json_digest(source=source_id, page=page, identity=identity), 1, 24))


def opaque_candidate(block_id: Column, element_ids: Column, page: Column, source_id: Column, start: Column, end: Column, origin: Column) -> Column:
    """A digest of where a candidate lies; its elements count once, in order."""
    return _json_digest(block_id=block_id, element_ids=F.array_sort(F.array_distinct(element_ids)), page_number=page, source_id=source_id, start=start, end=end, origin=origin)
