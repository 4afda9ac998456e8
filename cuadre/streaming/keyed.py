"""Incremental ingest whose memory of files and invoices is keyed state, not a scan of what was written.

Two stateful operators follow each other. The first knows the file ids that came, the second the
invoices that were loaded; a micro-batch asks the state store for its own keys only, so what it reads
does not grow with the history. Keys are handled by buckets of them, each key on its own in the state.
Invoices loaded before the stream are the second one's initial state and are read once. The state is versioned with the checkpoint: a batch that is run again after a failure
sees the state as it was before that batch.

Of the tables only the vendors (id, tax number) and, if items name them, the manufacturers (id, name) are
read in a batch, columns of the dimensions that any load has to join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from cuadre.operators.load import FIRST, check_batch, keep_records, load_parsed
from cuadre.schemas import natural_id
from cuadre.streaming.ingest import write_tables, with_loaded

#: Spark renames columns that begin with an underscore on their way to a state processor.
KEY = "state_key"
#: Keys are dealt to this many buckets by hash; Spark calls the operator once for a bucket of a batch, since a call for each key
#: takes milliseconds. The number is part of the state: a checkpoint goes on only with the number it began with.
BUCKET, BUCKETS = "state_bucket", 1024
#: Rows of one key come in this order, missing values last.
ORDER = ["received_at", "file_id", "extraction"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Marks the first row of each key in the whole stream; rows with a null key have no state and are no first row.

    Within a batch the first is the least under ``ORDER``. One row of each key of a bucket is held at a time beside the frame
    that Spark hands over, however many a key has. The state is asked for the keys of the batch one by one, never read whole.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def _out(self, frame: pd.DataFrame, first: bool | list[bool]) -> pd.DataFrame:
        return frame[self.columns].assign(**{FIRST: first})

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "key string", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        for known in initialState[KEY]:
            self.seen.updateValue((known,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for frame in rows:
            without = frame[KEY].isna()
            if without.any():
                yield self._out(frame[without], False)
                frame = frame[~without]
            if best is not None:
                frame = pd.concat([best, frame], ignore_index=True)
            if not frame[KEY].is_unique:
                frame = frame.sort_values(ORDER, na_position="last", kind="stable")
                later = frame.duplicated(KEY)
                yield self._out(frame[later], False)
                frame = frame[~later]
            best = frame
        if best is not None and len(best):
            new = [not self.seen.containsKey((k,)) for k in best[KEY]]
            for k in best.loc[new, KEY]:
                self.seen.updateValue((k,), (True,))
            yield self._out(best, new)

    def close(self) -> None:
        pass


def _marked(keyed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The columns of ``keyed`` but ``KEY``, and ``FIRST``; keys of ``before`` (column ``KEY``) count as seen."""
    columns = [c for c in keyed.columns if c != KEY]
    out = ", ".join([*(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in columns), f"{FIRST} boolean"])
    initial = None if before is None else before.select(_bucket(F.col(KEY)), KEY).groupBy(BUCKET)
    # rows without a key are spread over the buckets by their content
    dealt = keyed.withColumn(BUCKET, F.when(F.col(KEY).isNotNull(), _bucket(F.col(KEY))).otherwise(_bucket(*columns)))
    return dealt.groupBy(BUCKET).transformWithStateInPandas(FirstOfKey(columns), out, "Append", "None", initialState=initial)


def _bucket(*of: Column | str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int").alias(BUCKET)


def first_of_files(stream: DataFrame) -> DataFrame:
    """The first row of each file id; rows without one stay, each for itself."""
    return _marked(stream.withColumn(KEY, F.col("file_id"))).where(F.col(FIRST) | F.col("file_id").isNull()).drop(FIRST)


def _invoice_key(vendor_id: Column, number: Column) -> Column:
    return F.to_json(F.array(vendor_id, number))


def first_of_invoices(stream: DataFrame, vendors: DataFrame, invoices: DataFrame) -> DataFrame:
    """``stream`` with ``FIRST``: whether a row is usable and the first of its invoice, here and against ``invoices``.

    ``vendors`` (id, nit) and ``invoices`` (vendor_id, invoice_number) are the rows from before the stream; other
    vendors have the id that the load makes from their tax number.
    """
    ids = vendors.groupBy("nit").agg(F.min("id").alias("_vendor_id"))
    read = check_batch(stream).select(*stream.columns, F.col("vendor.nit").alias("nit"), F.col("invoice_number").alias("_number"), "reject_reason")
    vendor_id = F.coalesce(F.col("_vendor_id").cast("string"), natural_id("nit"))
    keyed = read.join(ids, "nit", "left").select(
        *stream.columns, F.when(F.col("reject_reason").isNull(), _invoice_key(vendor_id, F.col("_number"))).alias(KEY))
    before = invoices.select(_invoice_key(F.col("vendor_id").cast("string"), F.col("invoice_number")).alias(KEY)).distinct()
    return _marked(keyed, before)


def write_batch(
    batch: DataFrame, batch_id: int, root: str, stores: DataFrame, vendors: DataFrame, manufacturers: DataFrame | None = None
) -> None:
    """Load the marked rows of a micro-batch into ``root``, one ``batch=<id>`` folder per table; run again, it overwrites them."""
    vendors = with_loaded(vendors.select("id", "nit"), root, "vendors", batch_id)
    if manufacturers is not None:
        manufacturers = with_loaded(manufacturers.select("id", "name"), root, "manufacturers", batch_id)
    write_tables(load_parsed(keep_records(check_batch(batch)), vendors, stores, None, manufacturers), root, batch_id)


def stream_ingest(
    source: DataFrame, root: str, checkpoint: str, stores: DataFrame, vendors: DataFrame, invoices: DataFrame,
    trigger: dict | None = None, manufacturers: DataFrame | None = None,
) -> StreamingQuery:
    """Start the ingest with keyed state; arguments and tables as for :func:`cuadre.streaming.ingest.stream_ingest`.

    ``source`` has file_id, received_at, extraction, and raw_ocr_text if short texts are to be rejected. An empty
    source starts a query that loads nothing.
    """
    marked = first_of_invoices(first_of_files(source), vendors, invoices)
    return with_rocksdb(source.sparkSession, lambda: (
        marked.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda df, i: write_batch(df, i, root, stores, vendors, manufacturers)).start()))


def with_rocksdb(spark: SparkSession, start) -> StreamingQuery:
    """Start a query with the RocksDB state store, which these operators need; the session's own setting comes back after it.

    A query keeps the settings it was started with.
    """
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)
