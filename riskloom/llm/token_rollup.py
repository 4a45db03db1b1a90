"""Token totals per transcription model, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import only
from riskloom.snapshots import Change, SnapshotStore

KEYS = ("transcription_model", "detected_language", "tokenizer_version")
ROW = ("transcript_id", *KEYS)


class TokenTotals:
    """A ledger of signed rows under one folder, with the totals of each batch beside it.

    A batch is a table of changes: op (insert, revise or delete), transcript_id, the three KEYS and
    n_tokens. It is turned into signed rows against what the earlier batches left: an insert or a
    revision puts +1 document and +n_tokens, a revision or a delete takes back what the transcript had
    under that tokenizer version, in whatever source and language it was booked. An insert of a
    transcript that is there already counts as a revision, a delete of an unknown one as nothing, a
    delete and an insert of one transcript in one batch as a revision. Equal rows of a batch count
    once; of different ones for a transcript and version the one with the most tokens counts. Rows
    with a null id or op are left out; null keys are kept as they are; null counts are 0.

    Every batch has a number. Its rows of ledger and totals are written apart and published together, so a reader
    sees all of a batch or nothing; committing it again, after a failure or by mistake, replaces them by the same
    rows. Batches are committed in rising order.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _rows(self, store: SnapshotStore, table: str, below: int | None = None) -> DataFrame | None:
        parts = [p for p in store.state().parts(table) if below is None or int(p.key) < below]
        return store.spark.read.parquet(*[f"{store.root}/{p.folder}" for p in parts]) if parts else None

    def commit(self, batch: int, changes: DataFrame, transcript_id: str = "transcript_id", op: str = "op",
               transcription_model: str = "transcription_model", detected_language: str = "detected_language",
               tokenizer_version: str = "tokenizer_version", n_tokens: str = "n_tokens") -> None:
        spark = changes.sparkSession
        rows = only(changes, op=op, transcript_id=transcript_id, transcription_model=transcription_model,
                    detected_language=detected_language, tokenizer_version=tokenizer_version, n_tokens=n_tokens)
        rows = rows.filter("transcript_id IS NOT NULL AND op IS NOT NULL").withColumn(
            "n_tokens", F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)))
        best = F.max_by(F.struct("transcription_model", "detected_language", "n_tokens"),
                        F.struct(F.col("op") != "delete", "n_tokens", "transcription_model", "detected_language"))
        rows = rows.groupBy("transcript_id", "tokenizer_version").agg(F.bool_or(F.col("op") != "delete").alias("stays"), best.alias("new"))
        added = rows.filter("stays").select("transcript_id", "tokenizer_version", "new.*", F.lit(1).cast("bigint").alias("documents"))
        store = SnapshotStore(spark, self.folder)
        earlier, signed = self._rows(store, "ledger", batch), added
        if earlier is not None:
            held = earlier.groupBy(*ROW).agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")).filter(
                "documents != 0 OR n_tokens != 0")
            gone = held.join(rows.select(F.col("transcript_id").alias("_i"), F.col("tokenizer_version").alias("_v")),
                             F.col("transcript_id").eqNullSafe(F.col("_i")) & F.col("tokenizer_version").eqNullSafe(F.col("_v")), "left_semi")
            signed = added.unionByName(gone.withColumns({"documents": -F.col("documents"), "n_tokens": -F.col("n_tokens")}))
        ledger = store.write_part("ledger", signed.select(*ROW, "documents", "n_tokens"), str(batch))
        own = spark.read.parquet(f"{store.root}/{ledger.folder}")
        deltas = store.write_part("deltas", own.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")), str(batch))
        store.commit(lambda state: [Change("ledger", ledger), Change("deltas", deltas)])

    def totals(self, spark, upto: int | None = None) -> DataFrame:
        """KEYS, documents, n_tokens after the given batch (or all); groups without documents are left out."""
        deltas = self._rows(SnapshotStore(spark, self.folder), "deltas", None if upto is None else upto + 1)
        if deltas is None:
            return spark.createDataFrame([], "transcription_model string, detected_language string, tokenizer_version string, "
                                             "documents bigint, n_tokens bigint")
        return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")).filter("documents != 0")
