import random

from riskloom.llm.token_rollup import TokenTotals
from riskloom.snapshots import SnapshotStore
from tests.llm.helpers import with_clashes

SCHEMA = "op string, transcript_id bigint, transcription_model string, detected_language string, tokenizer_version string, n_tokens bigint"


def changes(spark, rows):
    return with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(2))


def totals(ledger, spark, upto=None):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals(spark, upto).collect()}


def slow(batches):
    held = {}
    for rows in batches:
        best = {}
        for op, key, model, language, version, n in rows:
            if key is None or op is None:
                continue
            rank = (op != "delete", n or 0, model or "", language or "")
            at = (key, version)
            if at not in best or rank > best[at][0]:
                best[at] = (rank, None if op == "delete" else (model, language, n or 0))
        for at, (_, new) in best.items():
            held.pop(at, None)
            if new is not None:
                held[at] = new
    out = {}
    for (_, version), (model, language, n) in held.items():
        d, t = out.get((model, language, version), (0, 0))
        out[(model, language, version)] = (d + 1, t + n)
    return out


def test_batches_of_signed_changes(spark, tmp_path):
    rng = random.Random(8)
    batches = []
    for size in (60, 30, 30, 1):
        rows = [(rng.choice(["insert", "insert", "revise", "delete"]), rng.randrange(40), rng.choice(["m1", "m2", None]), rng.choice(["es", "pt"]),
                 rng.choice(["v1", "v2", None]), rng.randrange(100)) for _ in range(size)]
        batches.append([*rows, rows[0], ("insert", None, "m1", "es", "v1", 5), (None, 1, "m1", "es", "v1", 5), ("insert", 77, None, None, "v1", None)])
    ledger = TokenTotals(str(tmp_path / "totals"))
    assert totals(ledger, spark) == {}
    for number, rows in enumerate(batches):
        ledger.commit(number, changes(spark, rows))
        assert totals(ledger, spark) == slow(batches[:number + 1])
        ledger.commit(number, changes(spark, rows))                       # again: nothing changes
        assert totals(ledger, spark) == slow(batches[:number + 1])
    assert totals(ledger, spark, upto=1) == slow(batches[:2])


def test_a_commit_that_broke_off_between_its_tables_is_repeated(spark, tmp_path, monkeypatch):
    ledger, rows = TokenTotals(str(tmp_path / "totals")), [("insert", 1, "m", "es", "v", 10), ("insert", 2, "m", "es", "v", 5)]
    ledger.commit(1, changes(spark, rows))
    write = SnapshotStore.write_part

    def breaking(self, table, rows, key=None):
        if table == "deltas":
            raise RuntimeError("lost")
        return write(self, table, rows, key)
    monkeypatch.setattr(SnapshotStore, "write_part", breaking)
    later = [("revise", 1, "m", "es", "v", 7), ("delete", 2, "m", "es", "v", None)]
    try:
        ledger.commit(2, changes(spark, later))
    except RuntimeError:
        pass
    assert totals(ledger, spark) == {("m", "es", "v"): (2, 15)}
    monkeypatch.setattr(SnapshotStore, "write_part", write)
    ledger.commit(2, changes(spark, later))
    assert totals(ledger, spark) == {("m", "es", "v"): (1, 7)}


def test_an_empty_batch(spark, tmp_path):
    ledger = TokenTotals(str(tmp_path / "totals"))
    ledger.commit(1, changes(spark, []))
    assert totals(ledger, spark) == {}
