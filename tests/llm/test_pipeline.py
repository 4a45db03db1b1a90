"""The stages on a small folder of tables with planted cases."""

import random

import pytest

import corpus_pipeline
from tests.llm.helpers import with_clashes

INSULTS = ["payaso", "miserable", "imbecil"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice(["ca", "re", "mi", "to", "lu", "se", "na", "vo"]) for _ in range(3)) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    docs, labels = [], []
    for i in range(600):
        body, toxic = text(rng.randrange(60, 140)), i % 6 == 0
        if toxic:
            body = body + " " + rng.choice(INSULTS) + " " + text(3)
        docs.append((i, body))
        labels.append((i, 1, int(toxic)))
    docs += [(700 + k, docs[1][1]) for k in range(5)] + [(710, docs[2][1] + " fin")] + [(720 + k, text(40) + " " + item) for k in range(3)]
    docs += [(730, None), (731, ""), (732, item + " " + text(700))]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, ["en", "fr"][k % 2], f"src{k % 12}", None if t is None else len(t)) for k, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(path + "/benchmark.parquet")
    return path


def test_each_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    clean = [i for i in range(600) if i % 6]
    assert kept["toxicity"] == clean + [*range(700, 705), 710, 720, 721, 722, 730, 731, 732]
    assert kept["near_duplicates"] == clean + [720, 721, 722, 730, 732]
    assert kept["decontamination"] == [k for k in kept["near_duplicates"] if k not in (720, 721, 722)]
    assert set(kept["mixing"]) < set(kept["decontamination"]) and len(set(kept["mixing"])) == len(kept["mixing"])


def test_run_gives_a_row_per_document(spark, folder):
    rows = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_columns_with_internal_names_stay_untouched(spark, folder):
    plain = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        clashing = with_clashes(plain)
        kept = stage(spark, clashing, folder)
        assert kept.columns == clashing.columns
        extra = [c for c in clashing.columns if c not in plain.columns]
        assert kept.filter(" OR ".join(f"NOT `{c}` <=> 'x'" for c in extra)).count() == 0
        plain = stage(spark, plain, folder)
        plain = spark.read.schema(plain.schema).parquet(_written(plain, folder, name))
        assert sorted(map(tuple, kept.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def _written(df, folder, name):
    df.write.parquet(f"{folder}/kept-{name}")
    return f"{folder}/kept-{name}"
