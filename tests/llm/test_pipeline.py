"""The pipeline against its operators run one by one, and the query list."""
import random
import string

import corpus_pipeline
from marketlens.llm import order_minhash, queries, secrets
from tests.conftest import SF
from tests.llm.test_operators import _packing_holds


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == names, name
        if name == "near_duplicates":
            kept = {r.doc_id for r in order_minhash.classes(before).where("kept").collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
    texts = [r.text for r in docs.collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    _packing_holds(rows, texts)


def test_every_operator_has_a_query():
    import __spark_entry__ as entry
    found = entry.queries()
    assert {f.split("_")[0] for f in found if f.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in found and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_language_stage_rejects_texts_of_no_learned_language(spark):
    rng = random.Random(1)
    docs = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = ["".join(rng.choice(string.ascii_letters) for _ in range(n)) for n in (60, 200, 400)]
    odd += ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4, "", None, " \n12 34"]
    rows = spark.createDataFrame([(-1 - i, t, None, "x", 0) for i, t in enumerate(odd)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(rows), SF).collect()}
    assert not any(i < 0 for i in left)
    lettered = {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect()}
    assert len(left & lettered) >= 0.99 * len(lettered)
    assert corpus_pipeline.language(spark, docs.where("1 = 0"), SF).count() == 0


def test_tokens_of_any_length_are_proposed(spark):
    token = "".join(random.Random(3).choices(string.ascii_letters + string.digits, k=300))
    rows = spark.createDataFrame([(1, f"see {token} there", "a")], "doc_id long, text string, source string")
    assert secrets.find(rows).first().spans == "token:4:304"
