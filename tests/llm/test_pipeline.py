from collections import Counter

import corpus_pipeline
from corpusloom.llm import byte_bpe, exact_dedup, mixing, toxicity
from corpusloom.llm.common import documents
from tests.conftest import SF
from tests.llm.test_jaccard import plain_kept


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name != "byte_bpe":
            assert after.columns == docs.columns
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
            assert ids(after) == Counter(r.doc_id for r in scores if not r.predicted)
        elif name == "exact_dedup":
            rows = exact_dedup.dedup(docs, exact_dedup.new_index(spark, 2)).collect()
            assert ids(after) == Counter(r.doc_id for r in rows if r.kept)
        elif name == "simhash_near_dedup":
            assert sorted(map(str, ids(after).elements())) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])
        elif name == "mixing":
            assert ids(after) == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
        else:
            assert ids(after) == ids(docs) and all(r.n_tokens == len(r.ids) for r in after.collect())
            texts = {r.doc_id: r.text for r in docs.collect()}
            enc = byte_bpe.load_encoding(byte_bpe.default_ranks())
            assert all(enc.decode(list(r.ids)) == texts[r.doc_id] for r in after.collect())
        docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and rows.count() > 100
