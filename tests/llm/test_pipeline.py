import corpus_pipeline
from shoplens.llm import bpe, langid, linededup, mix, neardup
from .test_linededup import brute as brute_lines
from .test_neardup import brute as brute_near


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_agree_with_brute_force(spark, documents, folder, tmp_path):
    docs, columns = documents, documents.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "language":
            told = {r["doc_id"] for r in langid.identify(docs).where("lang_pred != 'und' and score >= 0.5").collect()}
            expected = [r for r in before if r[0] in told]
        elif name == "line dedup":
            left = brute_lines(before, linededup.LEAST_WORDS)
            expected = sorted((d, left[d]) for d, text in before if left[d].split() or left[d] == text)
        elif name == "near duplicates":
            groups = brute_near(before, neardup.SHINGLE, neardup.PERCENT)
            expected = [r for r in before if groups[r[0]][1] == r[0]]
        elif name == "mix":
            copies = {r["doc_id"]: r["copies"] for r in mix.mix_plan(docs).collect()}
            expected = sorted(r for r in before for _ in range(copies[r[0]]))
        else:
            ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
            assert sorted(r["doc_id"] for r in out.collect()) == [d for d, _ in before]
            assert all(r["ids"] == ids[r["doc_id"]] for r in out.collect())
            break
        assert out.columns == columns
        assert rows_of(out) == expected
        docs = out


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "ids"]


def test_empty_and_odd_tables(spark, odd, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        stage(spark, odd, folder).collect()
