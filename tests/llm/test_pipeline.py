"""The pipeline's stages, each against a plain version on its own input."""

import re

import sentencepiece

import corpus_pipeline
from noticeloom.llm import pieces, secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    from tests.llm.test_operators import brute_near, longest_matches

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        at[name] = docs, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rows = lambda k: [tuple(r) for r in k.collect()]
    before, after = (rows(x) for x in at["language_id"])
    from noticeloom.llm import language

    samples = language.training_sample(spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(doc_id AS string)) % 5 <> 0"))
    parser = language.CrossParser(samples)
    assert all(re.search(r"[^\W\d_]", r[1] or "") for r in after) and set(after) <= set(before)
    for r in before:  # a row stays if its text is short or costs less than random letters do
        t = language.folded(r[1] or "")
        if re.search(r"[^\W\d_]", r[1] or "") and len(t) < 400:
            cost, best = min((longest_matches(samples[x], t) * bits, x) for x, bits in zip(parser.languages, parser.bits, strict=True))
            assert (r in after) == (cost < parser.random[best] * len(t) or len(r[1]) < language.SHORT)
    before, after = (rows(x) for x in at["near_duplicates"])
    kept = {name for _, n, name in brute_near(before) if n}
    assert {r[0] for r in after} == kept and len(after) == len(kept)
    before, after = (dict((r[0], r[1]) for r in rows(x)) for x in at["secret_scan"])
    assert after == {i: secrets.redacted(t) for i, t in before.items()} and not any(secrets.base_spans(t) for t in after.values())
    before, after = (rows(x) for x in at["mixing"])
    size = lambda some: sum(len(WORD.findall(r[1])) for r in some)
    assert abs(size(after) - 1.5 * size(before)) < 0.02 * size(before) and {r[0] for r in after} <= {r[0] for r in before}
    before, after = (x.collect() for x in at["sentencepiece"])
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.ids == model.encode(text[r.doc_id]) for r in after)


def test_run_has_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).where("NOT round_trip").count() == 0


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, odd texts and columns named as results; then no rows at all."""
    from tests.llm.test_operators import DOC, corpus

    rows = corpus()
    for name, some in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(some, DOC).repartition(2)
        counts = [docs.count()]
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{k}")
            columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
            counts.append(docs.count())
        if some:
            assert 0 < counts[2] < counts[1] < counts[0] and counts[2] == counts[3] and counts[4] == counts[5] > 0 and docs.where("NOT round_trip").count() == 0
        else:
            assert counts == [0] * 6
